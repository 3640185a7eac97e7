"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation.

Texts of one shingle set are folded to one representative first, a node of its own number, so that an id with several
texts is as many nodes. A representative's MinHash samples give
band keys. Further samples, the minima of its hashes in 4,096 equal parts of their range, are folded into
a parity bitmap (an odd sketch); the population count of two bitmaps' XOR estimates high similarities
precisely, so few candidates of the bands need the exact look at both sets.

Within a band, every member is first compared with the smallest one only, so a group of thousands of
copies costs a pair per member. Components of the links found then tell the bands whose members still
lie in different components; there the members outside the largest component are compared with all others, in
cells of bounded size that Spark deals out. A cell is sent the sets beside the bitmaps, confirms what the bitmaps
allow, and gives the links that join components, fewer than its rows. Pairs of long sets leave it as candidates
instead, the nearest first and more in every further round, until none of different components is left out: no
link between components is lost that shares a band.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, fresh, ship, slices
from strandline.llm.graph import components
from strandline.llm.words import mix, shingle_sets

#: Ids that may be broadcast to pick the texts to confirm; more are joined by exchange.
BROADCAST_IDS = 1_000_000


@dataclass(frozen=True)
class Scheme:
    """``bands`` of ``rows`` samples: at similarity s a band agrees with probability s ** rows.

    With 30 bands of 5, a link at 0.85 is missed once in 40 million. ``block``: members on a side of a cell
    of comparisons; ``carried``: shingles of a set up to which it is sent into the cells.
    """

    k: int = 3
    percent: int = 85
    bands: int = 30
    rows: int = 5
    parts: int = 4096
    sketch_bits: int = 2048
    block: int = 4096
    carried: int = 1024

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def may_be_similar(self, apart: np.ndarray, na: np.ndarray, nb: np.ndarray, ea: np.ndarray, eb: np.ndarray) -> np.ndarray:
        """Whether sets of sizes ``na`` and ``nb``, with ``ea`` and ``eb`` parts filled, whose bitmaps differ in
        ``apart`` bits, lie within five standard errors of what the threshold makes expect."""
        bits, j = self.sketch_bits, self.percent / 100
        differ = -bits / 2 * np.log(1 - 2 * np.minimum(apart, 0.49 * bits) / bits)
        # Sizes that would fill as many parts, so that chance in the filling cancels out.
        size = [np.log(1 - np.minimum(e, self.parts - 0.5) / self.parts) / np.log(1 - 1 / self.parts) for e in (ea, eb)]
        filled = self.parts * (1 - (1 - 1 / self.parts) ** ((size[0] + size[1]) / (1 + j)))
        union = (na + nb) / (1 + j)
        expected = np.maximum(ea + eb - 2 * j * filled, 0)
        # Samples stand for all hashes but those that share a part; bits stand for samples but those that meet.
        sampled = 4 * filled * j * (1 - j) * np.maximum(1 - filled / union, 0)
        left = np.exp(-4 * expected / bits)
        folded = np.maximum(bits / 4 * (1 - left) - expected * left, 0) / left
        return differ <= expected + 5 * np.sqrt(sampled + folded) + 3


def signatures(sets: list[np.ndarray], scheme: Scheme) -> np.ndarray:
    """MinHash samples [set, sample] of non-empty sets of 64-bit hashes."""
    rng = np.random.default_rng(7919)
    xor = rng.integers(0, 1 << 32, scheme.samples, dtype=np.uint32)
    factor = rng.integers(0, 1 << 31, scheme.samples, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    out = np.empty((len(sets), scheme.samples), np.uint32)
    if not sets:
        return out
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    for j in range(scheme.samples):
        h = (flat ^ xor[j]) * factor[j]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x7FEB352D)
        out[:, j] = np.minimum.reduceat(h, starts)
    return out


def odd_sketches(sets: list[np.ndarray], scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(parity bitmaps [set, byte], parts filled) of non-empty sorted sets: each part's least hash flips one bit."""
    bits = scheme.sketch_bits
    if not sets:
        return np.zeros((0, bits // 8), np.uint8), np.zeros(0, np.int64)
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    part = flat // np.uint64((1 << 64) // scheme.parts)
    least = np.flatnonzero(np.append(True, (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])))
    at = (mix(flat[least]) % np.uint64(bits)).astype(np.int64)
    flips = np.bincount(owner[least] * bits + at, minlength=len(sets) * bits).astype(np.uint8) & 1
    return np.packbits(flips.reshape(len(sets), bits), 1), np.bincount(owner[least], minlength=len(sets))


def band_keys(samples: np.ndarray, scheme: Scheme) -> np.ndarray:
    """A 64-bit key per band [set, band]."""
    parts = samples.reshape(len(samples), scheme.bands, scheme.rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, scheme.bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2]).copy()
    for j in range(scheme.rows):
        key = mix(key + parts[:, :, j])
    return key.view(np.int64)


def sketched(docs: DataFrame, scheme: Scheme, text: str = "text") -> DataFrame:
    """doc_id, text_hash, n_shingles, fp (a fingerprint of the set; null if empty), sketch, filled, bands: one narrow pass."""
    ship(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 2 << 20):
            sets = shingle_sets(b.column(text), scheme.k)
            some = [i for i, s in enumerate(sets) if len(s)]
            samples = signatures([sets[i] for i in some], scheme)
            keys = band_keys(samples, scheme)
            bitmaps, full = odd_sketches([sets[i] for i in some], scheme)
            fp, sketch, filled, bands = ([None] * len(sets) for _ in range(4))
            for row, i in enumerate(some):
                s = sets[i]
                fp[i] = np.array([mix(s).sum(), mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(), len(s)], np.uint64).tobytes()
                sketch[i], filled[i], bands[i] = bitmaps[row].tobytes(), int(full[row]), keys[row]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), pa.array(list(map(len, sets)), pa.int64()), pa.array(fp, pa.binary()), pa.array(sketch, pa.binary()), pa.array(filled, pa.int32()), pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "text_hash", "n_shingles", "fp", "sketch", "filled", "bands"],
            )

    return docs.select("doc_id", text, F.xxhash64(text).alias("text_hash")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, fp binary, sketch binary, filled int, bands array<long>")


def _sketch_filter(pairs: DataFrame, scheme: Scheme) -> DataFrame:
    """(a, b) of rows a, b, sa, sb, na, nb, ea, eb whose sizes and sketches allow the similarity."""
    sized = pairs.where((F.least("na", "nb") * 100) >= (F.greatest("na", "nb") * scheme.percent))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                apart = np.bitwise_count(_bitmaps(b.column("sa"), scheme) ^ _bitmaps(b.column("sb"), scheme)).sum(1)
                near = pa.array(scheme.may_be_similar(apart, *(b.column(c).to_numpy() for c in ("na", "nb", "ea", "eb"))))
                yield pa.RecordBatch.from_arrays([b.column("a").filter(near), b.column("b").filter(near)], ["a", "b"])

    return sized.select("a", "b", "sa", "sb", "na", "nb", "ea", "eb").mapInArrow(run, "a long, b long")


def _bitmaps(column: pa.Array, scheme: Scheme) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, scheme.sketch_bits // 64)


@dataclass(frozen=True)
class _Texts:
    """The documents' texts by node: a node is read as the row of its representative's id and text hash."""

    docs: DataFrame
    text: str
    reps: DataFrame  # node, doc_id, text_hash

    def sets(self, nodes: DataFrame, scheme: Scheme, longest: int | None = None) -> DataFrame:
        """node and set (the sorted 64-bit hashes of its shingles) of the nodes named: as an array, or, with ``longest``, as bytes that are null
        beyond so many shingles."""
        wanted = self.reps.join(nodes, "node", "left_semi")
        if nodes.count() <= BROADCAST_IDS:
            wanted = F.broadcast(wanted)
        texts = self.docs.select("doc_id", F.xxhash64(self.text).alias("text_hash"), F.col(self.text).alias("text")).join(wanted, ["doc_id", "text_hash"]).select("node", "text")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches, "text", 2 << 20):
                sets = shingle_sets(b.column("text"), scheme.k)
                if longest is None:
                    column = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                else:
                    column = pa.array([s.tobytes() if len(s) <= longest else None for s in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("node"), column], ["node", "set"])

        # A repeated row of a representative gives its set once.
        return texts.mapInArrow(run, f"node long, set {'array<long>' if longest is None else 'binary'}").groupBy("node").agg(F.first("set").alias("set"))


def confirmed(pairs: DataFrame, texts: _Texts, scheme: Scheme) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets are similar enough."""
    nodes = cut(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
    sets = cut(texts.sets(nodes, scheme))
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")

    # Row by row on the JVM: an Arrow batch of pairs of long sets would have no bound.
    shared = F.size(F.array_intersect("x", "y")).alias("shared")
    return both.select("a", "b", shared, F.size("x").alias("nx"), F.size("y").alias("ny")).where(f"100 * shared >= {scheme.percent} * (nx + ny - shared)").select("a", "b").distinct()


def _unpacked(pack: bytes | None) -> np.ndarray | None:
    return None if pack is None else np.frombuffer(pack, np.uint64)


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set ``one`` each of the sets ``others`` holds."""
    flat = np.concatenate(others)
    hit = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hit, np.cumsum([0, *map(len, others[:-1])]), dtype=np.int64)


def _residual(bands: DataFrame, sketches: DataFrame, labels: DataFrame, texts: _Texts, scheme: Scheme, nearest: int, again: bool) -> DataFrame:
    """(a, b, sure, more): links and candidates between different components of one band, the smallest member's
    pairs left out.

    A band's members are dealt over cells of at most ``block`` seekers (members outside the band's largest
    component) by ``block`` members. A cell tells the pairs whose bitmaps allow the similarity and confirms
    them on the sets it was sent; of those it gives just the links that join two components (``sure``). Where a set is too
    long to be sent, the seeker's ``nearest`` candidates are given, and whether it has ``more``; ``again``: these pairs alone.
    A pair that shares several bands is looked at in the first of them alone.
    """
    member = bands.join(labels, "node").select("band", "node", F.col("component").alias("c"))
    mixed = member.groupBy("band").agg(F.min("c").alias("c1"), F.max("c").alias("c2"), F.min("node").alias("pivot"), F.count(F.lit(1)).alias("n")).where("c1 < c2 and n > 2").select("band", "pivot")
    left = member.join(mixed, "band").where("node != pivot")
    if again:  # partners of a long set are nearly as long
        left = left.join(sketches.where(F.col("n_shingles") * 100 >= scheme.carried * scheme.percent).select("node"), "node", "left_semi")
    weight = left.groupBy("band", "c").agg(F.count(F.lit(1)).alias("n"))
    groups = weight.groupBy("band").agg(F.max_by("c", F.struct("n", "c")).alias("main"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("minor")).where("minor > 0")
    placed = cut(left.join(groups, "band").select("band", "node", "c", "main", "all", "minor"))
    ids = cut(placed.select("node").distinct())
    packs = texts.sets(ids, scheme, scheme.carried).withColumnRenamed("set", "pack")
    rows, columns = (F.ceil(F.col(k) / scheme.block).cast("int") for k in ("minor", "all"))
    mine = F.when(F.col("c") != F.col("main"), F.pmod(F.xxhash64("node", "band"), rows).cast("int"))
    dealt = placed.select("band", "node", "c", mine.alias("i"), F.pmod(F.xxhash64("band", "node"), columns).cast("int").alias("j"), rows.alias("rows"), columns.alias("columns"))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda x: F.struct(x.alias("row"), F.col("j").alias("column")))
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda x: F.struct(F.col("i").alias("row"), x.alias("column")))
    cells = dealt.withColumn("cell", F.explode(F.when(F.col("i").isNull(), down).otherwise(F.array_union(down, across)))).drop("rows", "columns")
    whole = cells.join(sketches, "node").join(packs, "node").select("band", F.col("cell.row").alias("row"), F.col("cell.column").alias("column"), "node", "c", F.coalesce("i", F.lit(-1)).alias("i"), "j", "n_shingles", "filled", "sketch", "keys", "pack")

    def compare(t: pa.Table) -> pa.Table:
        bits = _bitmaps(t.column("sketch").combine_chunks(), scheme)
        keys = np.stack(t.column("keys").to_numpy())
        place = int((keys == np.int32(t.column("band")[0].as_py() >> 32)).all(0).argmax())
        doc, c, n, filled, i, j = (t.column(k).to_numpy() for k in ("node", "c", "n_shingles", "filled", "i", "j"))
        sets = [_unpacked(p) for p in t.column("pack").to_pylist()]
        short = np.array([s is not None for s in sets])
        c, here = c.copy(), j == t.column("column")[0].as_py()
        out: list[tuple[int, int, bool, bool]] = []
        for s in np.flatnonzero(i == t.column("row")[0].as_py()).tolist():
            at = np.flatnonzero(here & (c != c[s]) & (np.minimum(n, n[s]) * 100 >= np.maximum(n, n[s]) * scheme.percent))
            at = at[(keys[at, : place + 1] == keys[s, : place + 1]).argmax(1) == place]
            apart = np.bitwise_count(bits[at] ^ bits[s]).sum(1)
            near = scheme.may_be_similar(apart, n[at], n[s], filled[at], filled[s])
            at = at[near][np.argsort(apart[near], kind="stable")]
            sent = at[short[at]] if short[s] else at[:0]
            if len(sent) and not again:
                shared = _overlaps(sets[s], [sets[x] for x in sent])
                for x in sent[100 * shared >= scheme.percent * (n[sent] + n[s] - shared)].tolist():
                    if c[x] != c[s]:
                        out.append((doc[x], doc[s], True, False))
                        c[c == c[x]] = c[s]
            rest = at[~short[at]] if short[s] else at
            rest = rest[c[rest] != c[s]]
            out += [(doc[x], doc[s], False, len(rest) > nearest) for x in rest[:nearest].tolist()]
        a, b, sure, more = zip(*out) if out else ((), (), (), ())
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64()), "sure": pa.array(sure, pa.bool_()), "more": pa.array(more, pa.bool_())})

    return whole.groupBy("band", "row", "column").applyInArrow(compare, "a long, b long, sure boolean, more boolean")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, component) after further links: components of the components, so the work follows the links."""
    ends = links.join(labels.select(F.col("node").alias("a"), F.col("component").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("component").alias("y")), "b")
    further = components(ends.where("x != y").select("x", "y").distinct(), "x", "y").select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut(labels.join(further, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def near_duplicates(docs: DataFrame, scheme: Scheme = Scheme(), text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id) of every row of ``docs``.

    Two texts are linked if their sets of distinct ``k``-word shingles have a Jaccard similarity of
    ``percent`` / 100 or more; component_id is the smallest doc_id reachable by links. Null texts and texts
    without words have n_shingles 0 and are linked with nothing. Repeated rows of one doc_id each get a
    row; if their texts differ, each row follows its own text. A row with a null doc_id follows its text too, with kept null; where all
    rows of a text have null ids, it takes no part in linking and component_id is null. Ids may be of any type that has an order. Other columns are not read.
    """
    return grouped(docs, scheme, text).drop("text_hash")


def without_copies(docs: DataFrame, scheme: Scheme = Scheme(), text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, but those that are not kept: of an id with several texts only the copies go.
    Rows with null ids and repeated rows of a kept document stay."""
    one, other = fresh(docs, "_gone_id"), fresh(docs, "_gone_hash")
    gone = grouped(docs, scheme, text).where("not kept").select(F.col("doc_id").alias(one), F.col("text_hash").alias(other)).distinct()
    here = (F.col("doc_id") == F.col(one)) & (F.xxhash64(text) == F.col(other))
    return docs.join(gone, here, "left_anti")


def grouped(docs: DataFrame, scheme: Scheme, text: str) -> DataFrame:
    """As near_duplicates, with text_hash, which tells the texts of one doc_id apart."""
    base = cut(sketched(docs, scheme, text))
    full = base.where("fp is not null")
    sets = full.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("doc_id"))
    reps = full.join(sets, ["fp", "doc_id"]).dropDuplicates(["fp"]).withColumn("node", F.monotonically_increasing_id())
    reps = cut(reps.select("node", "fp", "doc_id", "text_hash", "n_shingles", "sketch", "filled", "bands"))
    texts = _Texts(docs, text, reps.select("node", "doc_id", "text_hash"))
    sketches = reps.select("node", "n_shingles", "sketch", "filled")
    bands = reps.select("node", F.explode("bands").alias("band"))
    pivots = bands.groupBy("band").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    bands = cut(bands.join(pivots, "band").select("band", "node", "a"))
    pairs = bands.where("node != a").select("a", F.col("node").alias("b")).distinct()
    with_sketches = pairs.join(sketches.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"), F.col("filled").alias("eb")), "b").join(
        sketches.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"), F.col("filled").alias("ea")), "a"
    )
    stars = cut(confirmed(cut(_sketch_filter(with_sketches, scheme)), texts, scheme))
    labels = cut(reps.select("node").join(components(stars), "node", "left").select("node", F.coalesce("component", "node").alias("component")))
    members = reps.select("node", "n_shingles", "sketch", "filled", F.transform("bands", lambda b: F.shiftright(b, 32).cast("int")).alias("keys"))
    nearest, again = 4, False
    while True:
        offered = cut(_residual(bands.select("band", "node"), members, labels, texts, scheme, nearest, again))
        found, open_pairs = offered.where("sure").select("a", "b"), offered.where("not sure").select("a", "b").distinct()
        if not open_pairs.isEmpty():
            found = cut(found.unionByName(confirmed(open_pairs, texts, scheme)))
        if not found.isEmpty():
            labels = _joined(labels, found)
        if offered.where("more").isEmpty():
            break
        nearest, again = nearest * 16, True
    # A component is named by the smallest doc_id of its nodes; nodes alone name themselves.
    named = reps.select("fp", "node", "doc_id").join(labels, "node")
    moved = named.where("node != component").select("component", "doc_id")
    roots = named.join(moved.select("component").distinct(), "component", "left_semi").where("node = component").select("component", "doc_id")
    smallest = moved.unionByName(roots).groupBy("component").agg(F.min("doc_id").alias("smallest"))
    names = named.join(smallest, "component", "left").select("fp", F.coalesce("smallest", "doc_id").alias("component_id"))
    alone = base.where("fp is null").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    linked = full.select("doc_id", "text_hash", "n_shingles", "fp").join(names, "fp", "left").select("doc_id", "text_hash", "n_shingles", "component_id")
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id") == F.col("component_id"))
