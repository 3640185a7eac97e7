"""Vector compression by product codes, with annular norm pruning.

Vectors of integer components are cut into equal parts; each part position has a codebook, and a vector's code is the nearest
entry of each. Codebooks are learnt by rounds of assignment and means: every round is one narrow pass over the vectors, of which only the
sums of each entry leave a task. The nearest entry is found by norms: entries are sorted by norm; an entry at a distance d of a vector
has a norm within d of the vector's, so from the entry nearest in norm on, the interval that the best distance so far
allows is found by binary search, and only entries in that annulus, its borders included, are compared exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, joined_back, ship

#: Components beyond this size (values beyond 2 ** 28 at scale 4,096) count as of this size, so that sums fit decimals of 38 digits.
LARGEST = 1 << 40
#: Up to this size distances are computed in 64 bits, beyond it with unbounded integers.
_NARROW = 1 << 24
#: Vectors taken at a time.
ROWS = 8_192
LONG = (1 << 63) - 1


@dataclass(frozen=True)
class Scheme:
    """``parts`` codebooks of ``entries`` each, learnt in ``rounds``; a component x becomes floor(``scale`` * x)."""

    parts: int = 8
    entries: int = 16
    rounds: int = 6
    scale: int = 4096


@dataclass(frozen=True)
class Codebooks:
    """``books`` [part, entry, place], integers; the entries are fewer where the table has fewer vectors."""

    books: np.ndarray
    scheme: Scheme

    @property
    def width(self) -> int:
        return self.books.shape[2]

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and place."""
        return hashlib.sha256(",".join(map(str, self.books.reshape(-1).tolist())).encode()).hexdigest()


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are finite."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))


def integers(values: np.ndarray, scheme: Scheme) -> np.ndarray:
    """floor(scale * x), in 64 bits where they hold all distances, else unbounded."""
    whole = np.clip(np.floor(scheme.scale * values), -LARGEST, LARGEST).astype(np.int64)
    return whole if len(whole) == 0 or np.abs(whole).max() <= _NARROW else whole.astype(object)


def rows_of(column: pa.Array, size: int, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable vectors, their integers [place, vector]), shorter vectors filled up with zeros to ``size``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(column)), length)
    good = column.is_valid().to_numpy(zero_copy_only=False)
    good[owner[~np.isfinite(flat)]] = False
    place = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
    dense = np.zeros((size, len(column)))
    mine = good[owner]
    dense[place[mine], owner[mine]] = flat[mine]
    kept = np.flatnonzero(good)
    return kept, integers(dense[:, kept], scheme)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of the entry of ``book`` [entry, place] nearest to each column of ``x`` [place, vector]; ties go to the lower entry."""
    if x.dtype == object or len(book) and book.size and np.abs(book).max() > _NARROW:
        x, book = x.astype(object), book.astype(object)
    squares = (book * book).sum(1)
    order = np.argsort(squares.astype(np.float64), kind="stable")
    norms = np.sqrt(squares[order].astype(np.float64))
    r = np.sqrt((x * x).sum(0).astype(np.float64))

    def distance(entry: int, of: np.ndarray) -> np.ndarray:
        total = np.zeros(of.shape[1], of.dtype)
        for j, c in enumerate(book[entry].tolist()):
            d = of[j] - c
            total += d * d
        return total

    def annulus(of: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        reach = np.sqrt(best.astype(np.float64))
        slack = 1e-9 * (of + reach)  # beyond what rounding can hide
        return np.searchsorted(norms, of - reach - slack, "left"), np.searchsorted(norms, of + reach + slack, "right")

    right = np.clip(np.searchsorted(norms, r), 1, max(len(book) - 1, 1))
    start = np.minimum(np.where(r - norms[right - 1] <= norms[np.minimum(right, len(book) - 1)] - r, right - 1, right), len(book) - 1)
    entry, best = order[start], np.zeros(x.shape[1], x.dtype)
    for k in np.unique(start).tolist():
        mine = np.flatnonzero(start == k)
        best[mine] = distance(order[k], x[:, mine])
    low, high = annulus(r, best)
    for k in range(len(book)):
        mine = np.flatnonzero((low <= k) & (k < high) & (start != k))
        if not len(mine):
            continue
        d = distance(order[k], x[:, mine])
        better = (d < best[mine]) | (d == best[mine]) & (order[k] < entry[mine])
        mine, d = mine[better], d[better]
        best[mine], entry[mine] = d, order[k]
        low[mine], high[mine] = annulus(r[mine], d)
    return entry, best


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def train(vectors: DataFrame, scheme: Scheme = Scheme(), vec_id: str = "vec_id", vector: str = "embedding") -> Codebooks:
    """Codebooks of all usable vectors.

    They start as the parts of the vectors of the smallest ids (null ids last, equal ids by their components). Each round assigns every part to
    its nearest entry and makes each entry the mean of its parts, rounded down; entries without parts stay.
    """
    ship(vectors.sparkSession)
    good = vectors.where(usable(vector)).select(F.col(vec_id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    longest = good.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // scheme.parts)
    size = width * scheme.parts
    seeds = [r.v for r in good.orderBy(F.col("id").asc_nulls_last(), "v").limit(scheme.entries).collect()]
    first = np.zeros((len(seeds), size))
    for i, v in enumerate(seeds):
        first[i, : len(v)] = v
    books = integers(first, scheme).astype(object).reshape(len(seeds), scheme.parts, width).transpose(1, 0, 2)
    if not len(seeds):
        return Codebooks(books, scheme)
    for _ in range(scheme.rounds):
        books = _moved(vectors, Codebooks(books, scheme), vector)
    return Codebooks(books, scheme)


def _compact(books: np.ndarray) -> np.ndarray:
    """As 64 bits where distances fit them."""
    return books.astype(np.int64) if not books.size or max(abs(int(books.max())), abs(int(books.min()))) <= _NARROW else books


def _moved(vectors: DataFrame, codebooks: Codebooks, vector: str) -> np.ndarray:
    """The entries after one round: a task gives one sum per component and one count per entry, Spark adds them up."""
    scheme, width = codebooks.scheme, codebooks.width
    shared = vectors.sparkSession.sparkContext.broadcast(_compact(codebooks.books))
    entries = codebooks.books.shape[1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        total = np.zeros((scheme.parts, entries, width + 1), object)
        for b in _pieces(batches):
            kept, x = rows_of(b.column("v"), width * scheme.parts, scheme)
            for p in range(scheme.parts):
                part = x[p * width : (p + 1) * width]
                entry, _ = nearest(part, books[p])
                order = np.argsort(entry, kind="stable")
                found, first, n = np.unique(entry[order], return_index=True, return_counts=True)
                total[p, found, width] += n
                if len(found) and width:
                    total[p, found, :width] += np.add.reduceat(part[:, order], first, axis=1).T
        slots = np.flatnonzero(total.reshape(-1) != 0)
        sums = [Decimal(int(v)) for v in total.reshape(-1)[slots]]
        yield pa.RecordBatch.from_arrays([pa.array(slots, pa.int64()), pa.array(sums, pa.decimal128(38, 0))], ["slot", "total"])

    sums = np.zeros((scheme.parts, entries, width + 1), object)
    flat = sums.reshape(-1)
    rows = vectors.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "slot long, total decimal(38,0)")
    for r in rows.groupBy("slot").agg(F.sum("total").alias("total")).collect():
        flat[r.slot] = int(r.total)
    books = codebooks.books.copy()
    used = sums[:, :, width] > 0
    books[used] = sums[used][:, :width] // sums[used][:, width:]
    return books


def encode(vectors: DataFrame, codebooks: Codebooks, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code (two hexadecimal digits per part; four beyond 256 entries) and error (the squared distances of all parts, at most the largest long) of every usable vector."""
    ship(vectors.sparkSession)
    scheme, width = codebooks.scheme, codebooks.width
    shared = vectors.sparkSession.sparkContext.broadcast(_compact(codebooks.books))
    digits = 2 if scheme.entries <= 256 else 4

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for b in _pieces(batches):
            kept, x = rows_of(b.column("v"), width * scheme.parts, scheme)
            error, code = np.zeros(len(kept), object), [""] * len(kept)
            if len(kept):
                for p in range(scheme.parts):
                    entry, d = nearest(x[p * width : (p + 1) * width], books[p])
                    error += d
                    code = [c + f"{e:0{digits}x}" for c, e in zip(code, entry.tolist())]
            at = pa.array(kept, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("id").take(at), b.column("label").take(at), pa.array(code, pa.string()), pa.array([min(int(e), LONG) for e in error], pa.int64())], ["id", "label", "code", "error"])

    rows = vectors.select(F.col(vec_id).alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    types = [vectors.schema[c].dataType.simpleString() for c in (vec_id, label)]
    return rows.mapInArrow(run, f"id {types[0]}, label {types[1]}, code string, error long").toDF(vec_id, label, "code", "error")


def decode(codes: DataFrame, codebooks: Codebooks, code: str = "code") -> DataFrame:
    """``codes`` with ``approximation``, the components that a code stands for, divided by the scale; null for a null code."""
    scheme, digits = codebooks.scheme, 2 if codebooks.scheme.entries <= 256 else 4
    books = F.lit([[[float(v) / scheme.scale for v in e] for e in b] for b in codebooks.books.tolist()])
    part = lambda p: books[p][F.conv(F.substring(code, digits * p + 1, digits), 16, 10).cast("int")]
    return codes.withColumn("approximation", F.when(F.col(code).isNotNull(), F.flatten(F.array(*(part(p) for p in range(scheme.parts))))))


def compress(vectors: DataFrame, scheme: Scheme = Scheme(), vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error (the errors of all vectors of the label, null being one) and codebooks_sha256 of every usable vector.

    Vectors that are null or hold null or non-finite components are left out. Components are integers floor(scale * x). All vectors are as
    long as the longest, filled up to whole parts with zeros; an empty one is all zeros. Rows of a null or repeated id are coded as any other. With
    fewer vectors than entries the codebooks have fewer; without any the result is empty.
    """
    codebooks = train(vectors, scheme, vec_id, vector)
    coded = cut(encode(vectors, codebooks, vec_id, vector, label).toDF("id", "label", "code", "error"))
    summed = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")
    groups = coded.groupBy("label").agg(F.count(F.lit(1)).alias("n"), summed.alias("label_error"))
    out = joined_back(coded, groups, "label").withColumn("codebooks_sha256", F.lit(codebooks.digest()))
    return out.select("id", "label", "code", "error", "label_error", "codebooks_sha256").toDF(vec_id, label, "code", "error", "label_error", "codebooks_sha256")
