"""Exact top-k search of binary codes by incremental multi-index hashing.

Vectors are made binary by sign. Every partition of the indexed rows cuts its codes into segments of about
log2(rows) bits and keeps one table per segment. A query looks up its own segments, then all segments that
differ in one bit, in two, and so on; after radius r in all m segments, every code at a distance below
m * (r + 1) has been met, so the search of a query stops as soon as its kth verified distance lies below that.

The rows are searched in rounds: first as many as one partition holds, then four times as many, and so on. The kth
distance after a round is sent along to the next one, which gives only what is as near: about 4 k rows a query and
round, however many partitions there are, not k from each. Queries are sent to the tasks in blocks of
bounded size; the indexed rows are never exchanged.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut, ship

#: Queries sent to the tasks at a time, and answered together within a task.
QUERIES_AT_ONCE, TOGETHER = 200_000, 16
#: Times more rows that a round searches than the one before.
GROWTH = 4


def binary_codes(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes [row, byte], which rows have one): bit i is set if component i is above 0 (null and NaN are not)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    has = size == bits
    values = pa.compute.list_flatten(lists.filter(pa.array(has))).cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.packbits(np.nan_to_num(values, nan=0.0).reshape(-1, bits) > 0, 1), has


class SegmentIndex:
    """Tables of one partition's codes."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        order = np.lexsort((*codes.T[::-1], ids))
        ids, codes = ids[order], codes[order]
        first = np.append(True, (ids[1:] != ids[:-1]) | (codes[1:] != codes[:-1]).any(1)) if len(ids) else np.zeros(0, bool)
        self.ids, self.codes = ids[first], codes[first]
        bits = codes.shape[1] * 8
        width = max(1, min(16, int(np.log2(max(len(self.ids), 2)))))
        self.m = -(-bits // width)
        cuts = np.linspace(0, bits, self.m + 1).astype(int)
        self.parts = [(a, b - a) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        self.tables = []
        for part, (_, w) in zip(self.segments(self.codes).T, self.parts):
            at = np.argsort(part, kind="stable")
            self.tables.append((at, np.searchsorted(part[at], np.arange((1 << w) + 1))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    def segments(self, codes: np.ndarray) -> np.ndarray:
        bits = np.unpackbits(codes, 1).astype(np.int64)
        return np.stack([bits[:, a : a + w] @ (1 << np.arange(w - 1, -1, -1)) for a, w in self.parts], 1) if len(codes) else np.zeros((0, self.m), np.int64)

    def mask(self, width: int, radius: int) -> np.ndarray:
        key = width, radius
        if key not in self.masks:
            self.masks[key] = np.array([sum(1 << i for i in c) for c in combinations(range(width), radius)], np.int64)
        return self.masks[key]

    def search(self, ids: np.ndarray, codes: np.ndarray, k: int, bounds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, distance): of each query the k nearest other ids by (distance, id), those beyond its bound left out."""
        out: list[tuple[np.ndarray, ...]] = []
        parts = self.segments(codes)
        n, span = max(len(self.ids), 1), self.codes.shape[1] * 8 + 1
        repeated = bool((self.ids[1:] == self.ids[:-1]).any())
        for a in range(0, len(ids), TOGETHER):
            open_rows = np.arange(a, min(a + TOGETHER, len(ids)))
            # Query, distance and code row in one number; rows are in the order of their ids.
            found = np.zeros(0, np.int64)
            kth = np.full(TOGETHER, span)
            if bounds is not None:
                kth[: len(open_rows)] = np.minimum(bounds[open_rows], span)
            radius = 0
            while len(open_rows):
                q, hit = self._probe(parts[open_rows], open_rows, radius)
                distance = np.bitwise_count(codes[q] ^ self.codes[hit]).sum(1, dtype=np.int64)
                ok = (distance <= kth[q - a]) & (self.ids[hit] != ids[q])
                found = np.unique(np.concatenate([found, ((q[ok] - a) * span + distance[ok]) * n + hit[ok]]))
                row = found // (n * span)
                if repeated:  # of an id with several codes the nearest counts
                    order = np.lexsort((found, self.ids[found % n], row))
                    i, r = self.ids[found[order] % n], row[order]
                    found = np.sort(found[order[np.append(True, (i[1:] != i[:-1]) | (r[1:] != r[:-1]))[: len(order)]]])
                    row = found // (n * span)
                keep = np.arange(len(found)) - np.searchsorted(row, row) < k
                found, row = found[keep], row[keep]
                counts = np.bincount(row, minlength=TOGETHER)
                full = np.flatnonzero(counts >= k)
                kth[full] = np.minimum(kth[full], found[np.cumsum(counts)[full] - 1] // n % span)
                covered = self.m * (radius + 1)
                over = (kth[open_rows - a] < covered) | (radius >= max(w for _, w in self.parts))
                open_rows = open_rows[~over]
                radius += 1
            out.append((found // (n * span) + a, self.ids[found % n], found // n % span))
        return tuple(map(np.concatenate, zip(*out))) if out else (np.zeros(0, np.int64),) * 3

    def _probe(self, parts: np.ndarray, rows: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query row, code row) of all codes of which a segment differs from the query's in exactly ``radius`` bits."""
        qs, hits = [], []
        for s, ((_, w), (at, stops)) in enumerate(zip(self.parts, self.tables)):
            if radius > w:
                continue
            keys = (parts[:, s, None] ^ self.mask(w, radius)[None]).ravel()
            start, count = stops[keys], stops[keys + 1] - stops[keys]
            some = np.flatnonzero(count)
            start, count = start[some], count[some]
            shift = np.repeat(start - np.append(0, np.cumsum(count)[:-1]), count)
            hits.append(at[np.arange(len(shift)) + shift])
            qs.append(np.repeat(rows[some // len(self.mask(w, radius))], count))
        return (np.concatenate(qs), np.concatenate(hits)) if qs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass(frozen=True)
class _Block:
    ids: np.ndarray
    codes: np.ndarray
    bounds: np.ndarray


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", key: str = "vec_id", bits: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, distance: of each row that fulfils ``is_query`` the ``k`` rows of the
    smallest Hamming distance, ties by the smaller id, the query itself left out.

    ``bits`` is the dimension of the vectors, by default the commonest one (of equally common ones the largest).
    Vectors that are null, empty or of another dimension have no code: they are not found and find
    nothing. Rows with a null id are left out. A repeated id counts once, at its nearest code, and as a query by each of
    its distinct codes together. With fewer than ``k`` other ids all are returned; an empty table gives none. Other columns are not read.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).alias("embedding"), is_query.alias("q")).where("vec_id is not null")
    if bits is None:
        sizes = rows.groupBy(F.size("embedding").alias("bits")).agg(F.count(F.lit(1)).alias("n")).where("bits > 0")
        bits = sizes.agg(F.max_by("bits", F.struct("n", "bits"))).first()[0] or 0

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for b in batches:
            codes, has = binary_codes(b.column("embedding"), bits)
            keep = pa.array(has)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").filter(keep), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("q").filter(keep), pa.array(np.arange(turn, turn + len(codes)))], ["vec_id", "code", "q", "turn"]
            )
            turn += len(codes)

    coded = cut((rows if bits > 0 else rows.limit(0)).mapInArrow(encode, "vec_id long, code binary, q boolean, turn long"))
    parts = coded.select(F.spark_partition_id()).distinct().count()
    queries = coded.where("q").select("vec_id", "code").distinct()
    blocks = queries.count() // QUERIES_AT_ONCE + 1
    out = None
    for i in range(blocks):
        mine = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == i)
        part = _searched(coded, mine, k, parts)
        out = part if out is None else out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "distance")


def _searched(coded: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """The answers to one block of queries, in rounds over ever more rows; each round's rows are new."""
    got = sorted(queries.collect())
    ids = np.array([r.vec_id for r in got], np.int64)
    codes = np.frombuffer(b"".join(bytes(r.code) for r in got), np.uint8).reshape(len(got), -1) if got else np.zeros((0, 1), np.uint8)
    bounds = np.full(len(ids), np.iinfo(np.int64).max)
    best, step = None, 1
    while step < parts:
        step *= GROWTH
    top = step
    while True:
        rows = coded if top == 1 else coded.where((F.col("turn") % step == 0) & (F.lit(step == top) | (F.col("turn") % (step * GROWTH) != 0))).coalesce(max(1, -(-parts // step)))
        found = _probed(rows, _Block(ids, codes, bounds), k)
        found = found if best is None else best.select("query_id", "vec_id", "distance").unionByName(found)
        nearest = found.groupBy("query_id", "vec_id").agg(F.min("distance").alias("distance"))
        best = nearest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))).where(F.col("rank") <= k)
        if step == 1:
            return best
        best = cut(best)
        kth = {r.query_id: r.distance for r in best.where(F.col("rank") == k).collect()}  # one row a query
        bounds = np.array([kth.get(i, np.iinfo(np.int64).max) for i in ids.tolist()], np.int64)
        step //= GROWTH


def _probed(rows: DataFrame, block: _Block, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = shared.value
        parts = [b for b in batches if b.num_rows]
        if not parts or not len(asked.ids):
            return
        own = np.concatenate([b.column("vec_id").to_numpy(zero_copy_only=False) for b in parts])
        own_codes = np.concatenate([np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(b.num_rows, -1) for b in parts])
        index = SegmentIndex(own, own_codes)
        for a in range(0, len(asked.ids), 4_096):
            q, found, distance = index.search(asked.ids[a : a + 4_096], asked.codes[a : a + 4_096], k, asked.bounds[a : a + 4_096])
            yield pa.RecordBatch.from_arrays([pa.array(asked.ids[a + q]), pa.array(found), pa.array(distance)], ["query_id", "vec_id", "distance"])

    return rows.select("vec_id", "code").mapInArrow(run, "query_id long, vec_id long, distance long")
