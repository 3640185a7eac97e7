"""Sharding by histogram sort, in DataFrame operations alone.

Rows are ordered by the key (text hash, id hash), so equal texts are neighbours, yet a group of equal
texts of any size can be cut between two of its ids. Splitters are found by probing: each round counts,
over all partitions at once, the exact bytes below equally spaced candidate keys inside every interval
that still holds a wanted splitter, and keeps the interval around each target, until the splitter meets
the tolerance or the interval holds one key. Only these counts reach the driver, at most ``PROBES`` + 1 a splitter and round.
Then the rows are exchanged once, by fine range within their shard, to be numbered there; the ranges and where each begins in its
shard are a table that stays on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import cut

PROBES = 256
#: Rows that one fine range is meant to hold; ranges of over four times as many (copies of one text) are dealt over several.
RANGE_ROWS = 20_000
#: Such ranges that may be broadcast; more are joined by exchange.
BROADCAST_RANGES = 100_000
KEY = ("h", "d")


@dataclass(frozen=True)
class _Span:
    """Keys from ``low`` to ``high``, both within; ``below`` bytes come before."""

    low: tuple[int, ...]
    high: tuple[int, ...]
    below: int
    inside: int


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size (UTF-8 bytes + 1; null text: 1), text_crc32 (of the UTF-8; null: of nothing), the sort key,
    ``h`` of the text and ``d`` of the id (of any type), and ``turn``, the row's place among the partitions read."""
    t = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(t), 1).alias("h"),
        F.shiftrightunsigned(F.xxhash64(F.col(doc_id).cast("string")), 1).alias("d"),
        F.monotonically_increasing_id().alias("turn"),
    )


def _key(values: tuple[int, ...] | None = None) -> Column:
    return F.struct(*(F.col(k) if values is None else F.lit(v).cast("long").alias(k) for k, v in zip(KEY, values or KEY)))


def find_splitters(rows: DataFrame, targets: list[int], tolerance: int) -> list[tuple[int, ...]]:
    """For each target the first key of the range after it: bytes before that key are within ``tolerance`` of
    the target, or as near as one key allows."""
    total = rows.agg(F.min(_key()), F.max(_key()), F.sum("size")).first()
    whole = _Span(tuple(total[0]), tuple(total[1]), 0, int(total[2]))
    found: dict[int, tuple[int, ...]] = {}
    open_spans = {i: whole for i in range(len(targets))}
    while open_spans:
        spans = sorted(set(open_spans.values()), key=lambda s: s.low)
        bins = _count(rows, spans)
        for i, span in list(open_spans.items()):
            below, at = span.below, span
            for low, high, inside in bins[span.low]:
                at = _Span(low, high, below, inside)
                if below + inside >= targets[i]:
                    break
                below += inside
            end = at.below + at.inside
            near_low, near_end = targets[i] - at.below, end - targets[i]
            if min(near_low, near_end) <= tolerance or at.low == at.high:
                found[i] = (*at.high[:-1], at.high[-1] + 1) if near_end < near_low else at.low
                del open_spans[i]
            else:
                open_spans[i] = at
    return [found[i] for i in range(len(targets))]


def _count(rows: DataFrame, spans: list[_Span]) -> dict[tuple[int, ...], list[tuple]]:
    """Exact bytes, and the first and last key, of every bin of every span that has rows. Spans are apart, at most one a target."""
    which, bin_ = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, s in enumerate(spans):
        level = next((k for k in range(len(KEY)) if s.low[k] != s.high[k]), len(KEY) - 1)
        step = (s.high[level] - s.low[level]) // PROBES + 1
        inside = (_key() >= _key(s.low)) & (_key() <= _key(s.high))
        which = F.when(inside, i).otherwise(which)
        bin_ = F.when(inside, F.expr(f"({KEY[level]} - {s.low[level]}L) div {step}L")).otherwise(bin_)
    placed = rows.select(which.alias("span"), bin_.alias("bin"), *KEY, "size").where("span is not null")
    got = placed.groupBy("span", "bin").agg(F.min(_key()).alias("first"), F.max(_key()).alias("last"), F.sum("size").alias("bytes")).collect()
    out: dict[tuple[int, ...], list[tuple]] = {s.low: [] for s in spans}
    for r in sorted(got, key=lambda r: (r.span, r.bin)):
        out[spans[r.span].low].append((tuple(r["first"]), tuple(r["last"]), int(r.bytes)))
    return out


def shard(docs: DataFrame, shards: int = 8, tolerance: float = 0.001, text: str = "text", doc_id: str = "doc_id", range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law 'bytes', shard 0..shards-1, slot (gapless from 0 in each shard), grown_shard null.

    Shards are near equal in bytes: every splitter lies within ``tolerance`` of a shard's share, or as near
    as one key allows. Equal texts are neighbours and share a shard but where a splitter falls among them; rows equal in
    text and doc_id share a key and a shard. A null doc_id is an id like another. Without rows the result is empty. Other columns of ``docs`` are not read.
    """
    rows = cut(keyed(docs, text, doc_id))
    n, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    splitters = find_splitters(rows, [total * i // shards for i in range(1, shards)], int(total * tolerance / shards)) if n else []
    of = sum(((_key() >= _key(s)).cast("int") for s in splitters), F.lit(0))
    bits = max(0, (n // range_rows).bit_length())
    placed = rows.withColumns({"shard": of, "range": F.shiftright("h", 63 - bits)})
    sizes = placed.groupBy("shard", "range").agg(F.count(F.lit(1)).alias("n"))
    large = cut(sizes.where(F.col("n") > 4 * range_rows).select("shard", "range", F.ceil(F.col("n") / range_rows).alias("parts")))
    dealt = placed.join(F.broadcast(large) if large.count() <= BROADCAST_RANGES else large, ["shard", "range"], "left")
    dealt = dealt.withColumn("part", F.coalesce(F.pmod(F.xxhash64("turn"), F.col("parts")), F.lit(0).cast("long"))).drop("parts")
    # One row a fine range: how many rows of the shard come before it.
    counts = dealt.groupBy("shard", "range", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("range", "part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "range", "part", F.coalesce(before, F.lit(0)).alias("start"))
    order = Window.partitionBy("shard", "range", "part").orderBy(*KEY, "turn")
    return (
        dealt.withColumn("rank", F.row_number().over(order))
        .join(starts, ["shard", "range", "part"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )
