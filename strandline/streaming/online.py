"""Streaming forms of the panel's online state, and event-time windows."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.functions.shipping import ship


def event_windows(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums per event type in tumbling or sliding windows; rows later than ``late`` are left out.

    ``ts`` is read as an instant, as watermarks need one.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    return timed.groupBy(span, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions per user: events no more than ``gap`` apart."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = "10 minutes") -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).dropDuplicatesWithinWatermark(list(keys))


@dataclass(frozen=True)
class Recursion:
    """A state per key that rows change one by one: ``advance(memory, values)`` gives (memory, output); ``memory`` is a list of doubles, empty at first, and
    ``values`` are the row's ``inputs``, None where missing."""

    inputs: tuple[str, ...]
    output: str
    advance: Callable[[list[float], tuple], tuple[list[float], float | None]]


def smoothing(x: str, alpha: float, output: str = "smoothed") -> Recursion:
    """Exponential smoothing; missing values keep the state."""

    def advance(memory: list[float], values: tuple) -> tuple[list[float], float | None]:
        v = values[0]
        if v is not None:
            memory = [alpha * v + (1 - alpha) * memory[0] if memory else v]
        return memory, memory[0] if memory else None

    return Recursion((x,), output, advance)


def hits(prediction: str, outcome: str, n: int = 63, output: str = "hit_ratio") -> Recursion:
    """The share of hits among the last ``n`` settled predictions before each row: a ring of ``n`` with its sum, so a row costs the same whatever ``n``."""

    def advance(memory: list[float], values: tuple) -> tuple[list[float], float | None]:
        if not memory:
            memory = [0.0, 0.0]  # sum, settled so far; then the ring
        held = len(memory) - 2
        ratio = memory[0] / held if held else None
        p, y = values
        if p is not None and y is not None:
            hit, at = float((p > 0) == (y > 0)), 2 + int(memory[1]) % n
            if held < n:
                memory.append(hit)
                memory[0] += hit
            else:
                memory[0] += hit - memory[at]
                memory[at] = hit
            memory[1] += 1
        return memory, ratio

    return Recursion((prediction, outcome), output, advance)


_STATE = "memory array<double>, times array<long>, waiting array<double>"


def _advanced(op: Recursion, memory: list[float], rows: list[tuple]) -> tuple[list[float], list[tuple[int, float | None]]]:
    """The outputs of rows (time, values...) taken in their order; NaN counts as missing."""
    out = []
    for us, *values in rows:
        memory, value = op.advance(memory, tuple(None if v is None or v != v else v for v in values))
        out.append((us, value))
    return memory, out


def ordered(rows: DataFrame, op: Recursion, key: str = "ticker", time: str = "date", late: str = "10 minutes") -> DataFrame:
    """key, time and the recursion's output of a stream's rows, in the order of their event time across micro-batches.

    A row waits in its key's state until the watermark, ``late`` behind the latest row, has passed it; a timer releases the rows of keys that receive nothing
    more. Rows later than that are left out. What still waits when a stream ends is read by ``drained``. ``time`` is a timestamp; a key's rows of one time
    are taken in the order of their values.
    """
    width = len(op.inputs)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, waiting = [], []
        if state.exists:
            kept, times, values = state.get
            memory, values = list(kept), list(values)
            waiting = [(int(t), *values[i * width : (i + 1) * width]) for i, t in enumerate(times)]
        mark = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            for f in frames:
                waiting += [r for r in f[["us", *(f"v{i}" for i in range(width))]].itertuples(index=False, name=None) if r[0] // 1000 > mark]
        waiting.sort(key=lambda r: (r[0], *((v is None or v != v, v) for v in r[1:])))
        ready = bisect.bisect_left(waiting, True, key=lambda r: r[0] // 1000 > mark)
        memory, out = _advanced(op, memory, waiting[:ready])
        waiting = waiting[ready:]
        state.update((memory, [int(r[0]) for r in waiting], [float("nan") if v is None else float(v) for r in waiting for v in r[1:]]))
        if waiting:
            state.setTimeoutTimestamp(max(int(waiting[0][0]) // 1000, mark + 1))
        if out:
            yield pd.DataFrame({"key": k[0], "us": [u for u, _ in out], "value": pd.Series([v for _, v in out], dtype=float)})

    ship(rows.sparkSession)
    kind = dict(rows.dtypes)[key]
    timed = rows.withWatermark(time, late).select(F.col(key).alias("key"), F.col(time), F.unix_micros(time).alias("us"), *(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(op.inputs)))
    done = timed.groupBy("key").applyInPandasWithState(step, f"key {kind}, us long, value double", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return _named(done, op, key, time)


def drained(spark: SparkSession, checkpoint: str, op: Recursion, key: str = "ticker", time: str = "date") -> DataFrame:
    """The outputs of the rows that still waited when the stream of ``checkpoint`` ended, read from its state; at most what came within ``late`` of the end."""
    width = len(op.inputs)
    stored = spark.read.format("statestore").load(checkpoint).select(F.col("key.key").alias("key"), F.col("value.groupState.*")).where(F.size("times") > 0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            for k, memory, times, values in f.itertuples(index=False):
                rows = [(int(t), *values[i * width : (i + 1) * width]) for i, t in enumerate(times)]
                out = _advanced(op, list(memory), rows)[1]
                yield pd.DataFrame({"key": k, "us": [u for u, _ in out], "value": pd.Series([v for _, v in out], dtype=float)})

    ship(spark)
    return _named(stored.mapInPandas(run, f"key {dict(stored.dtypes)['key']}, us long, value double"), op, key, time)


def _named(done: DataFrame, op: Recursion, key: str, time: str) -> DataFrame:
    return done.select(F.col("key").alias(key), F.timestamp_micros("us").alias(time), F.col("value").alias(op.output))


def into_files(stream: DataFrame, folder: str, mode: str = "append", name: str = "result") -> DataFrame:
    """Run a stream to the end of what its source holds; its rows, written by the tasks to ``folder`` (one that all share) a folder per micro-batch.

    A batch that is run again writes its folder anew, so no row is doubled. In mode ``complete`` the last batch is the result. The checkpoint is ``folder``/checkpoint.
    """
    spark, written = stream.sparkSession, f"{folder}/{name}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{written}/batch={number}")

    running = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode).trigger(availableNow=True).start()
    running.awaitTermination()
    if running.exception():
        raise running.exception()
    try:
        rows = spark.read.parquet(written)
    except AnalysisException:  # a stream without input writes no batch
        return spark.createDataFrame([], stream.schema)
    if mode == "complete":
        rows = rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0])
    return rows.drop("batch")


def online_smoothing(rows: DataFrame, x: str, alpha: float, key: str = "ticker", time: str = "date") -> DataFrame:
    """key, time, smoothed, with no delay: rows of one micro-batch are taken in the order of ``time`` (any type), micro-batches as they come; see
    ``ordered`` for the order of event time across them. Missing values keep the state, which is kept per key between micro-batches."""
    kind, op = dict(rows.dtypes), smoothing(x, alpha)

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory = list(state.get[0]) if state.exists else []
        f = pd.concat(list(frames)).sort_values(time)
        memory, out = _advanced(op, memory, list(zip(range(len(f)), f[x])))
        state.update((memory,))
        yield pd.DataFrame({key: k[0], time: f[time].to_numpy(), "smoothed": pd.Series([v for _, v in out], dtype=float)})

    ship(rows.sparkSession)
    return rows.select(key, time, x).groupBy(key).applyInPandasWithState(step, f"{key} {kind[key]}, {time} {kind[time]}, smoothed double", "memory array<double>", "append", GroupStateTimeout.NoTimeout)
