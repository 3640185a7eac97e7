"""Streams: order of event time across micro-batches, timers, what waits at the end, and files as sink."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.streaming import online

BEGIN = dt.datetime(2024, 1, 1)


def stream_of(spark, folder, batches):
    """A stream that reads one list of (key, minute, a, b) per micro-batch."""
    schema = "ticker string, date timestamp, a double, b double"
    for i, rows in enumerate(batches):
        spark.createDataFrame([(k, BEGIN + dt.timedelta(minutes=m), a, b) for k, m, a, b in rows], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for f in (folder / "in").glob("part-*.parquet"):
            f.rename(folder / "in" / f"batch-{i:03}.parquet")
            import os

            os.utime(folder / "in" / f"batch-{i:03}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/batch-*.parquet")


def run(spark, tmp_path, batches, op, late="30 minutes"):
    stream = online.ordered(stream_of(spark, tmp_path, batches), op, late=late)
    rows = online.into_files(stream, str(tmp_path / "out"))
    waited = online.drained(spark, str(tmp_path / "out" / "checkpoint"), op)
    both = [(r.ticker, int((r.date - BEGIN).total_seconds() // 60), r[op.output]) for r in rows.unionByName(waited).collect()]
    assert len(both) == len({r[:2] for r in both})
    return {r[:2]: r[2] for r in both}, rows.count()


def by_definition(rows, op):
    out = {}
    for key in {r[0] for r in rows}:
        memory = []
        for _, m, a, b in sorted(r for r in rows if r[0] == key):
            memory, out[key, m] = op.advance(memory, (a, b)[: len(op.inputs)])
    return out


@pytest.mark.parametrize("op", [online.smoothing("a", 0.4), online.hits("a", "b", 5)], ids=["smoothing", "hits"])
def test_rows_of_several_batches_are_taken_in_event_time(spark, tmp_path, op):
    rng = random.Random(3)
    rows = [(rng.choice("xyz"), m, rng.uniform(-1, 1), rng.uniform(-1, 1)) for m in range(120)] + [("early", 0, 1.0, 1.0)]
    shuffled = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 25))  # out of order by less than the delay
    got, released = run(spark, tmp_path, [shuffled[i : i + 30] for i in range(0, len(shuffled), 30)], op)
    assert got == pytest.approx(by_definition(rows, op), nan_ok=True) and 0 < released < len(rows)


def test_a_timer_releases_silent_keys_and_late_rows_go(spark, tmp_path):
    batches = [[("a", 0, 1.0, 0.0), ("b", 1, 2.0, 0.0)], [("b", 100, 4.0, 0.0)], [("b", 200, 6.0, 0.0), ("a", 3, 9.0, 0.0)]]
    op = online.smoothing("a", 0.5)
    got, released = run(spark, tmp_path, batches, op)
    assert got == {("a", 0): 1.0, ("b", 1): 2.0, ("b", 100): 3.0, ("b", 200): 4.5} and released >= 3


def test_the_ring_keeps_the_last_n():
    op, rng, memory, settled = online.hits("p", "y", 7), random.Random(1), [], []
    for _ in range(60):
        p, y = rng.choice([None, -1.0, 1.0]), rng.choice([None, -1.0, 1.0])
        memory, ratio = op.advance(memory, (p, y))
        assert ratio == (pytest.approx(sum(settled[-7:]) / len(settled[-7:])) if settled else None)
        if p is not None and y is not None:
            settled.append(float((p > 0) == (y > 0)))
    assert len(memory) == 2 + 7


def test_windows_and_sessions_into_files(spark, tmp_path):
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    rows = [(i, BEGIN + dt.timedelta(minutes=17 * i), i % 3, "ab"[i % 2], float(i)) for i in range(50)]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/in")
    events = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    windows = online.into_files(online.event_windows(events), str(tmp_path / "w"), "complete")
    assert windows.agg(F.sum("n"), F.sum("total")).first()[:] == (50, float(sum(range(50))))
    empty = spark.readStream.schema(schema).parquet(f"{tmp_path}/none*")
    assert online.into_files(online.sessions(empty), str(tmp_path / "e"), "complete").count() == 0
