"""Recursions along a series as associative scans, in DataFrame functions alone.

The state of a row is a fraction of linear functions of the state before, (a s + b) / (c s + d): smoothing with fixed or own weights, the level of a
local level filter and its variance are all of that form. Such maps compose to maps of the same form, so a long series is cut into
chunks of dates: each chunk is composed to one map in a task of its own, the maps of a series' chunks give the state
that enters each, and every chunk then yields its rows' states. Only one map a chunk meets in one group per series.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.windows import KEY, TIME, ewm_alpha


@dataclass(frozen=True)
class Step:
    """A row's map; ``first`` is the state where there was none before, null to leave it so. A null ``a`` keeps the state."""

    first: Column
    a: Column
    b: Column
    c: Column | float = 0.0
    d: Column | float = 1.0

    def column(self) -> Column:
        parts = {"first": self.first, "a": self.a, "b": self.b, "c": self.c, "d": self.d}
        as_double = {k: (v if isinstance(v, Column) else F.lit(v)).cast("double") for k, v in parts.items()}
        there = as_double["a"].isNotNull()
        same = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 1.0}
        return F.struct(as_double["first"].alias("first"), *(F.when(there, as_double[k]).otherwise(F.lit(same[k])).alias(k) for k in "abcd"))


def _after(state: Column, m: Column) -> Column:
    """The state after a map."""
    return F.when(state.isNull(), m["first"]).otherwise((m["a"] * state + m["b"]) / (m["c"] * state + m["d"]))


def _then(m: Column, n: Column) -> Column:
    """The map ``m`` followed by ``n``, scaled so that its lower row stays near one."""
    a, b = n["a"] * m["a"] + n["b"] * m["c"], n["a"] * m["b"] + n["b"] * m["d"]
    c, d = n["c"] * m["a"] + n["d"] * m["c"], n["c"] * m["b"] + n["d"] * m["d"]
    size = F.abs(c) + F.abs(d)
    return F.struct(_after(m["first"], n).alias("first"), (a / size).alias("a"), (b / size).alias("b"), (c / size).alias("c"), (d / size).alias("d"))


def _states(maps: Column, enter: Column) -> Column:
    """The states before each of ``maps`` and after the last, from ``enter`` on."""
    start = F.array(enter.cast("double"))
    return F.aggregate(maps, start, lambda done, m: F.concat(done, F.array(_after(F.element_at(done, -1), m))))


def scan(df: DataFrame, steps: Mapping[str, Step], key: str | Sequence[str] = KEY, time: str = TIME, chunk: Column | None = None) -> DataFrame:
    """``df`` with the states after each row, in the order of ``time`` (rows of one time in the order of their columns).

    ``chunk``: an expression of ``time`` that never falls (the year unless stated); a chunk's rows are held in one group.
    """
    keys = [key] if isinstance(key, str) else list(key)
    names = df.columns
    same = F.struct(F.lit(None).cast("double").alias("first"), *(F.lit(v).alias(k) for k, v in zip("abcd", (1.0, 0.0, 0.0, 1.0))))
    entry = F.struct(F.col(time).alias("t"), F.struct(*names).alias("row"), *(s.column().alias(f"m{i}") for i, s in enumerate(steps.values())))
    packed = df.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), (F.year(time) if chunk is None else chunk).alias("chunk"), entry.alias("e"))
    by = [f"k{i}" for i in range(len(keys))]
    chunks = packed.groupBy(*by, "chunk").agg(F.array_sort(F.collect_list("e")).alias("es"))
    maps = [F.aggregate(F.col(f"es.m{i}"), same, _then).alias(f"m{i}") for i in range(len(steps))]
    series = chunks.select(*by, F.struct("chunk", *maps).alias("c")).groupBy(*by).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    entering = [_states(F.col(f"cs.m{i}"), F.lit(None)).alias(f"s{i}") for i in range(len(steps))]
    entered = series.select(*by, F.col("cs.chunk").alias("chunk"), *entering).select(*by, F.posexplode("chunk").alias("at", "chunk"), *(f"s{i}" for i in range(len(steps))))
    entered = entered.select(*(F.col(b).alias(f"_{b}") for b in by), F.col("chunk").alias("_chunk"), *(F.get(F.col(f"s{i}"), F.col("at")).alias(f"s{i}") for i in range(len(steps))))
    on = F.col("chunk").eqNullSafe(F.col("_chunk"))
    for b in by:
        on &= F.col(b).eqNullSafe(F.col(f"_{b}"))
    after = [F.slice(_states(F.col(f"es.m{i}"), F.col(f"s{i}")), F.lit(2), F.size("es")).alias(f"o{i}") for i in range(len(steps))]
    rows = chunks.join(entered, on).select("es", *after).select(F.explode(F.arrays_zip("es", *(f"o{i}" for i in range(len(steps))))).alias("z"))
    return rows.select(*(F.col("z.es.row").getField(n).alias(n) for n in names if n not in steps), *(F.col(f"z.o{i}").alias(out) for i, out in enumerate(steps)))


def decay(x: str, alpha: float | Column) -> Step:
    """alpha x + (1 - alpha) s from the first value on; missing values keep the state."""
    v, weight = F.col(x).cast("double"), alpha if isinstance(alpha, Column) else F.lit(alpha)
    return Step(v, F.when(v.isNotNull(), 1 - weight), weight * v)


def ewm(df: DataFrame, out: str, x: str, adjust: bool = False, key: str = KEY, time: str = TIME, chunk: Column | None = None, **halving: float) -> DataFrame:
    """Exponentially weighted mean: weights fall with the rows passed, missing ones included; with ``adjust`` those of the finite past are normalised."""
    alpha, v = ewm_alpha(**halving), F.col(x).cast("double")
    if adjust:
        # The weights of the past and the row are a scan of their own; the row's is one.
        there = v.isNotNull()
        weighed = scan(df, {"_weight": Step(F.when(there, 1.0), F.lit(1 - alpha), there.cast("double"))}, key, time, chunk)
        return scan(weighed, {out: Step(v, F.when(there, 1 - 1 / F.col("_weight")), v / F.col("_weight"))}, key, time, chunk).drop("_weight")
    order = Window.partitionBy(key).orderBy(time)
    at = F.row_number().over(order)
    before = F.last(F.when(F.col(x).isNotNull(), F.col("_at")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    gaps = df.withColumn("_at", at).withColumn("_old", F.pow(F.lit(1 - alpha), (F.col("_at") - before).cast("double")))
    old = F.coalesce("_old", F.lit(0.0))
    step = Step(v, F.when(v.isNotNull(), old / (old + alpha)), alpha * v / (old + alpha))
    return scan(gaps, {out: step}, key, time, chunk).drop("_at", "_old")


def kalman_level(df: DataFrame, out: str, x: str, q: float = 1e-5, r: float = 1e-2, p0: float = 1.0, key: str = KEY, time: str = TIME, chunk: Column | None = None) -> DataFrame:
    """Local level from the first observation; missing observations keep the level and add ``q`` to its variance.

    The variance is a scan of its own, as it doesn't depend on the values; an observation's gain is the variance after it by ``r``."""
    v = F.col(x).cast("double")
    seen = v.isNotNull()
    variance = Step(F.when(seen, p0), F.when(seen, r).otherwise(1.0), F.when(seen, r * q).otherwise(q), F.when(seen, 1.0).otherwise(0.0), F.when(seen, q + r).otherwise(1.0))
    gain = F.col("_variance") / r
    return scan(scan(df, {"_variance": variance}, key, time, chunk), {out: Step(v, F.when(seen, 1 - gain), gain * v)}, key, time, chunk).drop("_variance")
