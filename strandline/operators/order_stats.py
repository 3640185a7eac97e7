"""Order statistics of moving and growing frames: quantiles, and places of the last value.

A window expression sorts every frame anew. Here each series is indexed once, by a wavelet matrix over the ranks of its values: per binary
digit of the rank, the highest first, a running count of zeros and the values parted by that digit. The kth smallest
value of any frame, and the number of a frame's values below a bound, are then a walk of one step per digit, taken for all rows and
all quantiles at once. So a row costs the logarithm of the series, whatever the frame's length.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.shipping import ship
from strandline.operators.windows import KEY, TIME


@dataclass(frozen=True)
class Quantile:
    """The ``p`` quantile, linearly interpolated, of the last ``n`` rows' values of ``x`` (of all rows so far with None), where at least
    ``least`` of them (``n`` unless stated) are there."""

    x: str
    n: int | None
    p: float
    least: int | None = None


@dataclass(frozen=True)
class ShareBelow:
    """The share of the other values of the last ``n`` rows (all rows so far with None) that lie below the row's own; null for a null."""

    x: str
    n: int | None
    least: int | None = None


class Ranks:
    """The wavelet matrix of an array without NaN."""

    def __init__(self, values: np.ndarray):
        order = np.argsort(values, kind="stable")
        self.sorted = values[order]
        ranks = np.empty(len(values), np.int64)
        ranks[order] = np.arange(len(values))
        self.digits = max(1, (len(values) - 1).bit_length()) if len(values) else 1
        self.zeros: list[np.ndarray] = []
        for d in range(self.digits - 1, -1, -1):
            zero = (ranks >> d) & 1 == 0
            self.zeros.append(np.concatenate([[0], np.cumsum(zero)]))
            ranks = np.concatenate([ranks[zero], ranks[~zero]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The ``k``th smallest (from 0) of the values at places ``low`` to ``high`` - 1; all arrays of one shape, k within the frame."""
        at, low, high, k = np.zeros_like(k), low.copy(), high.copy(), k.copy()
        for d, zeros in zip(range(self.digits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = k >= b - a
            k -= np.where(one, b - a, 0)
            at |= one.astype(np.int64) << d
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return self.sorted[at]

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values at places ``low`` to ``high`` - 1 lie below ``bound``."""
        rank = np.searchsorted(self.sorted, bound, "left")
        every, low, high, found = rank >= 1 << self.digits, low.copy(), high.copy(), np.zeros(len(low), np.int64)
        whole = high - low
        for d, zeros in zip(range(self.digits - 1, -1, -1), self.zeros):
            a, b = zeros[low], zeros[high]
            one = (rank >> d) & 1 == 1
            found += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return np.where(every, whole, found)


def _computed(x: np.ndarray, wanted: Mapping[str, Quantile | ShareBelow]) -> dict[str, np.ndarray]:
    """The statistics of one column of one series, NaN being null."""
    there = ~np.isnan(x)
    ranks, upto = Ranks(x[there]), np.concatenate([[0], np.cumsum(there)])
    out, rows = {}, np.arange(len(x))
    by_frame: dict[tuple[int | None, int | None], list[str]] = {}
    for name, w in wanted.items():
        by_frame.setdefault((w.n, w.least), []).append(name)
    for (n, least), names in by_frame.items():
        high = upto[1:]
        low = upto[np.maximum(rows + 1 - n, 0)] if n else np.zeros(len(x), np.int64)
        count = high - low
        full = np.flatnonzero(count >= max(least if least is not None else n or 1, 1))
        low, high, count = low[full], high[full], count[full]
        quantiles = [q for q in names if isinstance(wanted[q], Quantile)]
        if quantiles:
            place = np.array([[wanted[q].p] for q in quantiles]) * (count - 1)
            under, over = np.floor(place).astype(np.int64), np.ceil(place).astype(np.int64)
            a, b = (ranks.kth(np.broadcast_to(low, k.shape), np.broadcast_to(high, k.shape), k) for k in (under, over))
            between = np.where(under == over, a, (over - place) * a + (place - under) * b)
            for q, v in zip(quantiles, between):
                out[q] = np.full(len(x), np.nan)
                out[q][full] = v
        for name in names:
            if isinstance(wanted[name], ShareBelow):
                own = there[full] & (count > 1)
                out[name] = np.full(len(x), np.nan)
                out[name][full[own]] = ranks.below(low[own], high[own], x[full[own]]) / (count[own] - 1)
    return out


def with_order_stats(df: DataFrame, wanted: Mapping[str, Quantile | ShareBelow], key: str | None = KEY, time: str = TIME, chunk: int | None = None) -> DataFrame:
    """``df`` with the columns ``wanted``; ``key`` None: the whole frame is one series (of one row a date, say).

    A series is one task; with ``chunk`` (at least as long as the longest frame), tasks are chunks of so many rows, each sent the rows
    before it that its frames reach. NaN and null count as missing.
    """
    ship(df.sparkSession)
    frames = [w.n for w in wanted.values()]
    if chunk is not None and (None in frames or max(frames) > chunk):
        raise ValueError("chunks must be as long as the longest frame, and growing frames can't be cut")
    schema = T.StructType([*df.schema.fields, *(T.StructField(name, T.DoubleType()) for name in wanted)])
    names = df.columns

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([(time, "ascending")])
        new: dict[str, np.ndarray] = {}
        for x in {w.x for w in wanted.values()}:
            values = t.column(x).cast(pa.float64()).to_numpy()
            new |= _computed(values, {k: w for k, w in wanted.items() if w.x == x})
        for k in wanted:
            t = t.append_column(k, pa.array(new[k], from_pandas=True))
        if chunk is not None:
            t = t.filter(pa.compute.equal(t.column("_home"), t.column("_chunk")))
        return t.select([*names, *wanted])

    by = [F.col(key)] if key else [F.lit("all")]
    if chunk is None:
        return df.groupBy(*by).applyInArrow(run, schema)
    place = F.row_number().over(Window.partitionBy(*by).orderBy(time)) - 1
    home = F.floor(F.col("_place") / chunk)
    reach = F.when(F.col("_place") % chunk > chunk - max(frames), F.array(home, home + 1)).otherwise(F.array(home))
    cut = df.withColumn("_place", place).withColumns({"_home": home, "_chunk": F.explode(reach)}).drop("_place")
    return cut.groupBy(*by, "_chunk").applyInArrow(run, schema)
