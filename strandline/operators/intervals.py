"""Joins of points with intervals by bins: an equi join on the bin, then the exact test.

Bins are as wide as the intervals, so an interval lies in a few bins and a point meets the intervals of its own bin alone; no nested loop, and no
point meets all intervals of its key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, time: str, low: Column, high: Column, width: int, on: Sequence[str] = ()) -> DataFrame:
    """Rows of ``points`` with those of ``intervals`` whose ``low`` <= time <= ``high`` (dates, ends included), equal in ``on``.

    ``width``: days of a bin; about the intervals' length is best. Intervals with a null end, or that end before they begin, meet nothing; repeated rows are repeated.
    """
    number = lambda d: F.floor(F.unix_date(d) / F.lit(width))
    spread = intervals.withColumns({"_low": low, "_high": high}).where(F.col("_low") <= F.col("_high"))
    spread = spread.withColumn("_bin", F.explode(F.sequence(number(F.col("_low")), number(F.col("_high")))))
    placed = points.withColumn("_bin", number(F.col(time)))
    return placed.join(spread, [*on, "_bin"]).where(F.col(time).between(F.col("_low"), F.col("_high"))).drop("_bin", "_low", "_high")
