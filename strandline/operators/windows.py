"""Time-series operators over the rows of one ticker, and cross-sectional ones over the rows of one date.

All are Column builders, so any number of them in one ``select`` shares one exchange and one sort per
partitioning. Rolling operators need ``min_periods`` non-null rows in their frame, the window's length
unless stated.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from strandline.functions.scalars import col, flag, ratio

KEY, TIME = "ticker", "date"


def series(key: str | list[str] = KEY, time: str = TIME) -> WindowSpec:
    return Window.partitionBy(key).orderBy(time)


def last_rows(n: int, w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(-(n - 1), 0)


def so_far(w: WindowSpec | None = None) -> WindowSpec:
    return (w or series()).rowsBetween(Window.unboundedPreceding, 0)


def section(by: str | list[str] = TIME) -> WindowSpec:
    return Window.partitionBy(by)


def lag(x: str | Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return (F.lag(col(x), k) if k >= 0 else F.lead(col(x), -k)).over(w or series())


def diff(x: str | Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return col(x) - lag(x, k, w)


def pct_change(x: str | Column, k: int = 1, w: WindowSpec | None = None) -> Column:
    return ratio(x, lag(x, k, w)) - 1


def rolling(agg: Column, x: str | Column, n: int, min_periods: int | None = None, w: WindowSpec | None = None) -> Column:
    """``agg`` over the last ``n`` rows where ``min_periods`` of them have ``x``."""
    frame = last_rows(n, w)
    return F.when(F.count(col(x)).over(frame) >= (n if min_periods is None else min_periods), agg.over(frame))


def rsum(x, n, min_periods=None, w=None) -> Column:
    return rolling(F.sum(col(x)), x, n, min_periods, w)


def mean(x, n, min_periods=None, w=None) -> Column:
    return rolling(F.avg(col(x)), x, n, min_periods, w)


def std(x, n, min_periods=None, w=None, ddof: int = 1) -> Column:
    return rolling(F.stddev_samp(col(x)) if ddof else F.stddev_pop(col(x)), x, n, min_periods, w)


def rmax(x, n, min_periods=None, w=None) -> Column:
    return rolling(F.max(col(x)), x, n, min_periods, w)


def rmin(x, n, min_periods=None, w=None) -> Column:
    return rolling(F.min(col(x)), x, n, min_periods, w)


def quantile(x, n, p: float, min_periods=None, w=None) -> Column:
    """Linear interpolation between the neighbouring order statistics."""
    return rolling(F.percentile(col(x), p), x, n, min_periods, w)


def zscore(x, n, min_periods=None, w=None, eps: float = 0.0) -> Column:
    return ratio(col(x) - mean(x, n, min_periods, w), std(x, n, min_periods, w), eps)


def _moments(x: Column, over: WindowSpec) -> tuple[Column, Column, Column]:
    return F.count(x).over(over).cast("double"), F.skewness(x).over(over), F.kurtosis(x).over(over)


def skew(x, n, w=None) -> Column:
    """Bias-corrected."""
    frame = last_rows(n, w)
    k, g, _ = _moments(col(x), frame)
    return F.when((k >= n) & (k > 2), g * F.sqrt(k * (k - 1)) / (k - 2))


def kurt(x, n, w=None) -> Column:
    """Excess, bias-corrected."""
    frame = last_rows(n, w)
    k, _, g = _moments(col(x), frame)
    return F.when((k >= n) & (k > 3), (k - 1) / ((k - 2) * (k - 3)) * ((k + 1) * g + 6))


def corr(x, y, n, min_periods=None, w=None) -> Column:
    """Over the rows that have both; null where either is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    frame = last_rows(n, w)
    return F.when(F.count(a).over(frame) >= (min_periods or n), F.try_divide(F.covar_pop(a, b).over(frame), F.stddev_pop(a).over(frame) * F.stddev_pop(b).over(frame)))


def beta(y, x, n, min_periods=None, w=None) -> Column:
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    frame = last_rows(n, w)
    return F.when(F.count(a).over(frame) >= (min_periods or n), F.try_divide(F.covar_samp(b, a).over(frame), F.var_samp(a).over(frame)))


def positive_share(x, n, w=None) -> Column:
    return rolling(F.avg((col(x) > 0).cast("double")), x, n, None, w)


def up_ratio(x, n, eps: float = 1e-10, w=None) -> Column:
    """Sum of the gains by the sum of all moves, from 0 to 1."""
    return ratio(rsum(F.greatest(col(x), F.lit(0.0)), n, n, w), rsum(F.abs(col(x)), n, n, w) + F.lit(eps))


def rolling_product(x, n, w=None) -> Column:
    """Compounded return of the last ``n`` rows."""
    return rolling(F.product(1 + col(x)), x, n, None, w) - 1


def percentile_of_last(x, n, min_periods=None, w=None) -> Column:
    """Share of the frame's other rows that lie below the last one."""
    frame = last_rows(n, w)
    values = F.collect_list(col(x)).over(frame)
    below = F.size(F.filter(values, lambda v: v < col(x)))
    return F.when(F.count(col(x)).over(frame) >= (min_periods or n), F.try_divide(below.cast("double"), (F.size(values) - 1).cast("double")))


def cumprod(x, w=None) -> Column:
    """Growth of one unit."""
    return F.product(1 + F.coalesce(col(x), F.lit(0.0))).over(so_far(w))


def drawdown(value: str | Column, w=None) -> Column:
    return ratio(value, F.max(col(value)).over(so_far(w))) - 1


def ffill(x, w=None) -> Column:
    return F.last(col(x), ignorenulls=True).over(so_far(w))


def bfill(x, w=None) -> Column:
    return F.first(col(x), ignorenulls=True).over((w or series()).rowsBetween(0, Window.unboundedFollowing))


def forward_sum(x, h: int, w=None) -> Column:
    """Sum of the next ``h`` rows; null in the first h - 1 rows of a series as well, as by shifting a rolling sum."""
    ahead = (w or series()).rowsBetween(1, h)
    return F.when((F.count(col(x)).over(ahead) == h) & (F.row_number().over(w or series()) >= h), F.sum(col(x)).over(ahead))


def run_length(df: DataFrame, x: str, out: str, w=None) -> DataFrame:
    """Rows since the value last changed, the first row of a run counting 1."""
    w = w or series()
    changed = F.coalesce((~F.col(x).eqNullSafe(F.lag(x).over(w))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(changed)
    df = df.withColumns({"_first": first, "_row": F.row_number().over(w)})
    start = F.max(F.when(F.col("_first") == 1, F.col("_row"))).over(so_far(w))
    return df.withColumn(out, F.col("_row") - start + 1).drop("_first", "_row")


# -- cross-section ---------------------------------------------------------------------------------------


def pct_rank(x: str | Column, by: str | list[str] = TIME, descending: bool = False) -> Column:
    """Average-tie rank over the count of non-null values."""
    x = col(x)
    keys = [by] if isinstance(by, str) else by
    order = x.desc_nulls_last() if descending else x.asc_nulls_last()
    rank = F.rank().over(Window.partitionBy(*keys).orderBy(order))
    ties = F.count(x).over(Window.partitionBy(*keys, x))
    return F.when(x.isNotNull(), (rank + (ties - 1) / F.lit(2.0)) / F.count(x).over(section(by)))


def cs_zscore(x: str | Column, by: str | list[str] = TIME, zero: float | None = None, limit: float | None = None) -> Column:
    """By the sample deviation of the section; ``zero`` where that is 0, cut at ``limit``."""
    x = col(x)
    w = section(by)
    z = F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w))
    if zero is not None:
        z = F.when(x.isNotNull(), F.coalesce(z, F.lit(float(zero))))
    return z if limit is None else F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-float(limit))), F.lit(float(limit))))


def robust_zscore(x: str | Column, by: str = TIME) -> tuple[Column, Column]:
    """(median of the section, deviation from it); the caller divides by the median deviation."""
    m = F.percentile(col(x), 0.5).over(section(by))
    return m, col(x) - m


def demean(x: str | Column, by: str | list[str] = TIME) -> Column:
    return col(x) - F.avg(col(x)).over(section(by))


def winsorise(x: str | Column, low: float, high: float, by: str | list[str] = TIME) -> Column:
    x = col(x)
    w = section(by)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.percentile(x, low).over(w)), F.percentile(x, high).over(w)))


def winsorise_all(df: DataFrame, x: str, low: float, high: float, accuracy: int = 1_000_000) -> DataFrame:
    """``x`` cut at quantiles over all rows (to one part in ``accuracy`` of the rows): one aggregate and one broadcast row."""
    edges = df.agg(F.percentile_approx(x, F.array(F.lit(low), F.lit(high)), accuracy).alias("_edges"))
    cut = F.when(F.col(x).isNotNull(), F.least(F.greatest(F.col(x), F.col("_edges")[0]), F.col("_edges")[1]))
    return df.join(F.broadcast(edges)).withColumn(x, cut).drop("_edges")


def quantile_bucket(x: str | Column, q: int, by: str | list[str] = TIME) -> Column:
    """0 to q - 1 by right-closed quantile edges of the section."""
    x = col(x)
    edges = F.percentile(x, F.array(*[F.lit(i / q) for i in range(1, q)])).over(section(by))
    return F.when(x.isNotNull(), F.size(F.filter(edges, lambda e: e < x)))


def top_k(df: DataFrame, x: str, out: str, k: Column | int | None = None, share: float | None = None, by: str = TIME, descending: bool = True, at_least: int = 0) -> DataFrame:
    """Flag the ``k`` (or floor(n * share)) largest of each section; ties go to the smaller ticker."""
    order = [F.col(x).desc_nulls_last() if descending else F.col(x).asc_nulls_last(), F.col(KEY)]
    count = F.count(F.col(x)).over(section(by))
    limit = F.greatest(F.floor(count * F.lit(share)), F.lit(at_least)) if share is not None else (F.lit(k) if isinstance(k, int) else k)
    return df.withColumn(out, F.col(x).isNotNull() & (F.row_number().over(Window.partitionBy(by).orderBy(*order)) <= limit))


def ewm_alpha(alpha: float | None = None, span: float | None = None, halflife: float | None = None) -> float:
    if alpha is not None:
        return alpha
    return 2 / (span + 1) if span is not None else 1 - math.exp(-math.log(2) / halflife)


def regime_flag(x: str | Column, n: int, p: float) -> Column:
    """1.0 where x lies above its rolling quantile; warm-up counts as 0.0."""
    return flag(col(x) > quantile(x, n, p))
