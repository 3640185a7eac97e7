"""Cointegration of pairs over moving windows, by running sums.

The spread of a window is linear in the two log prices, with the window's own hedge ratio; so the moments that a unit-root regression on it needs are quadratic
forms, in that ratio, of moments of the prices, their lags and their changes. Those are differences of running sums: a row costs
the same whatever the window, and all windows of all pairs share one exchange by pair.
"""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.operators.trading import safe_corr

PAIR = ("asset1", "asset2")


def screened_pairs(df: DataFrame, partners: int = 2, x: str = "ret", least: int = 100, key: str = "ticker", time: str = "date") -> DataFrame:
    """(asset1, asset2), asset1 before asset2: of each ticker the ``partners`` whose ``x`` correlates most with its own over at least ``least`` common
    rows, ties to the smaller ticker. Pairs grow with the tickers, not with their square; the correlations are summed within dates."""
    rows = df.where(F.col(x).isNotNull()).select(key, time, x)
    a, b = (rows.toDF(f"asset{i}", time, f"x{i}") for i in (1, 2))
    both = a.join(b, time).where("asset1 < asset2").groupBy(*PAIR).agg(F.round(safe_corr("x1", "x2"), 9).alias("c"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    ways = both.unionByName(both.select(F.col("asset2").alias("asset1"), F.col("asset1").alias("asset2"), "c", "n"))
    place = F.row_number().over(Window.partitionBy("asset1").orderBy(F.col("c").desc_nulls_last(), "asset2"))
    near = ways.withColumn("place", place).where(F.col("place") <= partners)
    return near.select(F.least(*PAIR).alias("asset1"), F.greatest(*PAIR).alias("asset2")).distinct()


def pair_prices(df: DataFrame, pairs: DataFrame, price: str = "close", key: str = "ticker", time: str = "date") -> DataFrame:
    """asset1, asset2, date, lp1, lp2: both log prices on common dates of the pairs named."""
    rows = df.where(F.col(price) > 0).select(key, time, F.ln(price).alias("lp"))
    first = pairs.join(rows.toDF("asset1", time, "lp1"), "asset1")
    return first.join(rows.toDF("asset2", time, "lp2"), ["asset2", time]).select(*PAIR, time, "lp1", "lp2")


def rolling_cointegration(prices: DataFrame, n: int = 252, critical: float = -3.34, time: str = "date") -> DataFrame:
    """asset1, asset2, date, hedge_ratio, speed, half_life, stat, cointegrated of the last ``n`` rows at every row that has them.

    hedge_ratio is that of lp1 on lp2 with a constant; stat is the t of the lagged spread in the regression of the spread's change on a constant, the lagged spread
    and the lagged change, all within the window. half_life is null where the spread doesn't revert; everything is null where a window is constant.
    """
    order = Window.partitionBy(*PAIR).orderBy(time)
    past, whole = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*PAIR)
    # About the pair's means, so that differences of sums keep their digits.
    q = prices.select(*PAIR, time, *((F.col(f"lp{i}") - F.avg(f"lp{i}").over(whole)).alias(f"x{i}") for i in (1, 2)))
    q = q.withColumns({f"p{i}": F.lag(f"x{i}").over(order) for i in (1, 2)} | {"row": F.row_number().over(order)})
    q = q.withColumns({f"d{i}": F.col(f"x{i}") - F.col(f"p{i}") for i in (1, 2)})
    q = q.withColumns({f"e{i}": F.lag(f"d{i}").over(order) for i in (1, 2)})
    three = F.col("row") > 2
    names = ["d1", "d2", "p1", "p2", "e1", "e2"]
    level = {"s_x1": F.col("x1"), "s_x2": F.col("x2"), "s_x1x2": F.col("x1") * F.col("x2"), "s_x2x2": F.col("x2") * F.col("x2")}
    products = {f"s_{a}": F.col(a) for a in names} | {f"s_{a}{b}": F.col(a) * F.col(b) for a, b in combinations_with_replacement(names, 2)}
    m = n - 2
    q = q.withColumns({k: F.sum(v).over(past) for k, v in level.items()} | {k: F.coalesce(F.sum(F.when(three, v)).over(past), F.lit(0.0)) for k, v in products.items()})
    moving = {k: F.col(k) - F.coalesce(F.lag(k, n).over(order), F.lit(0.0)) for k in level} | {k: F.col(k) - F.coalesce(F.lag(k, m).over(order), F.lit(0.0)) for k in products}
    q = q.withColumns(moving).where(F.col("row") >= n)
    slope = F.try_divide(n * F.col("s_x1x2") - F.col("s_x1") * F.col("s_x2"), n * F.col("s_x2x2") - F.col("s_x2") * F.col("s_x2"))
    q = q.withColumn("hedge_ratio", slope)

    def about(a: str, b: str) -> Column:
        a, b = sorted((a, b), key=names.index)
        return F.col(f"s_{a}{b}") - F.col(f"s_{a}") * F.col(f"s_{b}") / m

    def form(a: str, b: str) -> Column:
        h = F.col("hedge_ratio")
        return about(a + "1", b + "1") - h * (about(a + "1", b + "2") + about(a + "2", b + "1")) + h * h * about(a + "2", b + "2")

    q = q.withColumns({a + b: form(a, b) for a, b in ("dd", "pp", "ee", "dp", "de", "pe")})
    det = F.col("pp") * F.col("ee") - F.col("pe") * F.col("pe")
    q = q.withColumns({"speed": F.try_divide(F.col("dp") * F.col("ee") - F.col("de") * F.col("pe"), det), "kept": F.try_divide(F.col("de") * F.col("pp") - F.col("dp") * F.col("pe"), det)})
    rest = F.greatest(F.col("dd") - F.col("speed") * F.col("dp") - F.col("kept") * F.col("de"), F.lit(0.0))
    stat = F.try_divide(F.col("speed"), F.sqrt(rest / (m - 3) * F.try_divide(F.col("ee"), det)))
    q = q.withColumn("stat", stat)
    half = F.when((F.col("speed") < 0) & (F.col("speed") > -1), -F.ln(F.lit(2.0)) / F.ln(1 + F.col("speed")))
    return q.select(*PAIR, time, "hedge_ratio", "speed", half.alias("half_life"), "stat", (F.col("stat") < critical).alias("cointegrated"))
