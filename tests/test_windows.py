import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import features as fe
from strandline.operators import kernels as kn
from strandline.operators import windows as w

R = [None, 0.02, -0.01, 0.03, -0.02, 0.01, 0.04, -0.03]


def frame(spark, columns, ticker="A"):
    n = len(next(iter(columns.values())))
    rows = [(ticker, dt.date(2020, 1, 1) + dt.timedelta(i), *(None if v[i] is None else float(v[i]) for v in columns.values())) for i in range(n)]
    return spark.createDataFrame(rows, "ticker string, date date, " + ", ".join(f"{c} double" for c in columns))


def got(df, c):
    return [r[c] for r in df.orderBy("date").collect()]


def close(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None) and (x is None or abs(x - y) < 1e-6), (a, b)


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: w.rsum("r", 3), [None, None, None, 0.04, 0, 0.02, 0.03, 0.02]),
        (lambda: w.std("r", 3), [None] * 3 + [0.020817, 0.026458, 0.025166, 0.03, 0.035119]),
        (lambda: w.quantile("r", 3, 0.8), [None] * 3 + [0.026, 0.014, 0.022, 0.028, 0.028]),
        (lambda: w.positive_share("r", 3), [None] * 3 + [2 / 3, 1 / 3, 2 / 3, 2 / 3, 2 / 3]),
        (lambda: w.up_ratio("r", 3), [None] * 3 + [0.833333, 0.5, 0.666667, 0.714286, 0.625]),
        (lambda: w.forward_sum("r", 2), [None, 0.02, 0.01, -0.01, 0.05, 0.01, None, None]),
    ],
)
def test_rolling_vectors(spark, column, expected):
    close(got(frame(spark, {"r": R}).select("date", column().alias("x")), "x"), expected)


def test_cross_section_vectors(spark):
    rows = [(t, dt.date(2020, 1, 1), v) for t, v in zip("abcde", [1.0, 2.0, 2.0, None, 5.0])]
    df = spark.createDataFrame(rows, "ticker string, date date, x double")
    q = df.select("ticker", w.pct_rank("x").alias("k"), w.cs_zscore("x").alias("z")).orderBy("ticker").collect()
    close([r.k for r in q], [0.25, 0.625, 0.625, None, 1.0])
    close([r.z for r in q], [-0.866025, -0.288675, -0.288675, None, 1.443376])


def test_recursions(spark):
    df = frame(spark, {"y": [1, 1.1, 0.9, 1.2], "x": [1, 2, 4, 8]})
    q = kn.along(df, {"k": kn.kalman_level("y"), "e": kn.ewm("x", alpha=0.5), "a": kn.ewm("x", adjust=True, halflife=1)})
    close(got(q, "k"), [1, 1.09901, 0.99995, 1.066523])
    close(got(q, "e"), [1, 1.5, 2.75, 5.375])
    close(got(q, "a"), [1, 1.666667, 3, 5.666667])
    gains = kn.kalman_gains(3, 1e-5, 1e-2, 1.0)
    assert abs((1 + gains[0] * 0.1) - 1.09901) < 1e-5


def test_drawdown(spark):
    q = frame(spark, {"r": [0.01, -0.02, 0.03, -0.04]}).withColumn("v", w.cumprod("r"))
    close(got(q, "v"), [1.01, 0.9898, 1.019494, 0.978714])
    close(got(q.withColumn("d", w.drawdown("v")), "d"), [0, -0.02, 0, -0.04])


def test_against_pandas(spark):
    rng = np.random.default_rng(3)
    r = [None if rng.random() < 0.05 else float(x) for x in rng.normal(0, 0.02, 120)]
    s = pd.Series(r, dtype=float)
    df = frame(spark, {"r": r, "q": list(rng.normal(0, 1, 120))})
    q = df.select("date", w.skew("r", 20).alias("sk"), w.kurt("r", 20).alias("ku"), w.mean("r", 20, 10).alias("m"), w.percentile_of_last("r", 10).alias("p"), w.rolling_product("r", 5).alias("g"), w.ffill("r").alias("f"), w.bfill("r").alias("b")).orderBy("date").toPandas()
    for c, e in {"sk": s.rolling(20).skew(), "ku": s.rolling(20).kurt(), "m": s.rolling(20, min_periods=10).mean(), "g": (1 + s).rolling(5).apply(np.prod) - 1, "f": s.ffill(), "b": s.bfill()}.items():
        np.testing.assert_allclose(q[c].astype(float), e, rtol=1e-7, atol=1e-10)


def test_nothing_looks_ahead(spark):
    rng = np.random.default_rng(5)
    price = np.exp(np.cumsum(rng.normal(0, 0.02, 160))).tolist()
    df = frame(spark, {"close": price}).withColumn("ret", w.pct_change("close"))
    build = lambda d: fe.add(d, fe.momentum(), fe.volatility(), fe.mean_reversion())
    whole, part = build(df), build(df.where("date < date'2020-05-01'"))
    names = ["mom_21d", "mom_zscore", "vol_21d", "vol_regime", "ma_20_dev", "rsi_21"]
    a = whole.where("date < date'2020-05-01'").orderBy("date").select(names).collect()
    assert a == part.orderBy("date").select(names).collect()


def test_one_exchange_per_partitioning(spark):
    df = frame(spark, {"ret": [0.1] * 5, "close": [1.0] * 5})
    q = fe.add(df, fe.momentum(), fe.volatility(), fe.mean_reversion(), fe.baseline(), fe.trend())
    plan = q._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_scalars(spark):
    df = spark.createDataFrame([(0.0, float("nan")), (1.96, float("inf")), (-1.0, 2.0), (None, None)], "x double, y double")
    q = df.select(scalars.normal_cdf("x").alias("p"), scalars.clean("y").alias("y"), scalars.ratio("x", F.lit(0.0)).alias("d"), scalars.clip("x", -0.5, 0.5).alias("c")).collect()
    close([r.p for r in q], [0.5, 0.9750021, 0.1586553, None])
    assert [r.y for r in q] == [None, None, 2.0, None] and {r.d for r in q} == {None}
    assert [r.c for r in q] == [0.0, 0.5, -0.5, None]
