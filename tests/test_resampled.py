"""Shuffles, bootstraps, interval joins and moving cointegration against direct computations."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import cointegration as co
from strandline.operators import stats as st
from strandline.operators.diagnostics import noise_floor
from strandline.operators.intervals import interval_join

D0 = dt.date(2001, 1, 1)


def panel(spark, tickers=12, days=60, link=0.0, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for t in range(tickers):
            x = rng.normal() + d / 10
            rows.append((f"t{t:02}", D0 + dt.timedelta(d), float(x), float(link * x + rng.normal() + d / 10)))
    return spark.createDataFrame(rows + [("t99", D0, None, 1.0), ("t99", D0, 1.0, None)], "ticker string, date date, x double, y double").repartition(4), rows


@pytest.mark.parametrize("block", [None, 5])
def test_shuffles_keep_the_groups(spark, block):
    df, rows = panel(spark)
    got = np.array([r.sxy for r in st.shuffled_sums(df, "x", "y", 40, 7, "date", block).orderBy("sim").collect()])
    assert len(got) == 40 and len(set(got.round(9))) == 40
    assert sorted(got) == pytest.approx(sorted(r.sxy for r in st.shuffled_sums(df.repartition(9), "x", "y", 40, 7, "date", block).collect()))
    # Within dates the mean of the sums is that of the dates' means.
    by = pd.DataFrame(rows, columns=["t", "d", "x", "y"]).groupby("d")
    if block is None:
        want, sd = (by.x.sum() * by.y.mean()).sum(), got.std() / math.sqrt(40)
        assert abs(got.mean() - want) < 5 * sd
    one = st.shuffled_sums(df, "x", "x", 5, 7, "date", 1).collect()  # blocks of one row: nothing moves
    assert [r.sxy for r in one] != [] and st.shuffled_sums(df.limit(0), "x", "y", 5, 7).count() == 0


def test_p_values_and_floor(spark):
    unrelated, _ = panel(spark, link=0.0, seed=3)
    linked, _ = panel(spark, link=0.5, seed=4)
    p = [st.permutation_test(d, "x", "y", 100).first().p_value for d in (unrelated, linked)]
    assert p[0] > 0.01 and p[1] == 0
    both = st.permutation_test(linked, "x", "y", 50, by=None, block=100).first()
    assert both.p_value == 0 and both.real == pytest.approx(linked.dropna().toPandas().corr(numeric_only=True).loc["x", "y"])
    floor = noise_floor(linked, "x", "y").first()
    assert 0 < floor.floor < 0.15 < floor.real


def test_bootstrap_intervals(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(0.1, 1, 800)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(-1, None)], "i long, x double")
    m, s = st.bootstrap_mean(df.repartition(3), "x").first(), st.bootstrap_sharpe(df.repartition(5), "x").first()
    assert m.mean == pytest.approx(v.mean()) and abs((m.high - m.low) - 2 * 1.96 * v.std() / math.sqrt(800)) < 0.02
    sharpe = v.mean() / v.std(ddof=1) * math.sqrt(252)
    assert s.sharpe == pytest.approx(sharpe) and s.low < sharpe < s.high and abs((s.high - s.low) - 2 * 1.96 * math.sqrt((1 + sharpe**2 / 504) * 252 / 800)) < 0.25
    assert 0 <= s.share_below < 0.1
    assert list(st.bootstrap_mean(df.repartition(7, "i"), "x").first()) == pytest.approx(list(m))  # weights belong to rows
    assert st.bootstrap_mean(df.limit(0), "x").first().low is None


def test_weights_are_poisson():
    h = np.random.default_rng(1).integers(0, 1 << 63, 200_000).astype(np.uint64)
    k = st._weights(h, 3, 42)
    assert abs(k.mean() - 1) < 0.01 and abs(k.var() - 1) < 0.02 and not np.array_equal(k, st._weights(h, 4, 42))


def test_interval_join_equals_the_nested_loop(spark):
    rng = np.random.default_rng(8)
    points = [("ab"[i % 2], D0 + dt.timedelta(int(rng.integers(-400, 400))), i) for i in range(300)] + [("a", None, -1)]
    spans = [("ab"[i % 2], D0 + dt.timedelta(int(a)), D0 + dt.timedelta(int(a + n)), i) for i, (a, n) in enumerate(zip(rng.integers(-400, 400, 60), rng.integers(-3, 90, 60)))] + [("a", None, D0, 99)]
    p, s = spark.createDataFrame(points, "k string, date date, i int"), spark.createDataFrame(spans, "k string, lo date, hi date, j int")
    want = sorted((i, j) for k, d, i in points for q, lo, hi, j in spans if k == q and None not in (d, lo, hi) and lo <= d <= hi)
    for width in (1, 30, 1000):
        got = interval_join(p, s, "date", F.col("lo"), F.col("hi"), width, ["k"])
        assert sorted((r.i, r.j) for r in got.collect()) == want
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()


def plain_refit(a, b):
    design = np.column_stack([np.ones(len(a)), b])
    h = np.linalg.lstsq(design, a, rcond=None)[0][1]
    s = a - h * b
    d = np.diff(s)
    x = np.column_stack([np.ones(len(d) - 1), s[1:-1], d[:-1]])
    beta = np.linalg.lstsq(x, d[1:], rcond=None)[0]
    rest = d[1:] - x @ beta
    var = rest @ rest / (len(rest) - 3) * np.linalg.inv(x.T @ x)
    return h, beta[1], beta[1] / math.sqrt(var[1, 1])


def test_moving_cointegration_equals_a_refit(spark):
    rng = np.random.default_rng(5)
    n, days = 60, 200
    logs = np.cumsum(rng.normal(0, 0.02, (6, days)), 1) + 4
    logs[1] = 0.7 * logs[0] + 1 + 0.02 * rng.normal(size=days)
    rows = [(f"t{i}", D0 + dt.timedelta(d), float(np.exp(logs[i, d]))) for i in range(6) for d in range(days) if not (i == 3 and d % 5 == 0)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double").repartition(3)
    from pyspark.sql import Window

    returns = df.withColumn("ret", F.ln("close") - F.lag(F.ln("close")).over(Window.partitionBy("ticker").orderBy("date")))
    pairs = co.screened_pairs(returns, 2)
    named = {(r.asset1, r.asset2) for r in pairs.collect()}
    assert ("t0", "t1") in named and 6 <= len(named) <= 12 and all(a < b for a, b in named)
    got = co.rolling_cointegration(co.pair_prices(df, pairs), n).collect()
    seen = 0
    for a, b in named:
        i, j = int(a[1]), int(b[1])
        days_of = [d for d in range(days) if 3 not in (i, j) or d % 5]
        mine = {r.date: r for r in got if (r.asset1, r.asset2) == (a, b)}
        assert len(mine) == len(days_of) - n + 1
        for k in range(n - 1, len(days_of), 17):
            use = days_of[k - n + 1 : k + 1]
            h, speed, stat = plain_refit(logs[i, use], logs[j, use])
            r = mine[D0 + dt.timedelta(days_of[k])]
            assert (r.hedge_ratio, r.speed, r.stat) == pytest.approx((h, speed, stat), rel=1e-6, abs=1e-8)
            seen += 1
    assert seen > 40 and any(r.cointegrated for r in got if (r.asset1, r.asset2) == ("t0", "t1"))
