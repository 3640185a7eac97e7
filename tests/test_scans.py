"""Associative scans against step by step recursions, with gaps, in chunks of any size."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandline.operators import kernels as kn
from strandline.operators import scans as sc

START = dt.date(2001, 3, 1)


def frame(spark, seed=1):
    rng = np.random.default_rng(seed)
    series = {"full": rng.normal(size=400), "gaps": np.where(rng.random(300) < 0.4, np.nan, rng.normal(size=300)), "late": np.r_[np.full(40, np.nan), rng.normal(size=50)], "none": np.full(10, np.nan), "one": np.array([2.0])}
    rows = [(k, START + dt.timedelta(7 * i), None if np.isnan(v) else float(v), float(0.05 + 0.9 * ((i * 7) % 10) / 10)) for k, x in series.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "ticker string, date date, x double, alpha double").repartition(5), series


def values(df, out):
    got = df.toPandas().sort_values(["ticker", "date"])
    return {k: g[out].to_numpy(dtype=float) for k, g in got.groupby("ticker")}


CHUNKS = [None, "date_trunc('month', date)", "1"]


@pytest.mark.parametrize("chunk", CHUNKS, ids=["year", "month", "all"])
def test_ewm_equals_pandas(spark, chunk):
    df, series = frame(spark)
    chunk = chunk and F.expr(chunk)
    for halving in ({"alpha": 0.2}, {"span": 10}, {"halflife": 5}, {"alpha": 1.0}):
        for adjust in (False, True):
            got = values(sc.ewm(df, "s", "x", adjust, chunk=chunk, **halving), "s")
            for k, x in series.items():
                want = pd.Series(x).ewm(**halving, adjust=adjust).mean().to_numpy()
                assert np.allclose(got[k], want, atol=1e-10, equal_nan=True), (k, halving, adjust)


@pytest.mark.parametrize("chunk", CHUNKS, ids=["year", "month", "all"])
def test_decay_and_kalman_equal_the_recursion(spark, chunk):
    df, _ = frame(spark, 2)
    chunk = chunk and F.expr(chunk)
    want = kn.along(df, {"d": kn.decay_smooth("x", 0.3), "a": kn.adaptive_smooth("x", "alpha"), "k": kn.kalman_level("x")})
    both = sc.kalman_level(sc.scan(df, {"d": sc.decay("x", 0.3), "a": sc.decay("x", F.col("alpha"))}, chunk=chunk), "k", "x", chunk=chunk)
    assert sorted(both.columns) == sorted([*df.columns, "d", "a", "k"]) and both.count() == df.count()
    for c in "dak":
        one, other = values(both, c), values(want, c)
        assert all(np.allclose(one[k], other[k], atol=1e-10, equal_nan=True) for k in other), c


def test_no_python_worker_and_edge_cases(spark):
    df = spark.createDataFrame([(None, 3, 1.0), (None, 1, 3.0), ("a", 5, None)], "ticker string, date int, x double")
    got = sc.scan(df, {"s": sc.decay("x", 0.5)}, chunk=F.col("date") % 1)
    assert sorted((str(r.ticker), r.date, r.s) for r in got.collect()) == [("None", 1, 3.0), ("None", 3, 2.0), ("a", 5, None)]
    plan = sc.ewm(df, "s", "x", alpha=0.5, chunk=F.lit(0))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert sc.scan(df.limit(0), {"s": sc.decay("x", 0.5)}, chunk=F.lit(0)).count() == 0
