"""Numerical operators against direct computations, shipping of the package, and flat inputs."""

import datetime as dt
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest

from strandline.operators import blocks as bl
from strandline.operators import diagnostics as dg
from strandline.operators import features as fe
from strandline.operators import models as md

ROOT = Path(__file__).resolve().parents[1]
DAY = dt.date(2020, 1, 1)


def series(spark, values, ticker="a", name="x"):
    return spark.createDataFrame([(ticker, DAY + dt.timedelta(i), None if v is None else float(v)) for i, v in enumerate(values)], f"ticker string, date date, {name} double")


def test_smoother_equals_the_gaussian_posterior():
    """The smoothed level is the posterior mean of a random walk under noise, by linear algebra."""
    rng = np.random.default_rng(1)
    n, q, r = 40, 0.02, 0.1
    y = np.cumsum(rng.normal(0, 0.2, n)) + rng.normal(0, 0.3, n)
    got = dg.rts_level("x", q, r, 1e6)(pd.DataFrame({"x": y}))
    # The filter takes the first observation as the first level, with variance p0 there.
    cov = 1e6 + q * np.minimum.outer(np.arange(n), np.arange(n))
    rest = np.arange(1, n)
    want = y[0] + cov[:, rest] @ np.linalg.solve(cov[np.ix_(rest, rest)] + r * np.eye(n - 1), y[rest] - y[0])
    assert np.allclose(got, want, atol=1e-4)
    assert np.isnan(dg.rts_level("x")(pd.DataFrame({"x": [np.nan, np.nan]}))).all()


def test_em_finds_the_noise(spark):
    rng = np.random.default_rng(2)
    y = np.cumsum(rng.normal(0, 0.5, 1500)) + rng.normal(0, 1.0, 1500)
    df = series(spark, y)
    few, many = (dg.em_noise(df, "x", rounds=k, q=0.1, r=0.1).first() for k in (2, 60))
    assert many.loglik > few.loglik and 0.15 < many.q < 0.4 and 0.8 < many.r < 1.25


def test_simplex_weights_on_a_known_case(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 3)) * [1, 2, 1] + [0.1, 0.2, -0.2]
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    got = dg.simplex_weights(df, ["a", "b", "c"])
    cov, mean = np.cov(x[:, :2].T), x[:, :2].mean(0)
    best = np.linalg.solve(cov, mean)
    assert np.allclose(got, [*(best / best.sum()), 0], atol=0.01) and abs(sum(got) - 1) < 1e-9
    assert dg.simplex_weights(df.limit(0), ["a", "b"]) == pytest.approx([0.5, 0.5])


def test_cumulative_importance_keeps_up_to_the_share():
    assert dg.cumulative_importance(["a", "b", "c"], [0.1, 0.6, 0.3]) == [("b", 0.6, 0.6, True), ("c", 0.3, pytest.approx(0.9), True), ("a", 0.1, pytest.approx(1.0), False)]


def test_batched_regimes_equal_single_fits_and_selection(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6, 200)) * np.where(rng.random((6, 200)) < 0.3, 4, 1)
    many = md.fit_hmms(x)
    for i in range(6):
        one = md.fit_hmm(x[i])
        assert all(np.allclose(a[i], b, atol=1e-9) for a, b in zip(many, one))
    calm = np.concatenate([rng.normal(0, 1, 300), rng.normal(0, 6, 300), rng.normal(0, 1, 300)])
    got = md.select_hmm(series(spark, calm, name="ret"), states=(1, 2, 3)).collect()
    assert sum(r.chosen for r in got) == 1 and next(r.states for r in got if r.chosen) == 2
    assert md.select_hmm(series(spark, [1.0, 2.0], name="ret")).count() == 0


def test_rolling_factors_find_the_common_factor(spark):
    rng = np.random.default_rng(5)
    common = rng.normal(size=120)
    rows = [(f"t{j}", DAY + dt.timedelta(i), float(common[i] + 0.1 * rng.normal())) for i in range(120) for j in range(6) if (i + j) % 17]
    got = bl.rolling_factors(spark.createDataFrame(rows, "ticker string, date date, ret double"), components=2, window=60, every=20).collect()
    assert {r.fit for r in got} == {0, 1, 2, 3} and all((r.explained > 0.8) == (r.component == 0) for r in got)
    assert max(r.date for r in got) == DAY + dt.timedelta(119)


def test_noise_is_drawn_anew_only_by_seed(spark):
    df = series(spark, range(200))
    a, b, c = ([r.x for r in dg.with_noise(df, ["x"], 1.0, s).orderBy("date").collect()] for s in (1, 1, 2))
    assert a == b != c and abs(np.std(np.array(a) - np.arange(200)) / np.std(np.arange(200)) - 1) < 0.25
    assert [r.x for r in dg.with_noise(df, ["x"], 0.0).orderBy("date").collect()] == list(map(float, range(200)))


def test_wilcoxon_of_ties_and_zeros(spark):
    got = dg.wilcoxon(series(spark, [1, -1, 2, 0, None, 3]), "x").first()
    assert (got.n, got.w_plus) == (4, 8.5)


def test_flat_and_nearly_flat_volatility_gives_regimes(spark):
    """Terciles a hair apart: all three exponents are far below zero, and still the shares sum to one."""
    rng = np.random.default_rng(6)
    flat = series(spark, [0.01 * (-1) ** i for i in range(500)], name="ret")
    close = series(spark, [0.01 * (-1) ** i * (1 + 1e-7 * rng.random()) for i in range(500)], "b", "ret")
    for r in fe.add(flat.unionByName(close), fe.regime()).where("p_low is not null").collect():
        assert abs(r.p_low + r.p_mid + r.p_high - 1) < 1e-9


def test_grouped_maps_run_from_another_folder(tmp_path):
    """Workers that don't start in the repository get the package sent."""
    code = f"""
import sys; sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
q = e.queries()
for n in ("w13_recursive_decay", "bt21_regime_blend", "ss1_kalman_level"):
    print(n, q[n](s, "/root/testdata/sf0.001").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert all(int(line.split()[1]) > 0 for line in done.stdout.splitlines() if line.split()[0] in ("w13_recursive_decay", "bt21_regime_blend", "ss1_kalman_level"))


def test_winsorise_over_all_rows(spark):
    from strandline.operators import windows as w

    got = [r.x for r in w.winsorise_all(series(spark, range(101)), "x", 0.05, 0.95).orderBy("date").collect()]
    assert got[0] == 5.0 and got[100] == 95.0 and got[50] == 50.0
