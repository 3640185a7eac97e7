"""States by the last observations against a plain loop, and feature reports and fills by hand."""

import datetime as dt

import numpy as np
import pytest

from strandline.operators import books as bk
from strandline.operators import models as md

D0 = dt.date(2001, 1, 1)


def test_states_of_the_last_observations():
    rng = np.random.default_rng(1)
    v, fit = rng.normal(size=30), np.minimum(np.arange(30) // 10, 2)
    mean, var, step = rng.normal(size=(3, 3)), rng.uniform(0.2, 2, (3, 3)), rng.dirichlet(np.ones(3), (3, 3))
    got = md.forward_states(v, fit, mean, var, step, 11)
    for t in range(30):
        m, s, a = mean[fit[t]], var[fit[t]], step[fit[t]]
        p = np.full(3, 1 / 3)
        for i, x in enumerate(v[max(0, t - 10) : t + 1]):
            p = (p if i == 0 else p @ a) * np.exp(-0.5 * (x - m) ** 2 / s) / np.sqrt(2 * np.pi * s)
            p /= p.sum()
        assert got[t] == pytest.approx(p)


def test_features_tell_calm_from_wild_rows(spark):
    rng = np.random.default_rng(2)
    wild = np.arange(400) // 50 % 2 == 1
    v = rng.normal(size=400) * np.where(wild, 0.05, 0.005)
    df = spark.createDataFrame([("a", D0 + dt.timedelta(i), float(x)) for i, x in enumerate(v)] + [("b", D0, 0.1), ("a", D0 - dt.timedelta(1), None)], "ticker string, date date, ret double")
    got = md.hmm_features(df, states=2, window=200, every=50).orderBy("date").collect()
    assert len(got) == 200 and {r.ticker for r in got} == {"a"} and got[0]["shift"] is None
    assert np.mean([(r.p_high > 0.5) == w for r, w in zip(got, wild[200:])]) > 0.85
    assert all(0.5 <= r.confidence <= 1 and -1e-6 <= r.entropy <= np.log(2) + 1e-6 and r.duration >= 1 for r in got)
    calm, loud = md.hmm_parameters(df, states=2).orderBy("state").collect()
    assert calm.std < 0.01 < 0.03 < loud.std and calm.share + loud.share == pytest.approx(1) and min(calm.stay, loud.stay) > 0.8


def test_report_and_fill(spark):
    rows = [(f"t{t}", D0 + dt.timedelta(d), None if d < 2 else float(t * (d + 1)), float(t), None if t == 0 else 1.0) for t in range(6) for d in range(5)]
    df = spark.createDataFrame(rows, "ticker string, date date, a double, y double, c double")
    got = {r.feature: r for r in bk.feature_report(df, {"a": "one", "c": "two"}, "y", 0.3).collect()}
    assert (got["a"].category, got["a"].dates, got["a"].missing, got["a"].kept) == ("one", 3, pytest.approx(0.4), False) and got["a"].ic == pytest.approx(1)
    assert got["c"].ic is None and got["c"].kept and got["c"].missing == pytest.approx(1 / 6)
    gaps = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("b", 2, 5.0), ("c", 2, None), ("c", 3, None)], "ticker string, date int, x double")
    assert {(r.ticker, r.date): r.x for r in bk.filled(gaps, ["x"]).collect()} == {("a", 1): 1.0, ("a", 2): 1.0, ("b", 2): 5.0, ("c", 2): 3.0, ("c", 3): 0.0}
