"""Perceptrons on separable classes, support vectors against direct minimisation, stacking that can't leak."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import learning as ml
from strandline.operators import walk_forward as wf

D0 = dt.date(2001, 1, 1)


def panel(spark, days=80, tickers=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(days):
        for t in range(tickers):
            a, b = rng.normal(size=2)
            rows.append((f"t{t}", D0 + dt.timedelta(d), float(a), float(b), float(0.8 * a - 0.5 * b + 0.1 * rng.normal()), float(rng.normal())))
    return spark.createDataFrame(rows, "ticker string, date date, a double, b double, y double, noise double").repartition(4), rows


def test_perceptrons_learn_a_rule_that_is_not_linear(spark):
    df, _ = panel(spark)
    q = df.withColumn("label", F.when(F.col("a") * F.col("b") > 0, 1).otherwise(0)).withColumn("label", F.when(F.dayofmonth("date") != 7, F.col("label")))
    folds = ml.folds(q, start=40, step=20, embargo=2)
    got = wf.walk_forward_perceptron(q, ["a", "b"], "label", 2, folds, hidden=(6,), seeds=(1, 2), least=100)
    score = {r.fold: r for r in wf.accuracy_by_fold(got).collect()}
    assert len(score) == folds.count() and all(r.accuracy > 0.8 and r.majority < 0.7 for r in score.values())
    rows = got.collect()
    assert all(abs(sum(r.probability) - 1) < 1e-9 and r.predicted == int(np.argmax(r.probability)) for r in rows)
    assert {r.label for r in rows} == {0, 1, None}
    assert wf.walk_forward_perceptron(q, ["a", "b"], "label", 2, folds, least=10**6).count() == 0


def objective(beta, x, y, c, epsilon):
    return beta @ beta / 2 + c * np.maximum(np.abs(x @ beta - y) - epsilon, 0).sum()


@pytest.mark.parametrize("c,epsilon", [(0.1, 0.1), (5.0, 0.0), (0.01, 0.5)])
def test_support_vectors_reach_the_minimum(spark, c, epsilon):
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.normal(size=(60, 2)), np.ones(60)])
    y = x @ [0.7, -0.4, 0.3] + rng.standard_t(2, 60) * 0.3
    rows = spark.createDataFrame([(*map(float, r[:2]), float(v)) for r, v in zip(x, y)], "a double, b double, y double")
    beta = wf.fit_support_vectors(rows, ["a", "b"], "y", c, epsilon)
    # A plain subgradient method with shrinking steps, from zero, keeping the best point.
    best, at = (objective(np.zeros(3), x, y, c, epsilon), np.zeros(3)), np.zeros(3)
    for t in range(1, 60_000):
        r = x @ at - y
        at = at - (at + c * x.T @ (np.sign(r) * (np.abs(r) > epsilon))) / (t + 50 * c * 60)
        if t % 50 == 0:
            best = min(best, (objective(at, x, y, c, epsilon), at.copy()), key=lambda p: p[0])
    assert objective(beta, x, y, c, epsilon) <= best[0] * (1 + 3e-4) + 1e-9
    for _ in range(200):  # no nearby point is better
        near = beta + rng.normal(size=3) * 10.0 ** rng.integers(-4, 0)
        assert objective(beta, x, y, c, epsilon) <= objective(near, x, y, c, epsilon) * (1 + 3e-4)


def test_support_vector_predictions(spark):
    df, _ = panel(spark)
    early = F.col("date") < F.lit(D0 + dt.timedelta(50))
    got = wf.support_vector_regression(df.withColumn("a", F.when(F.col("ticker") != "t3", F.col("a"))), ["a", "b"], "y", early, c=1.0, epsilon=0.05)
    late = got.where(~early).toPandas()
    assert len(late) == 30 * 7 and np.corrcoef(late.y, late.prediction)[0, 1] > 0.98


def test_stacking_equals_its_definition_and_does_not_leak(spark):
    df, rows = panel(spark, days=60)
    base, meta = ml.folds(df, start=20, step=5, embargo=1), ml.folds(df, start=35, step=10, embargo=1)
    bases = {"one": ["a"], "two": ["b"]}
    got = wf.stacked(df, bases, "y", base, meta, (0.5, 50.0)).collect()
    # By definition: ridge on scaled features, refitted at each cut, on numpy arrays.
    day = {r[1]: i for i, r in enumerate(sorted({r[1]: r for r in rows}.values(), key=lambda r: r[1]))}

    def ridge(x, y, alpha, z):
        m, s = x.mean(0), x.std(0)
        beta = np.linalg.solve(((x - m) / s).T @ ((x - m) / s) + alpha * np.eye(x.shape[1]), ((x - m) / s).T @ (y - y.mean()))
        return (z - m) / s @ beta + y.mean()

    def walk(x, y, known, days, folds, alpha):
        out = np.full(len(y), np.nan)
        for f in folds.collect():
            fit, test = known & (days >= f.train_from) & (days <= f.train_to), known & (days >= f.test_from) & (days <= f.test_to)
            if fit.sum() >= 100 and test.any():
                out[test] = ridge(x[fit], y[fit], alpha, x[test])
        return out

    days, y = np.array([day[r[1]] for r in rows]), np.array([r[4] for r in rows])
    every = np.ones(len(rows), bool)
    first = np.column_stack([walk(np.array([[r[2 + k]] for r in rows]), y, every, days, base, 1.0) for k in (0, 1)])
    known = ~np.isnan(first).any(1)
    for alpha in (0.5, 50.0):
        want = walk(np.nan_to_num(first), y, known, days, meta, alpha)
        mine = {(r.ticker, r.date): r.prediction for r in got if r.penalty == alpha}
        assert mine == pytest.approx({(r[0], r[1]): w for r, w in zip(rows, want) if not np.isnan(w)})
    # The targets of a date, and all later ones, changed: predictions up to that date stay as they were.
    cut = D0 + dt.timedelta(50)
    changed = df.withColumn("y", F.when(F.col("date") >= F.lit(cut), 99 * F.col("noise")).otherwise(F.col("y")))
    again = {(r.ticker, r.date, r.penalty): r.prediction for r in wf.stacked(changed, bases, "y", base, meta, (0.5, 50.0)).collect()}
    assert {k: v for k, v in again.items() if k[1] <= cut} == pytest.approx({(r.ticker, r.date, r.penalty): r.prediction for r in got if r.date <= cut})
    scores = wf.grid_scores(spark.createDataFrame(got)).collect()
    assert sum(r.best for r in scores) == 1 and all(r.ic > 0.8 for r in scores)
