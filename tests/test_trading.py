import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import books as bk
from strandline.operators import features as fe
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import models as md
from strandline.operators import trading as tr
from strandline.operators import windows as w


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(1)
    rows = []
    for t in range(8):
        price = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 140)))
        rows += [(f"T{t}", dt.date(2020, 1, 1) + dt.timedelta(i), float(p)) for i, p in enumerate(price)]
    df = spark.createDataFrame(rows, "ticker string, date date, close double")
    return df.withColumn("ret", w.pct_change("close")).withColumns({"signal": w.rsum("ret", 10), "fwd": w.lag("ret", -1), "vol": w.std("ret", 10)}).cache()


def pandas_of(df):
    return df.toPandas().sort_values(["ticker", "date"])


@pytest.mark.parametrize("rule, total, net", [("equal", 1.0, None), ("proportional", 1.0, 0.0), ("inverse", 1.0, None), ("top", 1.0, 0.0), ("softmax", 1.0, 1.0), ("quantile", 1.0, 0.0)])
def test_weights_keep_their_sums(panel, rule, total, net):
    block = {"equal": tr.equal_weight("signal"), "proportional": tr.proportional("signal"), "inverse": tr.inverse_vol("signal", "vol"), "top": tr.top_bottom("signal", 0.25), "softmax": tr.softmax("signal"), "quantile": tr.quantile_books("signal")}[rule]
    q = fe.add(panel.where("signal is not null"), block).groupBy("date").agg(F.sum(F.abs("position")).alias("g"), F.sum("position").alias("n")).collect()
    assert all(abs(r.g - total) < 1e-9 for r in q) and (net is None or all(abs(r.n - net) < 1e-9 for r in q))


def test_backtest_equals_pandas(panel):
    book = fe.add(panel, tr.top_bottom("signal", 0.25))
    own = tr.backtest(book).orderBy("date").toPandas()
    p = pandas_of(book.select("ticker", "date", "ret", "position"))
    wide, ret = p.pivot(index="date", columns="ticker", values="position").astype(float), p.pivot(index="date", columns="ticker", values="ret").astype(float)
    held = wide.shift(1).fillna(0)
    np.testing.assert_allclose(own["gross"], (held * ret.fillna(0)).sum(axis=1), atol=1e-12)
    np.testing.assert_allclose(own["turnover"], held.diff().abs().sum(axis=1), atol=1e-12)


def test_rebalanced_equals_a_loop(panel):
    own = tr.rebalanced(panel, "signal", "fwd", 5, 0.25).orderBy("date").toPandas().set_index("date")
    p = pandas_of(panel.select("ticker", "date", "signal", "fwd"))
    held, rows = None, {}
    for i, d in enumerate(sorted(p["date"].unique())):
        day = p[p["date"] == d].dropna(subset=["signal"])
        turn = 0.0
        if i % 5 == 0:
            new = set(day.sort_values(["signal", "ticker"], ascending=[False, True])["ticker"][: max(int(len(day) * 0.25), 1)]) if len(day) else None
            if new:
                turn = (len(new - held) + len(held - new) if held else len(new)) / len(new) / 2
            held = new or None
        if held:
            r = day[day["ticker"].isin(held)].dropna(subset=["fwd"])
            if len(r):
                rows[d] = (r["fwd"].mean(), turn)
    assert list(own.index) == list(rows)
    np.testing.assert_allclose(own["gross"], [v[0] for v in rows.values()], atol=1e-12)
    np.testing.assert_allclose(own["turnover"], [v[1] for v in rows.values()], atol=1e-12)


def test_metrics(panel):
    d = panel.groupBy("date").agg(F.avg("ret").alias("net")).where("net is not null")
    m = tr.performance(d).first()
    r = d.orderBy("date").toPandas()["net"].to_numpy()
    v = np.cumprod(1 + r)
    assert abs(m.sharpe - r.mean() / r.std(ddof=1) * np.sqrt(252)) < 1e-9
    assert abs(m.max_drawdown - (v / np.maximum(np.maximum.accumulate(v), 1) - 1).min()) < 1e-9 and m.max_drawdown <= 0
    assert tr.underwater(d).agg(F.max("days")).first()[0] <= len(r)


def test_vol_target_ignores_the_day_itself(panel):
    d = panel.groupBy("date").agg(F.avg("ret").alias("net")).where("net is not null")
    a = tr.vol_target(d, n=20).orderBy("date").collect()
    b = tr.vol_target(d.withColumn("net", F.when(F.col("date") == a[-1].date, 9.0).otherwise(F.col("net"))), n=20).orderBy("date").collect()
    assert a[-1].leverage == b[-1].leverage and all(x.leverage == 1.0 for x in a[:20])


def test_state_machines():
    import pandas as pd

    g = pd.DataFrame({"z": [0, 2.5, 1.0, 0.4, -3.0, -5.0, None, -2.2]})
    assert kn.pair_trades("z")(g).tolist() == [0, -1, -1, 0, 1, 0, 0, 1]
    g = pd.DataFrame({"k": [0.5, 0.9, 0.75, 0.6, 0.1, 0.2, 0.4]})
    assert kn.hysteresis("k")(g).tolist() == [0, 1, 1, 0, -1, -1, 0]
    g = pd.DataFrame({"r": [0.0, -0.06, 0.01, 0.01, 0.0], "p": [1.0, 1.0, 1.0, -1.0, -1.0]})
    assert kn.stops("r", "p", 0.05)(g).tolist() == [1, 1, 0, -1, -1]
    assert kn.stops("r", "p", 0.05, lookahead=True)(g).tolist() == [1, 0, 0, -1, -1]
    g = pd.DataFrame({"r": [0.1, -0.05, 0.5, 0.5, 0.01]})
    assert kn.trailing_stop("r", 0.03, 2)(g).tolist() == [0.1, -0.05, 0, 0, 0.01]


def test_path_dependent_book_without_paths_is_the_plain_one(panel):
    d = bk.simulate(panel, bk.Rules(top=2, every=1, cost_bps=0)).orderBy("date").toPandas()
    q = w.top_k(panel, "signal", "top", 2).withColumn("position", F.when(F.col("top"), 0.5).otherwise(0.0))
    plain = tr.backtest(q, cost_bps=0).orderBy("date").toPandas()
    np.testing.assert_allclose(d["gross"], plain["gross"], atol=1e-12)


def test_ridge_equals_normal_equations(panel):
    q = panel.withColumn("x2", w.rsum("ret", 5)).dropna(subset=["signal", "x2", "fwd"])
    row = ml.gram(q.withColumn("g", F.lit(1)), ["signal", "x2"], "fwd", ("g",)).first()
    beta, intercept = ml.solve_ridge(row, 2, 3.0)
    p = q.toPandas()
    x, y = p[["signal", "x2"]].to_numpy(), p["fwd"].to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    expected = np.linalg.solve(z.T @ z + 3 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    np.testing.assert_allclose(beta, expected, rtol=1e-6)
    assert abs(intercept - (y.mean() - expected @ x.mean(0))) < 1e-9


def test_walk_forward_never_trains_on_the_future(panel):
    folds = ml.folds(panel, start=60, step=20, embargo=5)
    rows = folds.orderBy("fold").collect()
    assert rows and all(r.train_to + 5 < r.test_from for r in rows) and [r.fold for r in rows] == list(range(len(rows)))
    out = ml.walk_forward_ridge(panel.withColumn("x2", w.rsum("ret", 5)), ["signal", "x2"], "fwd", folds)
    assert out.count() > 0 and out.groupBy("ticker", "date").count().where("count > 1").isEmpty()


def test_hmm_finds_two_levels_of_risk():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.01, 300), rng.normal(0, 0.05, 300)])
    _, var, step, _ = md.fit_hmm(x, 2)
    assert 0.5e-4 < var[0] < 2e-4 and 1.5e-3 < var[1] < 4e-3 and step.sum(1).round(6).tolist() == [1, 1]
