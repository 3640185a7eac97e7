"""Queries of recursions, graphs, learning, tests, pairs and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.shared import scratch
from strandline.operators import cointegration as co
from strandline.operators import features as fe
from strandline.operators import graphs as gr
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import models as md
from strandline.operators import scans as sc
from strandline.operators import stats as st
from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.plans.registry import PX, R, TICKER, query, rank, roll, table_query
from strandline.plans.research import K, SIG, book, daily, signals
from strandline.streaming import online


def _past(x: str, base: str) -> str:
    """A CTE l: for each row the list of the ticker's values up to it; one ordered list a ticker, cut at the row's count."""
    return (
        f", q AS (SELECT ticker, list({x} ORDER BY date) FILTER ({x} IS NOT NULL) AS a FROM {base} GROUP BY ticker), "
        f"c AS (SELECT ticker, date, count({x}) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS n FROM {base}), l AS (SELECT c.ticker, c.date, CASE WHEN n > 0 THEN a[1:n] END AS l FROM c LEFT JOIN q USING (ticker))"
    )


@query("w11_ewm", f"WITH {R}{_past('ret', 'r')} SELECT ticker, date, round(list_reduce(l, lambda a, b: 0.8 * a + 0.2 * b), 6) + 0.0 AS ewm FROM l")
def _(p):
    return sc.ewm(p.select(*K, "ret"), "ewm", "ret", alpha=0.2).select(*K, "ewm")


@query("w12_ewm_adjusted", f"WITH {R}{_past('ret', 'r')} SELECT ticker, date, round(list_reduce(l, lambda a, b: a * pow(2, -1.0 / 5) + b) / list_reduce(list_transform(l, lambda v: CAST(1 AS DOUBLE)), lambda a, b: a * pow(2, -1.0 / 5) + b), 6) + 0.0 AS ewm FROM l")
def _(p):
    return sc.ewm(p.select(*K, "ret"), "ewm", "ret", adjust=True, halflife=5).select(*K, "ewm")


@query("w13_recursive_decay", f"WITH {R}{_past('ret', 'r')} SELECT ticker, date, round(list_reduce(l, lambda a, b: 0.7 * a + 0.3 * b), 6) + 0.0 AS s FROM l")
def _(p):
    return sc.scan(p.select(*K, "ret"), {"s": sc.decay("ret", 0.3)}).select(*K, "s")


@query("ss1_kalman_level")
def _(p):
    return sc.kalman_level(p.select(*K, F.ln("close").alias("lp")), "trend", "lp").select(*K, "trend", (F.col("trend") - F.col("lp")).alias("deviation"))


@query("ss2_kalman_trend")
def _(p):
    return kn.along(p.select(*K, F.ln("close").alias("lp")), {"level": kn.kalman_trend("lp"), "velocity": kn.kalman_trend("lp", velocity=True)}).select(*K, "level", "velocity")


@query("ss3_kalman_diagnostics")
def _(p):
    return kn.along(p.select(*K, F.ln("close").alias("lp")), kn.kalman_diagnostics("lp", 1e-5, 1e-2)).select(*K, "innovation", "innovation_var", "loglik")


@query("fe4_kalman_features")
def _(p):
    q = sc.kalman_level(p.select(*K, F.ln("close").alias("lp")), "trend", "lp")
    q = q.withColumn("kalman_trend", F.col("trend") - F.col("lp")).withColumn("kalman_slope", w.diff("trend", 5))
    return q.select(*K, "kalman_trend", w.zscore("kalman_trend", 63, eps=1e-10).alias("kalman_zscore"), "kalman_slope", w.diff("kalman_slope", 5).alias("kalman_curvature"), F.abs("kalman_trend").alias("kalman_deviation"))


@query("sg5_ema_signal", f"WITH {SIG}{_past('signal', 'g')} SELECT ticker, date, round(list_reduce(l, lambda a, b: a * (1 - 2.0 / 11) + b * 2.0 / 11), 6) + 0.0 AS smooth FROM l")
def _(p):
    return sc.ewm(signals(p).select(*K, "signal"), "smooth", "signal", span=10).select(*K, "smooth")


@query("sg6_adaptive_ema")
def _(p):
    q = fe.add(signals(p), fe.volatility()).withColumn("alpha", F.when(F.col("vol_regime") > 0, 0.1).otherwise(0.3))
    return sc.scan(q.select(*K, "signal", "alpha"), {"smooth": sc.decay("signal", F.col("alpha"))}).select(*K, "smooth")


@query("sg7_hysteresis")
def _(p):
    q = signals(p).withColumn("k", w.pct_rank("signal")).select(*K, "k")
    return kn.along(q, {"position": kn.hysteresis("k")}).select(*K, "position")


@query("bt11_stop_loss")
def _(p):
    q = kn.along(book(p).select(*K, "ret", "position"), {"stopped": kn.stops("ret", "position", 0.5)})
    return tr.backtest(q, "stopped").select("date", "gross", "turnover", "net")


@query("bt13_trailing_stop")
def _(p):
    d = daily(p).withColumn("strategy", F.lit("equal"))
    return kn.along(d, {"stopped": kn.trailing_stop("net", 0.01)}, "strategy").select("date", "stopped")


@query("ps8_smoothed_weights")
def _(p):
    q = sc.scan(book(p).select(*K, "position"), {"smooth": sc.decay("position", 0.2)})
    return q.select(*K, tr.l1("smooth").alias("position"))


# -- graphs ------------------------------------------------------------------------------------------------

_N = PX + ", n AS (SELECT ticker, date, close AS x, row_number() OVER (PARTITION BY ticker ORDER BY date) - 1 AS i FROM px)"
_HVG = _N + """, e AS (SELECT *, ta AS ti, tb AS tj FROM (
    SELECT a.ticker, CAST(a.i AS INTEGER) AS i, CAST(min(b.i) AS INTEGER) AS j, any_value(a.date) AS ta, arg_min(b.date, b.i) AS tb FROM n a JOIN n b ON a.ticker = b.ticker AND b.i > a.i AND b.x >= a.x GROUP BY a.ticker, a.i
    UNION SELECT b.ticker, CAST(max(a.i) AS INTEGER), CAST(b.i AS INTEGER), arg_max(a.date, a.i), any_value(b.date) FROM n a JOIN n b ON a.ticker = b.ticker AND b.i > a.i AND a.x >= b.x GROUP BY b.ticker, b.i))"""
_DEG = ", g AS (SELECT ticker, node, count(*) AS degree FROM (SELECT ticker, i AS node FROM e UNION ALL SELECT ticker, j FROM e) GROUP BY 1, 2)"


@query("gr1_horizontal_edges", f"WITH {_HVG} SELECT ticker, i, j, ti, tj FROM e")
def _(p):
    return gr.horizontal_edges(p, "close")


@query("gr1_natural_edges", f"WITH {_N}, pairs AS (SELECT a.ticker, a.i, b.i AS j, a.date AS ti, b.date AS tj, (b.x - a.x) / (b.i - a.i) AS slope FROM n a JOIN n b ON a.ticker = b.ticker AND b.i > a.i), top AS (SELECT *, max(slope) OVER (PARTITION BY ticker, i ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pairs) SELECT ticker, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, ti, tj FROM top WHERE top IS NULL OR slope > top")
def _(p):
    return gr.natural_edges(p, "close")


@query("gr2_weighted_edges", f"WITH {_HVG} SELECT e.ticker, e.i, e.j, round(atan2(b.x - a.x, e.j - e.i), 6) + 0.0 AS weight FROM e JOIN n a ON a.ticker = e.ticker AND a.i = e.i JOIN n b ON b.ticker = e.ticker AND b.i = e.j")
def _(p):
    return gr.weighted(gr.horizontal_edges(p, "close"), p, "close").select("ticker", "i", "j", "weight")


@query("gr3_degrees", f"WITH {_HVG}{_DEG} SELECT ticker, node, degree FROM g")
def _(p):
    return gr.degrees(gr.horizontal_edges(p, "close"))


@query("gr4_degree_statistics", f"WITH {_HVG}{_DEG}, p AS (SELECT ticker, degree, count(*) / sum(count(*)) OVER (PARTITION BY ticker) AS p FROM g GROUP BY 1, 2), h AS (SELECT ticker, -sum(p * log2(p + 1e-10)) AS degree_entropy FROM p GROUP BY 1), s AS (SELECT ticker, count(*) AS num_nodes, CAST(sum(degree) / 2 AS BIGINT) AS num_edges, avg(degree) AS degree_mean, stddev_pop(degree) AS degree_std, max(degree) AS degree_max, 1 + count(*) / sum(ln(degree / 0.5)) AS gamma FROM g GROUP BY 1) SELECT s.ticker, num_nodes, num_edges, round(degree_mean, 6) + 0.0 AS degree_mean, round(degree_std, 6) + 0.0 AS degree_std, degree_max, round(gamma, 6) + 0.0 AS gamma, round(2.0 * num_edges / (num_nodes * (num_nodes - 1)), 6) + 0.0 AS density, round(degree_entropy, 6) + 0.0 AS degree_entropy FROM s JOIN h USING (ticker)")
def _(p):
    return gr.degree_statistics(gr.horizontal_edges(p, "close")).drop("degree_skew")


@query("gr6_clustering", f"WITH {_HVG}{_DEG}, t AS (SELECT a.ticker, a.i AS p, a.j AS q, b.j AS r FROM e a JOIN e b ON a.ticker = b.ticker AND a.j = b.i JOIN e c ON c.ticker = a.ticker AND c.i = a.i AND c.j = b.j), v AS (SELECT ticker, node, count(*) AS t FROM (SELECT ticker, unnest([p, q, r]) AS node FROM t) GROUP BY 1, 2), l AS (SELECT g.ticker, coalesce(v.t, 0) AS t, degree FROM g LEFT JOIN v ON v.ticker = g.ticker AND v.node = g.node) SELECT ticker, CAST(sum(t) / 3 AS BIGINT) AS triangles, round(avg(CASE WHEN degree > 1 THEN 2.0 * t / (degree * (degree - 1)) ELSE 0.0 END), 6) + 0.0 AS clustering FROM l GROUP BY ticker")
def _(p):
    return gr.clustering(gr.horizontal_edges(p, "close"))


@query("gr8_paths")
def _(p):
    return gr.path_lengths(gr.horizontal_edges(p, "close"))


@query("gr9_assortativity", f"WITH {_HVG}{_DEG} SELECT e.ticker, round(corr(a.degree, b.degree), 5) + 0.0 AS assortativity FROM e JOIN g a ON a.ticker = e.ticker AND a.node = e.i JOIN g b ON b.ticker = e.ticker AND b.node = e.j GROUP BY 1", digits=5)
def _(p):
    return gr.assortativity(gr.horizontal_edges(p, "close"))


@query("gr10_rolling_features", f"WITH {_HVG}, x AS (SELECT n.ticker, n.date, n.i, count(*) AS edges FROM n JOIN e ON e.ticker = n.ticker AND n.i BETWEEN e.j AND e.i + 9 WHERE n.i >= 9 GROUP BY 1, 2, 3) SELECT ticker, date, edges, round(2.0 * edges / 10, 6) + 0.0 AS degree_mean, round(2.0 * edges / 90, 6) + 0.0 AS density FROM x")
def _(p):
    return gr.rolling_features(p, "close", 10)


_WIN = _HVG + """, h AS (SELECT ticker, i, j, unnest(range(greatest(j, 19), i + 20)) AS "end" FROM e WHERE j - i <= 19), d AS (SELECT ticker, "end", node, count(*) AS d FROM (SELECT ticker, "end", i AS node FROM h UNION ALL SELECT ticker, "end", j FROM h) GROUP BY ALL),
    s AS (SELECT ticker, "end", d, count(*) AS c FROM d GROUP BY ALL), u AS (SELECT ticker, "end", CAST(sum(c * d) / 2 AS BIGINT) AS edges, max(d) AS degree_max, 1 + sum(c) / sum(c * ln(d / 0.5)) AS gamma, -sum(c / 20 * log2(c / 20 + 1e-10)) AS entropy, sum(c * d * (d - 1) / 2) AS paths FROM s GROUP BY ALL),
    v AS (SELECT ticker, "end", stddev_pop(d) AS degree_std FROM d GROUP BY ALL), t AS (SELECT ticker, "end", count(*) AS t FROM (SELECT a.ticker, unnest(range(greatest(b.j, 19), a.i + 20)) AS "end" FROM e a JOIN e b ON a.ticker = b.ticker AND a.j = b.i JOIN e c ON c.ticker = a.ticker AND c.i = a.i AND c.j = b.j WHERE b.j - a.i <= 19) GROUP BY ALL),
    z AS (SELECT h.ticker, h."end", covar_pop(a.d, b.d) / nullif(stddev_pop(a.d) * stddev_pop(b.d), 0) AS assortativity FROM h JOIN d a ON a.ticker = h.ticker AND a."end" = h."end" AND a.node = h.i JOIN d b ON b.ticker = h.ticker AND b."end" = h."end" AND b.node = h.j GROUP BY ALL),
    w AS (SELECT n.ticker, n.date, u.edges, 2.0 * u.edges / 380 AS density, degree_std, degree_max, gamma, entropy, coalesce(9.0 * t / paths, 0) AS clustering, coalesce(assortativity, 0) AS assortativity FROM n JOIN u ON u.ticker = n.ticker AND u."end" = n.i JOIN v ON v.ticker = n.ticker AND v."end" = n.i LEFT JOIN t ON t.ticker = n.ticker AND t."end" = n.i JOIN z ON z.ticker = n.ticker AND z."end" = n.i)"""


@query("gr10_rolling_statistics", f"WITH {_WIN} SELECT ticker, date, edges, degree_max, " + ", ".join(f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in "density degree_std gamma entropy clustering assortativity".split()) + " FROM w")
def _(p):
    return gr.rolling_statistics(p, "close")


_COMPOSITE = _WIN.replace(PX, R, 1) + """, o AS (SELECT ticker, date, sign(CASE WHEN count(ret) OVER k >= 20 THEN avg(ret) OVER k END) AS way, count(*) OVER (PARTITION BY ticker) AS rows FROM r WINDOW k AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING)),
    q AS (SELECT ticker, date, greatest(least((greatest(least((2.5 - gamma) / 2.5, 1), -1) * 0.5 + greatest(least((2 - entropy) / 2, 1), -1) * 0.3 + (clustering / (clustering + 0.3) - 0.5) * 0.4) * way, 1), -1) AS raw FROM w JOIN o USING (ticker, date) WHERE rows >= 30 AND way IS NOT NULL
        UNION ALL SELECT ticker, date, NULL FROM w JOIN o USING (ticker, date) WHERE rows >= 30 AND way IS NULL),
    g AS (SELECT ticker, date, raw, greatest(least(avg(raw) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING), 1), -1) AS signal0 FROM q), g2 AS (SELECT ticker, date, raw, CASE WHEN count(raw) OVER (PARTITION BY ticker ORDER BY date ROWS 4 PRECEDING) > 0 THEN signal0 END AS signal FROM g)"""


@query("sg13_composite_universe", f"WITH {_COMPOSITE} SELECT ticker, date, round(raw, 5) + 0.0 AS raw, round(signal, 5) + 0.0 AS signal FROM g2", digits=5)
def _(p):
    return gr.composite_signal(p, "close")


@query("sg13_signal_quality", f"WITH {_COMPOSITE}, x AS (SELECT ticker, date, lead(ret) OVER ({TICKER}) AS fwd FROM r), y AS (SELECT g2.ticker, signal, fwd, lag(signal) OVER (PARTITION BY g2.ticker ORDER BY g2.date) AS b FROM g2 JOIN x USING (ticker, date)) SELECT ticker, count(signal) AS n, " + ", ".join(f"round(CAST({v} AS DOUBLE), 5) + 0.0 AS {c}" for c, v in {"ic": "covar_pop(signal, fwd) FILTER (signal IS NOT NULL AND fwd IS NOT NULL) / nullif(stddev_pop(signal) FILTER (signal IS NOT NULL AND fwd IS NOT NULL) * stddev_pop(fwd) FILTER (signal IS NOT NULL AND fwd IS NOT NULL), 0)", "hit_rate": "avg(CASE WHEN coalesce(sign(signal) = sign(fwd), false) THEN 1.0 ELSE 0.0 END)", "turnover": "avg(abs(signal - b))", "cost": "avg(abs(signal - b)) * 0.252", "stay": "covar_pop(signal, b) FILTER (signal IS NOT NULL AND b IS NOT NULL) / nullif(stddev_pop(signal) FILTER (signal IS NOT NULL AND b IS NOT NULL) * stddev_pop(b) FILTER (signal IS NOT NULL AND b IS NOT NULL), 0)", "mean": "avg(signal)", "std": "stddev_samp(signal)"}.items()) + " FROM y GROUP BY ticker", digits=5)
def _(p):
    return gr.signal_quality(gr.composite_signal(p, "close"), p.withColumn("fwd", w.lag("ret", -1)), "fwd")


@query("gr3_spectrum")
def _(p):
    return gr.spectrum(gr.horizontal_edges(p, "close"))


# -- learning ------------------------------------------------------------------------------------------------

_F = ("m5", "m21")
#: Models that aren't walked forward are fitted on the rows before this date, and predict all rows.
FIT_UNTIL = "1995-07-01"


def learnable(p):
    return p.withColumns({"m5": w.rsum("ret", 5), "m21": w.rsum("ret", 21), "y": w.lag("ret", -1)})


@query("ml1_folds", f"WITH {PX}, n AS (SELECT count(DISTINCT date) AS n FROM px), c AS (SELECT unnest(range(252, n - 5, 21)) AS cut FROM n) SELECT CAST((cut - 252) / 21 AS INTEGER) AS fold, CAST(greatest(cut - 504, 0) AS INTEGER) AS train_from, CAST(cut - 1 AS INTEGER) AS train_to, CAST(cut + 5 AS INTEGER) AS test_from, CAST(cut + 25 AS INTEGER) AS test_to FROM c")
def _(p):
    return ml.folds(p, history=504)


@query("ml3_standard_scale", f"WITH {R}, s AS (SELECT avg(ret) AS m, stddev_pop(ret) AS d FROM r WHERE date < DATE '1996-01-01') SELECT ticker, date, round((ret - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 6) + 0.0 AS ret FROM r, s")
def _(p):
    return ml.standard_scale(p, ["ret"], F.col("date") < F.lit("1996-01-01").cast("date")).select(*K, "ret")


@query("ml4_ridge_fold_gram", f"WITH {R}, g AS (SELECT *, {roll('sum', 'ret', 5)} AS m5, lead(ret) OVER ({TICKER}) AS y FROM r), f AS (SELECT CAST(year(date) AS INTEGER) AS fold, regr_slope(y, m5) AS slope, regr_intercept(y, m5) AS intercept, count(*) AS n FROM g WHERE m5 IS NOT NULL AND y IS NOT NULL GROUP BY 1) SELECT fold, n, round(slope, 5) + 0.0 AS slope, round(intercept, 5) + 0.0 AS intercept FROM f", digits=5)
def _(p):
    g = ml.gram(learnable(p).withColumn("fold", F.year("date")), ["m5"], "y", ("fold",))
    var = F.col("sxx")[0] - F.col("sx")[0] * F.col("sx")[0] / F.col("sw")
    slope = (F.col("sxy")[0] - F.col("sx")[0] * F.col("sy") / F.col("sw")) / var
    return g.select("fold", "n", slope.alias("slope"), (F.col("sy") / F.col("sw") - slope * F.col("sx")[0] / F.col("sw")).alias("intercept"))


@query("ml9_walk_forward_ridge")
def _(p):
    q = learnable(p)
    return ml.walk_forward_ridge(q, _F, "y", ml.folds(q, step=63, history=504))


@query("ml6_boosted_trees")
def _(p):
    return ml.boosted_trees(learnable(p), _F, "y", F.col("date") < F.lit(FIT_UNTIL).cast("date"))[0].select(*K, "prediction")


@query("ml7_logistic")
def _(p):
    q = learnable(p).withColumn("label", tr.three_classes("y", 0.05).cast("double"))
    return ml.logistic(q, _F, "label", F.col("date") < F.lit(FIT_UNTIL).cast("date")).select(*K, F.col("probability")[0].alias("p_down"), F.col("probability")[2].alias("p_up"))


@query("ml12_residuals", f"WITH {R}, a AS (SELECT ticker, ret, lag(ret) OVER ({TICKER}) AS l FROM r) SELECT ticker, count(ret) AS n, round(corr(ret, l) FILTER (ret IS NOT NULL AND l IS NOT NULL), 5) + 0.0 AS ac1 FROM a GROUP BY ticker", digits=5)
def _(p):
    a = p.withColumn("l", w.lag("ret"))
    return a.groupBy("ticker").agg(F.count("ret").alias("n"), tr.safe_corr("ret", "l").alias("ac1"))


# -- tests ---------------------------------------------------------------------------------------------------


@query("st1_permutation")
def _(p):
    return st.permutation_test(signals(p), "signal", "fwd")


@query("st2_bootstrap")
def _(p):
    return st.bootstrap_mean(daily(p), "net")


@query("st2_sharpe_interval")
def _(p):
    return st.bootstrap_sharpe(daily(p), "net")


@query("st3_t_test", f"WITH {R} SELECT ticker, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 6) + 0.0 AS t FROM r GROUP BY ticker")
def _(p):
    return p.groupBy("ticker").agg(*st.t_test("ret"))


@query("st3_jarque_bera", f"WITH {R}, m AS (SELECT ticker, ret, avg(ret) OVER (PARTITION BY ticker) AS a FROM r WHERE ret IS NOT NULL), k AS (SELECT ticker, count(*) AS n, avg(pow(ret - a, 2)) AS m2, avg(pow(ret - a, 3)) AS m3, avg(pow(ret - a, 4)) AS m4 FROM m GROUP BY 1) SELECT ticker, round(n / 6.0 * (pow(m3 / pow(m2, 1.5), 2) + pow(m4 / (m2 * m2) - 3, 2) / 4), 2) + 0.0 AS jb FROM k", digits=2)
def _(p):
    return p.groupBy("ticker").agg(st.jarque_bera("ret").alias("jb"))


@query("st3_autocorrelation", f"WITH {R}, a AS (SELECT ticker, ret, lag(ret, 1) OVER ({TICKER}) AS l1, lag(ret, 5) OVER ({TICKER}) AS l5 FROM r), u AS (SELECT ticker, ret, CAST(1 AS INTEGER) AS lag, l1 AS y FROM a UNION ALL SELECT ticker, ret, 5, l5 FROM a) SELECT ticker, lag, count(*) AS n, round(corr(ret, y), 5) + 0.0 AS ac FROM u WHERE ret IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2", digits=5)
def _(p):
    return st.autocorrelation(p, "ret", (1, 5))


@query("st4_quality_checks", f"WITH {R}, o AS (SELECT count_if(close IS NULL) / count(*) AS missing, count_if(abs(ret) > 0.5) / count(ret) AS extreme, count_if(ret = 0) / count(ret) AS zero, count_if(high < low OR high < close OR low > close OR high < open OR low > open) / count(*) AS inconsistent FROM r), u AS (SELECT 'missing' AS \"check\", missing AS value, 0.01 AS a, 0.05 AS f FROM o UNION ALL SELECT 'extreme', extreme, 0.0005, 0.001 FROM o UNION ALL SELECT 'zero', zero, 0.1, 0.2 FROM o UNION ALL SELECT 'inconsistent', inconsistent, 0, 0 FROM o) SELECT \"check\", round(CAST(value AS DOUBLE), 6) + 0.0 AS value, CASE WHEN value > f THEN 'FAIL' WHEN value > a THEN 'WARN' ELSE 'PASS' END AS status FROM u")
def _(p):
    return st.quality_checks(p)


@query("st8_outliers", f"WITH {R}, q AS (SELECT ticker, ret, quantile_cont(ret, 0.25) OVER t AS q1, quantile_cont(ret, 0.75) OVER t AS q3, avg(ret) OVER t AS m, stddev_samp(ret) OVER t AS s FROM r WINDOW t AS (PARTITION BY ticker)) SELECT ticker, CAST(coalesce(count_if(abs(ret - m) > 3 * s), 0) AS BIGINT) AS by_z, CAST(coalesce(count_if(ret < q1 - 3 * (q3 - q1) OR ret > q3 + 3 * (q3 - q1)), 0) AS BIGINT) AS by_iqr FROM q GROUP BY ticker")
def _(p):
    return st.outliers(p, "ret", z=3.0)


@query("co1_dickey_fuller")
def _(p):
    return st.dickey_fuller(p.withColumn("lp", F.ln("close")), "lp")


_LP_PAIR = PX + ", l AS (SELECT ticker, date, ln(close) AS lp FROM px), b AS (SELECT a.ticker AS asset1, b.ticker AS asset2, a.date, a.lp AS lp1, b.lp AS lp2 FROM l a JOIN l b ON a.date = b.date AND a.ticker < b.ticker), f AS (SELECT asset1, asset2, regr_slope(lp1, lp2) AS h, regr_intercept(lp1, lp2) AS c, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT b.*, h, lp1 - h * lp2 - c AS spread FROM b JOIN f USING (asset1, asset2) WHERE n >= 100)"


@query("co1_half_lives", f"WITH {_LP_PAIR}, d AS (SELECT *, lag(spread) OVER (PARTITION BY asset1, asset2 ORDER BY date) AS before FROM s), q AS (SELECT asset1, asset2, max(h) AS h, regr_slope(spread - before, before) AS speed, stddev_samp(spread) AS sd, count(before) AS n FROM d GROUP BY 1, 2) SELECT asset1, asset2, round(h, 5) + 0.0 AS hedge_ratio, round(speed, 5) + 0.0 AS speed, round(sd, 5) + 0.0 AS spread_std, n, round(CASE WHEN speed < 0 THEN -ln(2) / speed END, 5) + 0.0 AS half_life FROM q", digits=5)
def _(p):
    return md.half_lives(md.pair_spreads(p))


_NAMES6 = ("d1", "d2", "p1", "p2", "e1", "e2")
_COV = ", ".join(f"covar_pop({a}, {b}) OVER m AS {a}{b}" for i, a in enumerate(_NAMES6) for b in _NAMES6[i:])
_FORM = {k: f"({x}1{y}1 - h * ({x}1{y}2 + {z}) + h * h * {x}2{y}2)" for k, x, y, z in (("dd", "d", "d", "d1d2"), ("pp", "p", "p", "p1p2"), ("ee", "e", "e", "e1e2"), ("dp", "d", "p", "d2p1"), ("de", "d", "e", "d2e1"), ("pe", "p", "e", "p2e1"))}


@query("co1_rolling_cointegration", f"""WITH {R}, c AS (SELECT a.ticker AS t1, b.ticker AS t2, round(covar_pop(a.ret, b.ret) / (stddev_pop(a.ret) * stddev_pop(b.ret)), 9) AS c FROM r a JOIN r b ON a.date = b.date AND a.ticker < b.ticker AND a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100),
    w AS (SELECT t1, t2, c FROM c UNION ALL SELECT t2, t1, c FROM c), k AS (SELECT t1, t2 FROM w QUALIFY row_number() OVER (PARTITION BY t1 ORDER BY c DESC, t2) <= 2), pairs AS (SELECT DISTINCT least(t1, t2) AS asset1, greatest(t1, t2) AS asset2 FROM k),
    b AS (SELECT asset1, asset2, x.date, ln(x.close) AS lp1, ln(y.close) AS lp2 FROM pairs JOIN px x ON x.ticker = asset1 JOIN px y ON y.ticker = asset2 AND y.date = x.date),
    l AS (SELECT *, lag(lp1) OVER t AS p1, lag(lp2) OVER t AS p2, row_number() OVER t AS row FROM b WINDOW t AS (PARTITION BY asset1, asset2 ORDER BY date)),
    d AS (SELECT *, lp1 - p1 AS d1, lp2 - p2 AS d2 FROM l), e AS (SELECT *, lag(d1) OVER t AS e1, lag(d2) OVER t AS e2 FROM d WINDOW t AS (PARTITION BY asset1, asset2 ORDER BY date)),
    v AS (SELECT asset1, asset2, date, row, covar_pop(lp1, lp2) OVER n / var_pop(lp2) OVER n AS h, {_COV} FROM e WINDOW n AS (PARTITION BY asset1, asset2 ORDER BY date ROWS 251 PRECEDING), m AS (PARTITION BY asset1, asset2 ORDER BY date ROWS 249 PRECEDING)),
    f AS (SELECT asset1, asset2, date, h, {", ".join(f"{v} AS {k}" for k, v in _FORM.items())} FROM v WHERE row >= 252), s AS (SELECT *, (dp * ee - de * pe) / (pp * ee - pe * pe) AS bv, (de * pp - dp * pe) / (pp * ee - pe * pe) AS bd FROM f),
    q AS (SELECT *, bv / sqrt((dd - bv * dp - bd * de) * 250 / 247 * ee / (250 * (pp * ee - pe * pe))) AS t FROM s)
    SELECT asset1, asset2, date, round(h, 5) + 0.0 AS hedge_ratio, round(bv, 5) + 0.0 AS speed, round(CASE WHEN bv < 0 AND bv > -1 THEN -ln(2) / ln(1 + bv) END, 5) + 0.0 AS half_life, round(t, 5) + 0.0 AS stat, t < -3.34 AS cointegrated FROM q""", digits=5)
def _(p):
    return co.rolling_cointegration(co.pair_prices(p, co.screened_pairs(p)))


@query("bt18_pair_positions")
def _(p):
    return md.pair_positions(md.pair_spreads(p))


@query("ss5_kalman_pairs")
def _(p):
    return md.kalman_pair(md.pair_spreads(p)).select("asset1", "asset2", "date", "alpha", "beta", "error")


@query("co2_lead_lag", f"WITH {R}, l AS (SELECT ticker, date, unnest([0, 1, 2]) AS lag, unnest([ret, lag(ret, 1) OVER ({TICKER}), lag(ret, 2) OVER ({TICKER})]) AS y FROM r) SELECT a.ticker AS asset1, l.ticker AS asset2, CAST(l.lag AS INTEGER) AS lag, round(corr(a.ret, l.y) FILTER (a.ret IS NOT NULL AND l.y IS NOT NULL), 5) + 0.0 AS corr FROM r a JOIN l ON l.date = a.date AND l.ticker <> a.ticker GROUP BY 1, 2, 3", digits=5)
def _(p):
    return md.lead_lag(p, 2)


@query("fe32_average_correlation", digits=5)
def _(p):
    return md.average_correlation(p)


@query("fe26_factors", digits=4)
def _(p):
    return md.factors(p)


@query("co3_clusters")
def _(p):
    return md.ward_clusters(p)


@query("hm1_parameters", digits=4)
def _(p):
    return md.hmm_parameters(p)


@query("hm2_recent_states", digits=4)
def _(p):
    return md.hmm_features(p)


@query("hm2_regimes")
def _(p):
    return md.hmm_regimes(p).select(*K, "regime", F.col("probabilities")[0].alias("p_calm"))


# -- calendars and exploration -------------------------------------------------------------------------------


@query("ed1_coverage", f"WITH {R}, d AS (SELECT count(DISTINCT date) AS k FROM r) SELECT ticker, min(date) AS first_date, count(close) AS n, round(count(close) / max(k), 6) + 0.0 AS coverage FROM r, d GROUP BY ticker")
def _(p):
    days = p.agg(F.countDistinct("date").alias("k"))
    return p.join(F.broadcast(days)).groupBy("ticker").agg(F.min("date").alias("first_date"), F.count("close").alias("n"), (F.count("close") / F.max("k")).alias("coverage"))


@query("ed4_after_extreme_days", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), n AS (SELECT *, lead(mkt) OVER (ORDER BY date) AS next FROM m), q AS (SELECT quantile_cont(mkt, 0.05) AS q FROM m) SELECT mkt <= q AS crash, count(*) AS n, round(avg(next), 6) + 0.0 AS mean_next FROM n, q WHERE mkt IS NOT NULL GROUP BY 1")
def _(p):
    m = p.groupBy("date").agg(F.avg("ret").alias("mkt"))
    q = m.agg(F.percentile("mkt", 0.05).alias("q"))
    n = m.withColumn("next", F.lead("mkt").over(Window.partitionBy(F.lit(1)).orderBy("date"))).where("mkt is not null")
    return n.join(F.broadcast(q)).groupBy((F.col("mkt") <= F.col("q")).alias("crash")).agg(F.count(F.lit(1)).alias("n"), F.avg("next").alias("mean_next"))


@query("ed7_dispersion", f"WITH {R} SELECT date, round(stddev_samp(ret), 6) + 0.0 AS dispersion, round(max(ret) - min(ret), 6) + 0.0 AS range FROM r GROUP BY date")
def _(p):
    return p.groupBy("date").agg(F.stddev_samp("ret").alias("dispersion"), (F.max("ret") - F.min("ret")).alias("range"))


@query("ed7_rank_autocorrelation", f"WITH {R}, k AS (SELECT ticker, date, {rank('ret')} AS k FROM r), l AS (SELECT date, k, lag(k, 5) OVER ({TICKER}) AS b FROM k) SELECT date, count(*) AS n, CASE WHEN count(*) > 5 THEN round(corr(k, b), 5) + 0.0 END AS ac FROM l WHERE k IS NOT NULL AND b IS NOT NULL GROUP BY date", digits=5)
def _(p):
    q = p.withColumn("k", w.pct_rank("ret")).withColumn("b", w.lag("k", 5)).where("k is not null and b is not null")
    return q.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 5, tr.safe_corr("k", "b")).alias("ac"))


@query("ed8_volume_deciles", f"WITH {R}, b AS (SELECT *, list_sum(list_transform(quantile_cont(volume, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) OVER (), lambda e: CAST(volume > e AS INTEGER))) AS decile FROM r) SELECT CAST(decile AS INTEGER) AS decile, count(*) AS n, round(avg(abs(ret)), 6) + 0.0 AS mean_abs FROM b GROUP BY 1")
def _(p):
    edges = p.agg(F.percentile("volume", F.array(*(F.lit(i / 10) for i in range(1, 10)))).alias("edges"))
    b = p.join(F.broadcast(edges)).withColumn("decile", F.size(F.filter("edges", lambda e: e < F.col("volume"))))
    return b.groupBy("decile").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("ret")).alias("mean_abs"))


@query("ed9_calendar", f"WITH {R} SELECT CAST((dayofweek(date) + 6) % 7 AS INTEGER) AS weekday, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean_ret, round(avg(ret) / (stddev_samp(ret) / sqrt(count(ret))), 6) + 0.0 AS t FROM r GROUP BY 1")
def _(p):
    return p.groupBy(F.weekday("date").alias("weekday")).agg(*st.t_test("ret")).withColumnRenamed("mean", "mean_ret")


# -- streams ---------------------------------------------------------------------------------------------------


def _streamed(spark, path, build, mode="append", recursion=None):
    """All rows of a table through a streaming query that ends when they are read, written to files in the shared folder; with ``recursion`` also what waited at the end."""
    folder = scratch(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path.rsplit("/", 1)[0] + "/" + path.rsplit("/", 1)[1].replace(".parquet", "*.parquet"))
    rows = online.into_files(build(source), folder, mode)
    return rows.unionByName(online.drained(spark, f"{folder}/checkpoint", recursion)) if recursion else rows


def user_events(e):
    """ticker (the user), date (the instant), and the columns of events."""
    return e.select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("date"), "value")


@table_query("str1_event_windows", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, CAST(date_trunc('hour', ts) + INTERVAL 1 HOUR AS TIMESTAMP) AS \"end\", event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2, 3", digits=4)
def _(spark, sf_dir):
    return _streamed(spark, f"{sf_dir}/events.parquet", lambda e: online.event_windows(e), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@table_query("str2_online_smoothing", "WITH q AS (SELECT user_id, list(value ORDER BY ts, value) FILTER (value IS NOT NULL) AS a FROM events GROUP BY 1), c AS (SELECT user_id, ts, count(value) OVER (PARTITION BY user_id ORDER BY ts, value ROWS UNBOUNDED PRECEDING) AS n FROM events) SELECT CAST(user_id AS VARCHAR) AS ticker, CAST(ts AS TIMESTAMP) AS date, round(list_reduce(a[1:n], lambda x, y: 0.7 * x + 0.3 * y), 6) + 0.0 AS smoothed FROM c JOIN q USING (user_id)")
def _(spark, sf_dir):
    op = online.smoothing("value", 0.3)
    return _streamed(spark, f"{sf_dir}/events.parquet", lambda e: online.ordered(user_events(e), op), recursion=op).withColumn("date", F.col("date").cast("timestamp_ntz"))
