"""Queries of diagnostics, regimes, learning variants, books, sources and sinks, and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.scalars import flag, lunar_phase, turn_of_month
from strandline.functions.shared import scratch
from strandline.operators import books as bk
from strandline.operators import diagnostics as dg
from strandline.operators import features as fe
from strandline.operators import graphs as gr
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import models as md
from strandline.operators import scans as sc
from strandline.operators import stats as st
from strandline.operators import trades as td
from strandline.operators import trading as tr
from strandline.operators import walk_forward as wf
from strandline.operators import windows as w
from strandline.plans.kernels import _DEG, _HVG, _LP_PAIR, _streamed, learnable, user_events
from strandline.plans.recursions import _LEVEL, _LP, out, recursive
from strandline.plans.registry import PX, R, TICKER, lagged, query, rank, roll, table_query
from strandline.plans.research import _BOOK, _BOTH, _DAILY, _TOP, SIG, K, book, daily, signals
from strandline.sources import panel
from strandline.streaming import online

FIT_UNTIL = "1995-07-01"
_BACKTEST = f", h AS (SELECT *, coalesce({lagged('pos')}, 0) AS p FROM w), d AS (SELECT *, abs(p - {lagged('p')}) AS d FROM h), e AS (SELECT date, sum(p * coalesce(ret, 0)) AS gross, coalesce(sum(d), 0) AS turnover FROM d GROUP BY date)"
_NET = " SELECT date, round(CAST(gross AS DOUBLE), 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover, round(CAST(gross - turnover * 0.001 AS DOUBLE), 6) + 0.0 AS net FROM e"


# -- diagnostics and exploration --------------------------------------------------------------------------------


@query("st3_wilcoxon", f"WITH {R}, a AS (SELECT ticker, ret, abs(ret) AS a FROM r WHERE ret IS NOT NULL AND ret <> 0), k AS (SELECT ticker, ret, rank() OVER (PARTITION BY ticker ORDER BY a) + (count(*) OVER (PARTITION BY ticker, a) - 1) / 2.0 AS k FROM a), g AS (SELECT ticker, count(*) AS n, coalesce(sum(k) FILTER (ret > 0), 0) AS w FROM k GROUP BY 1) SELECT ticker, n, round(w, 4) + 0.0 AS w_plus, round((w - n * (n + 1) / 4.0) / sqrt(n * (n + 1) * (2 * n + 1) / 24.0), 4) + 0.0 AS z FROM g", digits=4)
def _(p):
    return dg.wilcoxon(p, "ret")


@query("st3_paired_and_two_sample", f"WITH {R}, m AS (SELECT ticker, ret - avg(ret) OVER (PARTITION BY date) AS x, volume, ret FROM r), g AS (SELECT ticker, avg(x) / (stddev_samp(x) / sqrt(count(x))) AS paired, avg(volume) FILTER (ret > 0) AS a, avg(volume) FILTER (ret <= 0) AS b, var_samp(volume) FILTER (ret > 0) / count(*) FILTER (ret > 0) + var_samp(volume) FILTER (ret <= 0) / count(*) FILTER (ret <= 0) AS v FROM m GROUP BY 1) SELECT ticker, round(paired, 5) + 0.0 AS paired, round((a - b) / sqrt(v), 5) + 0.0 AS welch FROM g", digits=5)
def _(p):
    x = F.col("ret") - F.avg("ret").over(w.section())
    up, down = F.when(F.col("ret") > 0, F.col("volume")), F.when(F.col("ret") <= 0, F.col("volume"))
    two = F.try_divide(F.avg(up) - F.avg(down), F.sqrt(F.try_divide(F.var_samp(up), F.count(up).cast("double")) + F.try_divide(F.var_samp(down), F.count(down).cast("double"))))
    return p.withColumn("x", x).groupBy("ticker").agg(F.try_divide(F.avg("x"), F.stddev_samp("x") / F.sqrt(F.count("x"))).alias("paired"), two.alias("welch"))


@query("st6_lookahead", f"WITH {SIG}, x AS (SELECT fwd, signal, {roll('stddev_samp', 'ret', 21)} AS vol FROM g) SELECT 'signal' AS feature, round(corr(signal, fwd) FILTER (signal IS NOT NULL AND fwd IS NOT NULL), 5) + 0.0 AS corr, abs(corr(signal, fwd)) > 0.5 AS suspicious FROM x UNION ALL SELECT 'vol', round(corr(vol, fwd) FILTER (vol IS NOT NULL AND fwd IS NOT NULL), 5) + 0.0, abs(corr(vol, fwd)) > 0.5 FROM x", digits=5)
def _(p):
    return dg.lookahead(signals(p).withColumn("vol", w.std("ret", 21)), ["signal", "vol"], "fwd")


@query("st6_target", f"WITH {SIG}, x AS (SELECT fwd, lag(fwd) OVER ({TICKER}) AS b FROM g) SELECT count(fwd) AS n, round((count(*) - count(fwd)) / count(*), 6) + 0.0 AS missing, round(avg(fwd), 6) + 0.0 AS mean, round(stddev_samp(fwd), 6) + 0.0 AS std, round(avg(fwd) / stddev_samp(fwd), 6) + 0.0 AS snr, round(corr(fwd, b) FILTER (fwd IS NOT NULL AND b IS NOT NULL), 6) + 0.0 AS ac1 FROM x")
def _(p):
    return dg.target_diagnostics(signals(p), "fwd")


@query("st6_predictions", f"WITH {SIG}{_BOTH}, e AS (SELECT signal, fwd, fwd - signal AS e, lag(fwd - signal) OVER ({TICKER}) AS b FROM b), i AS (SELECT avg(ic) AS m, avg(ic) / stddev_samp(ic) AS ir FROM ic) SELECT count(*) AS n, round(corr(signal, fwd), 5) + 0.0 AS corr, round(var_samp(signal) / var_samp(fwd), 5) + 0.0 AS variance_ratio, round(corr(e, b) FILTER (b IS NOT NULL), 5) + 0.0 AS residual_ac, round(max(m), 5) + 0.0 AS mean_ic, round(max(ir), 5) + 0.0 AS icir FROM e, i", digits=5)
def _(p):
    return dg.prediction_diagnostics(signals(p), "signal", "fwd")


@query("st6_overfit", f"WITH {SIG}{_BOTH}, o AS (SELECT avg(ic) FILTER (date < DATE '1996-01-01') AS i, avg(ic) FILTER (date >= DATE '1996-01-01') AS o FROM ic) SELECT round(i, 6) + 0.0 AS inside, round(o, 6) + 0.0 AS outside, round(i - o, 6) + 0.0 AS gap, CASE WHEN i - o > 0.1 THEN 'FAIL' WHEN i - o > 0.05 THEN 'WARN' ELSE 'PASS' END AS verdict FROM o")
def _(p):
    return dg.overfit(signals(p), "signal", "fwd", "1996-01-01")


@query("tg13_noise_floor", digits=5)
def _(p):
    return dg.noise_floor(signals(p), "signal", "fwd")


@query("st1_time_permutation")
def _(p):
    """Shuffled over all rows, not within dates."""
    return st.permutation_test(signals(p), "signal", "fwd", by=None)


@query("ed2_heterogeneity", f"WITH {R}, a AS (SELECT ticker, avg(ret) * 252 AS m, stddev_samp(ret) * sqrt(252) AS v FROM r GROUP BY 1) SELECT count(*) AS assets, " + ", ".join(f"round(quantile_cont({c}, {q}), 5) + 0.0 AS {c}_{int(q * 100)}" for c in "mv" for q in (0.05, 0.25, 0.5, 0.75, 0.95)) + ", round(stddev_samp(m), 5) + 0.0 AS m_std, round(stddev_samp(v), 5) + 0.0 AS v_std FROM a", digits=5)
def _(p):
    a = p.groupBy("ticker").agg((F.avg("ret") * 252).alias("m"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("v"))
    return a.agg(F.count(F.lit(1)).alias("assets"), *(F.percentile(c, q).alias(f"{c}_{int(q * 100)}") for c in "mv" for q in (0.05, 0.25, 0.5, 0.75, 0.95)), F.stddev_samp("m").alias("m_std"), F.stddev_samp("v").alias("v_std"))


@query("ed3_absolute_autocorrelation", f"WITH {R}, a AS (SELECT ticker, abs(ret) AS x, unnest([1, 2, 3, 5]) AS lag, unnest([lag(abs(ret), 1) OVER t, lag(abs(ret), 2) OVER t, lag(abs(ret), 3) OVER t, lag(abs(ret), 5) OVER t]) AS y FROM r WINDOW t AS ({TICKER})), c AS (SELECT ticker, lag, count(*) AS k, corr(x, y) AS c FROM a WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2), n AS (SELECT ticker, count(ret) AS n FROM r GROUP BY 1) SELECT ticker, round(max(c) FILTER (lag = 1), 5) + 0.0 AS ac1, round(max(n) * (max(n) + 2) * sum(c * c / (n - lag)), 3) + 0.0 AS q FROM c JOIN n USING (ticker) GROUP BY 1", digits=5)
def _(p):
    q = p.withColumn("a", F.abs("ret"))
    ac = st.autocorrelation(q, "a", (1, 2, 3, 5))
    n = p.groupBy("ticker").agg(F.count("ret").alias("n"))
    return ac.groupBy("ticker").agg(F.max(F.when(F.col("lag") == 1, F.col("ac"))).alias("ac1")).join(st.ljung_box(ac, n), "ticker").withColumn("q", F.round("q", 3))


_MIDDLE = ", dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM r WHERE ret IS NOT NULL)), x AS (SELECT ticker, r.date, ret, day <= (SELECT max(day) / 2 FROM dd) AS early FROM r JOIN dd USING (date) WHERE ret IS NOT NULL), b AS (SELECT a.ticker AS t1, b.ticker AS t2, corr(a.ret, b.ret) FILTER (a.early) AS f, corr(a.ret, b.ret) FILTER (NOT a.early) AS s, corr(a.ret, b.ret) AS c FROM x a JOIN x b ON a.date = b.date AND a.ticker < b.ticker GROUP BY 1, 2)"


@query("ed6_correlation_halves", f"WITH {R}{_MIDDLE} SELECT t1, t2, round(f, 5) + 0.0 AS first, round(s, 5) + 0.0 AS second, round(abs(s - f), 5) + 0.0 AS change FROM b", digits=5)
def _(p):
    return dg.halves(p)


@query("ed12_cluster_correlation", f"WITH {R}{_MIDDLE} SELECT count(*) FILTER (t1[7] = t2[7]) AS n_within, round(avg(c) FILTER (t1[7] = t2[7]), 5) + 0.0 AS within, round(avg(c) FILTER (t1[7] <> t2[7]), 5) + 0.0 AS between FROM b", digits=5)
def _(p):
    """The first digit of the brand stands for a cluster; ``co3_clusters`` finds clusters."""
    z = p.where("ret is not null").select("ticker", "date", "ret")
    a, b = (z.toDF(f"t{i}", "date", f"x{i}") for i in (1, 2))
    pairs = a.join(b, "date").where("t1 < t2").groupBy("t1", "t2").agg(tr.safe_corr("x1", "x2").alias("corr"))
    return dg.cluster_correlation(pairs, p.select("ticker", F.substring("ticker", 7, 1).alias("cluster")).distinct())


@query("ed10_turn_of_month_and_moon", f"WITH {R}, g AS (SELECT ret, day(date) <= 3 OR date_diff('day', date, last_day(date)) < 1 AS turn, floor(((date_diff('day', DATE '2000-01-06', date) % 29.53 + 29.53) % 29.53) / 29.53 * 4) AS moon FROM r) SELECT turn, CAST(moon AS BIGINT) AS moon, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM g GROUP BY 1, 2")
def _(p):
    return p.groupBy(turn_of_month("date").alias("turn"), F.floor(lunar_phase("date") * 4).alias("moon")).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"))


# -- regimes and filters ------------------------------------------------------------------------------------------


@query("hm3_selected_states", digits=3)
def _(p):
    return md.select_hmm(p)


@query("hm4_regime_stability", f"WITH {R}, v AS (SELECT ticker, date, {roll('stddev_samp', 'ret', 21)} AS v FROM r), s AS (SELECT ticker, date, CASE WHEN v > avg(v) OVER (PARTITION BY ticker) THEN 1 ELSE 0 END AS s FROM v WHERE v IS NOT NULL), b AS (SELECT *, {lagged('s')} AS b FROM s), g AS (SELECT ticker, count(*) AS n, count(*) FILTER (b IS NOT NULL AND b <> s) AS changes, count(b) AS k FROM b GROUP BY 1) SELECT ticker, n, changes, round(n / (changes + 1.0), 6) + 0.0 AS mean_days, round((k - changes) / k, 6) + 0.0 AS stay FROM g")
def _(p):
    q = p.withColumn("v", w.std("ret", 21)).where("v is not null").withColumn("s", (F.col("v") > F.avg("v").over(w.section("ticker"))).cast("int"))
    return md.regime_stability(q, "s")


@query("ss3_smoothed_level", recursive(_LP, "b", *_LEVEL, "lp", "SELECT 1").rsplit("SELECT 1", 1)[0] + f", v AS MATERIALIZED (SELECT ticker, date, s, v, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS back FROM k), u AS (SELECT ticker, date, s AS sm, back FROM v WHERE back = 1 UNION ALL SELECT v.ticker, v.date, v.s + v.v / (v.v + 1e-5) * (u.sm - v.s), v.back FROM u JOIN v ON v.ticker = u.ticker AND v.back = u.back + 1) SELECT ticker, date, round(sm, 6) + 0.0 AS smoothed FROM u")
def _(p):
    return kn.along(p.select(*K, F.ln("close").alias("lp")), {"smoothed": dg.rts_level("lp")}).select(*K, "smoothed")


@query("ss3_em_noise", digits=5)
def _(p):
    return dg.em_noise(p.withColumn("lp", F.ln("close")), "lp")


_PRIOR, _SUM = "(p.v + 1e-5)", "(p.v + 1e-5 + 1e-2)"


@query("ss4_filter_features", recursive(_LP, "b", {**_LEVEL[0], "e": "CAST(NULL AS DOUBLE)", "w": "CAST(NULL AS DOUBLE)"}, {**_LEVEL[1], "e": "r.lp - p.s", "w": _SUM}, "lp", f", f AS (SELECT *, -0.5 * (ln(2 * pi() * w) + e * e / w) AS l FROM k), x AS (SELECT ticker, date, abs(e) AS innovation_abs, sqrt(w) AS innovation_std, e / sqrt(w) AS surprise, l - {lagged('l')} AS loglik_change, lp - s AS gap, s - {lagged('s')} AS level_return FROM f) " + out("innovation_abs innovation_std surprise loglik_change gap level_return", "x")))
def _(p):
    q = kn.along(p.select(*K, F.ln("close").alias("lp")), kn.kalman_diagnostics("lp", 1e-5, 1e-2) | {"level": kn.kalman_level("lp")})
    return dg.filter_features(q, "lp").select(*K, "innovation_abs", "innovation_std", "surprise", "loglik_change", "gap", "level_return")


@query("co1_engle_granger", f"""WITH {_LP_PAIR}, sl AS (SELECT asset1, asset2, spread, lag(spread) OVER t AS l1, lag(spread, 2) OVER t AS l2 FROM s WINDOW t AS (PARTITION BY asset1, asset2 ORDER BY date)), x AS (SELECT asset1, asset2, spread - l1 AS y, l1 AS v, l1 - l2 AS d FROM sl WHERE l2 IS NOT NULL),
    c AS (SELECT asset1, asset2, count(*) AS n, var_pop(y) * count(*) AS yy, var_pop(v) * count(*) AS vv, var_pop(d) * count(*) AS dd, covar_pop(y, v) * count(*) AS yv, covar_pop(y, d) * count(*) AS yd, covar_pop(v, d) * count(*) AS vd FROM x GROUP BY 1, 2),
    q AS (SELECT *, (yv * dd - yd * vd) / (vv * dd - vd * vd) AS bv, (yd * vv - yv * vd) / (vv * dd - vd * vd) AS bd FROM c)
    SELECT asset1, asset2, round(bv / sqrt((yy - bv * yv - bd * yd) / (n - 3) * dd / (vv * dd - vd * vd)), 5) + 0.0 AS stat, n + 2 AS n, bv / sqrt((yy - bv * yv - bd * yd) / (n - 3) * dd / (vv * dd - vd * vd)) < -3.34 AS cointegrated FROM q""", digits=5)
def _(p):
    return md.engle_granger(md.pair_spreads(p))


@query("gr3_validation", f"WITH {_HVG}, n2 AS (SELECT ticker, count(*) AS nodes FROM n GROUP BY 1) SELECT e.ticker, max(nodes) AS nodes, count(*) AS edges, count(*) FILTER (j = i + 1) = max(nodes) - 1 AS connected, count(*) <= 2 * max(nodes) - 3 AS planar_bound, bool_and(i < j) AS ordered FROM e JOIN n2 ON n2.ticker = e.ticker GROUP BY 1")
def _(p):
    nodes = p.groupBy("ticker").agg(F.count("close").alias("nodes"))
    return gr.horizontal_edges(p, "close").join(nodes, "ticker").groupBy("ticker").agg(
        F.max("nodes").alias("nodes"), F.count(F.lit(1)).alias("edges"), (F.count_if(F.col("j") == F.col("i") + 1) == F.max("nodes") - 1).alias("connected"), (F.count(F.lit(1)) <= 2 * F.max("nodes") - 3).alias("planar_bound"), F.bool_and(F.col("i") < F.col("j")).alias("ordered")
    )


@query("gr9_centralisation", f"WITH {_HVG}{_DEG} SELECT ticker, round((count(*) * max(degree) - sum(degree)) / ((count(*) - 1.0) * (count(*) - 2)), 6) + 0.0 AS centralisation FROM g GROUP BY ticker")
def _(p):
    return gr.centralisation(gr.horizontal_edges(p, "close"))


@query("gr5_goodness_of_fit", f"WITH {_HVG}{_DEG}, f AS (SELECT ticker, 1 + count(*) / sum(ln(degree / 1.5)) AS gamma FROM g WHERE degree >= 2 GROUP BY 1), p AS (SELECT ticker, degree, count(*) / sum(count(*)) OVER (PARTITION BY ticker) AS p FROM g WHERE degree >= 2 GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER (PARTITION BY ticker ORDER BY degree ROWS UNBOUNDED PRECEDING) AS cdf FROM p) SELECT ticker, round(max(gamma), 5) + 0.0 AS gamma, round(max(abs(cdf - (1 - pow((degree + 0.5) / 1.5, 1 - gamma)))), 5) + 0.0 AS ks, round(CASE WHEN count(*) >= 3 THEN -regr_slope(ln(p), ln(degree)) ELSE 2.5 END, 5) + 0.0 AS slope FROM c JOIN f USING (ticker) GROUP BY ticker", digits=5)
def _(p):
    return gr.power_law_fit(gr.horizontal_edges(p, "close"))


# -- signals, books, metrics ------------------------------------------------------------------------------------------


@query("sg8_breadth_and_weekly_hold", f"WITH {SIG}, k AS (SELECT *, CASE WHEN round({rank('signal')}, 9) >= 0.8 OR round({rank('signal')}, 9) <= 0.2 THEN signal END AS narrow FROM g), h AS (SELECT *, CASE WHEN (rn - 1) % 5 = 0 THEN coalesce(narrow, 0) END AS x FROM k) SELECT ticker, date, round(last_value(x IGNORE NULLS) OVER ({TICKER} ROWS UNBOUNDED PRECEDING), 6) + 0.0 AS held FROM h")
def _(p):
    k = signals(p).withColumn("k", F.round(w.pct_rank("signal"), 9))
    narrow = F.coalesce(F.when((F.col("k") >= 0.8) | (F.col("k") <= 0.2), F.col("signal")), F.lit(0.0))
    return k.withColumn("x", F.when((F.col("rn") - 1) % 5 == 0, narrow)).select(*K, w.ffill("x").alias("held"))


@query("sg10_ic_weighted_ensemble", f"WITH {R}, g AS (SELECT *, {roll('sum', 'ret', 5)} AS m5, {roll('sum', 'ret', 21)} AS m21, lead(ret) OVER ({TICKER}) AS y FROM r), c AS (SELECT greatest(corr(m5, y) FILTER (m5 IS NOT NULL AND y IS NOT NULL), 0) AS a, greatest(corr(m21, y) FILTER (m21 IS NOT NULL AND y IS NOT NULL), 0) AS b FROM g WHERE date < DATE '1995-07-01'), k AS (SELECT ticker, date, {rank('m5')} AS k5, {rank('m21')} AS k21 FROM g), v AS (SELECT CASE WHEN a + b > 0 THEN a / (a + b) ELSE 0.5 END AS wa, CASE WHEN a + b > 0 THEN b / (a + b) ELSE 0.5 END AS wb FROM c) SELECT ticker, date, round(wa * k5 + wb * k21, 6) + 0.0 AS ensemble FROM k, v")
def _(p):
    """Ranks weighted by the correlation that each signal had with the next return up to a date."""
    g = learnable(p)
    early = F.col("date") < F.lit(FIT_UNTIL).cast("date")
    c = g.where(early).agg(F.greatest(tr.safe_corr("m5", "y"), F.lit(0.0)).alias("a"), F.greatest(tr.safe_corr("m21", "y"), F.lit(0.0)).alias("b"))
    share = lambda x: F.when(F.col("a") + F.col("b") > 0, F.try_divide(F.col(x), F.col("a") + F.col("b"))).otherwise(0.5)
    k = g.select(*K, w.pct_rank("m5").alias("k5"), w.pct_rank("m21").alias("k21"))
    return k.join(F.broadcast(c)).select(*K, (share("a") * F.col("k5") + share("b") * F.col("k21")).alias("ensemble"))


@query("sg10_prediction_correlation", f"WITH {R}, g AS (SELECT date, {roll('sum', 'ret', 5)} AS m5, {roll('sum', 'ret', 21)} AS m21 FROM r), c AS (SELECT date, CASE WHEN count(*) > 5 THEN covar_pop(m5, m21) / nullif(stddev_pop(m5) * stddev_pop(m21), 0) END AS c FROM g WHERE m5 IS NOT NULL AND m21 IS NOT NULL GROUP BY date) SELECT round(avg(c), 6) + 0.0 AS mean_corr, count(c) AS days FROM c")
def _(p):
    c = tr.information_coefficient(learnable(p), "m5", "m21", rank=False)
    return c.agg(F.avg("ic").alias("mean_corr"), F.count("ic").alias("days"))


@query("ps4_per_side_capped", f"WITH {SIG}, s AS (SELECT *, greatest(sign(signal), 0) AS u, greatest(-sign(signal), 0) AS v FROM g WHERE signal IS NOT NULL), x AS (SELECT ticker, date, 0.5 * coalesce(u / nullif(sum(u) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(v / nullif(sum(v) OVER (PARTITION BY date), 0), 0) AS p FROM s) SELECT ticker, date, round(1.5 * least(greatest(p, -0.05), 0.05), 6) + 0.0 AS position FROM x")
def _(p):
    """Signs, each side to one half, cut at 5 %, then levered: in this order."""
    q = signals(p).where("signal is not null").withColumn("x", F.signum("signal"))
    return q.select(*K, (1.5 * F.least(F.greatest(dg.per_side("x"), F.lit(-0.05)), F.lit(0.05))).alias("position"))


@query("bt19_regime_sized", f"WITH {SIG}{_BOOK}{_TOP.replace(', w AS', ', w0 AS')}, m AS (SELECT date, avg(ret) AS mkt FROM g GROUP BY date), v AS (SELECT date, CASE WHEN count(mkt) OVER u >= 20 THEN stddev_samp(mkt) OVER u END AS vol FROM m WINDOW u AS (ORDER BY date ROWS 19 PRECEDING)), z AS (SELECT date, lag(CASE WHEN vol > 0.5 THEN 0.5 WHEN vol IS NOT NULL THEN 1.0 END) OVER (ORDER BY date) AS z FROM v), w AS (SELECT w0.ticker, w0.date, w0.ret, pos * coalesce(z, 1.0) AS pos FROM w0 JOIN z USING (date)){_BACKTEST}{_NET}")
def _(p):
    """Half size after dates on which the market's deviation over 20 rows lay above one half."""
    m = fe.market(p).select("date", F.when(F.col("mkt_vol_20") > 0.5, "high").when(F.col("mkt_vol_20").isNotNull(), "low").alias("regime"))
    return tr.backtest(dg.regime_sized(book(p), m, {"high": 0.5, "low": 1.0})).select("date", "gross", "turnover", "net")


_MIXED = (
    SIG + _BOOK.replace(", k AS", ", k0 AS") + _TOP.replace("FROM k)", "FROM k0)") + ", m AS (SELECT date, avg(ret) AS mkt FROM g GROUP BY date), v AS (SELECT date, CASE WHEN count(mkt) OVER u >= 20 THEN stddev_samp(mkt) OVER u END AS vol FROM m WINDOW u AS (ORDER BY date ROWS 19 PRECEDING)), "
    "z AS (SELECT date, lag(CASE WHEN vol > 0.5 THEN 'high' WHEN vol IS NOT NULL THEN 'low' END) OVER (ORDER BY date) AS regime FROM v), b AS (SELECT w.ticker, w.date, w.ret, pos, coalesce(l / nullif(sum(l) OVER (PARTITION BY date), 0), 0) AS lo, CAST(1 AS DOUBLE) / count(*) OVER (PARTITION BY date) AS eq FROM w), "
    "x AS (SELECT b.ticker, b.date, ret, CASE regime WHEN 'high' THEN 0.5 * lo + 0.5 * eq WHEN 'low' THEN pos ELSE eq END AS x FROM b JOIN z USING (date)), n0 AS (SELECT *, coalesce(x / nullif(sum(abs(x)) OVER (PARTITION BY date), 0), 0) AS t FROM x)"
)


@query("bt21_regime_map", recursive(_MIXED, "n0", {"s": "CAST(t AS DOUBLE)"}, {"s": "0.5 * r.t + 0.5 * p.s"}, "ret t", f", w2 AS (SELECT ticker, date, ret, coalesce(s / nullif(sum(abs(s)) OVER (PARTITION BY date), 0), 0) AS pos FROM k){_BACKTEST.replace('FROM w)', 'FROM w2)').replace('coalesce(sum(d), 0)', '0.5 * coalesce(sum(d), 0)').replace(', d AS (', ', d2 AS (').replace('FROM d GROUP', 'FROM d2 GROUP')}{_NET}"))
def _(p):
    """Long-short after calm dates, a long-only book and equal weights after others, smoothed by half and scaled again."""
    q = fe.add(signals(p), tr.top_bottom("signal")).withColumns({"eq": F.lit(1.0) / F.count(F.lit(1)).over(w.section()), "lo": F.coalesce(F.try_divide(F.col("_long"), F.sum("_long").over(w.section())), F.lit(0.0))}).withColumnRenamed("position", "ls")
    m = fe.market(p).select("date", F.when(F.col("mkt_vol_20") > 0.5, "high").when(F.col("mkt_vol_20").isNotNull(), "low").alias("regime"))
    target = dg.blended(q.select(*K, "ret", "ls", "lo", "eq"), m, {"high": {"lo": 0.5, "eq": 0.5}, "low": {"ls": 1.0}}, {"eq": 1.0})
    smooth = kn.along(target.select(*K, "ret", "position"), {"s": kn.decay_smooth("position", 0.5)}).withColumn("position", tr.l1("s"))
    return tr.backtest(smooth, turnover="half").select("date", "gross", "turnover", "net")


_GAIN1 = "(p.value * (1 + r.net))"
_LEFT = f"({_GAIN1} - 1 <= -0.02 OR {_GAIN1} - 1 >= 0.05)"


@query("bt13_stop_and_take", recursive(
    _DAILY + ", one AS (SELECT 'equal' AS strategy, date, net FROM daily)", "one",
    {"stopped": "net", "value": "CASE WHEN net <= -0.02 OR net >= 0.05 THEN 1.0 ELSE 1 + net END", "rest": "CASE WHEN net <= -0.02 OR net >= 0.05 THEN 5 ELSE 0 END"},
    {"stopped": "CASE WHEN p.rest > 0 THEN 0.0 ELSE r.net END", "value": f"CASE WHEN p.rest > 0 THEN p.value WHEN {_LEFT} THEN 1.0 ELSE {_GAIN1} END", "rest": f"CASE WHEN p.rest > 0 THEN p.rest - 1 WHEN {_LEFT} THEN 5 ELSE 0 END"},
    "net", "SELECT date, round(stopped, 6) + 0.0 AS stopped FROM k", "strategy"))
def _(p):
    d = daily(p).withColumn("strategy", F.lit("equal"))
    return kn.along(d, {"stopped": kn.portfolio_stops("net", 0.02, 0.05)}, "strategy").select("date", "stopped")


_CONVICTION = f", k1 AS (SELECT *, round({rank('signal')}, 9) - 0.5 AS o FROM g), o1 AS (SELECT *, CASE WHEN o >= 0.3 THEN o ELSE 0 END AS u, CASE WHEN o <= -0.3 THEN -o ELSE 0 END AS v FROM k1), c1 AS (SELECT *, 0.5 * coalesce(u / nullif(sum(u) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(v / nullif(sum(v) OVER (PARTITION BY date), 0), 0) AS x FROM o1)"


@query("bt22_conviction_smoothed", recursive(SIG + _CONVICTION, "c1", {"s": "CAST(x AS DOUBLE)"}, {"s": "0.3 * r.x + 0.7 * p.s"}, "ret x", f", n AS (SELECT ticker, date, ret, 0.5 * coalesce(greatest(s, 0) / nullif(sum(greatest(s, 0)) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(greatest(-s, 0) / nullif(sum(greatest(-s, 0)) OVER (PARTITION BY date), 0), 0) AS pos FROM k){_BACKTEST.replace('FROM w)', 'FROM n)')}{_NET}", "ticker"))
def _(p):
    """Positions of convinced ranks alone, smoothed by decay, each side to one half again, lagged."""
    q = fe.add(signals(p), dg.conviction("signal"))
    q = kn.along(q.select(*K, "ret", "position"), {"smooth": kn.decay_smooth("position", 0.3)}).withColumn("position", dg.per_side("smooth"))
    return tr.backtest(q).select("date", "gross", "turnover", "net")


_SCALED = ", v AS (SELECT *, gross - turnover * 0.001 AS net FROM e), x AS (SELECT *, CASE WHEN count(net) OVER u >= 60 THEN stddev_samp(net) OVER u * sqrt(252) END AS dev FROM v WINDOW u AS (ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), y AS (SELECT *, CASE WHEN dev IS NULL OR dev = 0 THEN 1 ELSE least(greatest(0.15 / dev, 0.5), 2.0) END AS scale FROM x) SELECT date, round(CAST(net AS DOUBLE), 6) + 0.0 AS net, round(CAST(scale AS DOUBLE), 6) + 0.0 AS scale, round(CAST(scale * net AS DOUBLE), 6) + 0.0 AS scaled FROM y"
_TEN = ", i AS (SELECT *, signal IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY signal DESC NULLS LAST, ticker) <= 10 AS i FROM g)"


@query("bt24_top_equal", f"WITH {SIG}{_TEN}, w AS (SELECT *, coalesce(i::INT / nullif(sum(i::INT) OVER (PARTITION BY date), 0), 0) AS pos FROM i){_BACKTEST}{_SCALED}")
def _(p):
    return dg.full_engine(signals(p), "signal").select("date", "net", "scale", "scaled")


@query("bt24_top_softmax", f"WITH {SIG}{_TEN}, x0 AS (SELECT *, CASE WHEN i THEN exp((signal - max(signal) FILTER (i) OVER (PARTITION BY date)) / 2.0) ELSE 0 END AS x FROM i), w AS (SELECT *, coalesce(x / nullif(sum(x) OVER (PARTITION BY date), 0), 0) AS pos FROM x0){_BACKTEST}{_SCALED}")
def _(p):
    return dg.full_engine(signals(p), "signal", temperature=2.0).select("date", "net", "scale", "scaled")


@query("mt2_alpha_beta", f"WITH {SIG}{_BOOK}{_TOP}{_BACKTEST}, m AS (SELECT date, avg(ret) AS mkt FROM g GROUP BY date), j AS (SELECT gross - turnover * 0.001 AS n, mkt FROM e JOIN m USING (date) WHERE mkt IS NOT NULL) SELECT count(*) AS n, round(covar_samp(n, mkt) / var_samp(mkt), 5) + 0.0 AS beta, round((avg(n) - covar_samp(n, mkt) / var_samp(mkt) * avg(mkt)) * 252, 5) + 0.0 AS alpha, round(corr(n, mkt), 5) + 0.0 AS corr, round(stddev_samp(n - mkt) * sqrt(252), 5) + 0.0 AS tracking, round(avg(n - mkt) / stddev_samp(n - mkt) * sqrt(252), 5) + 0.0 AS info_ratio FROM j", digits=5)
def _(p):
    m = p.groupBy("date").agg(F.avg("ret").alias("mkt"))
    return dg.alpha_beta(tr.backtest(book(p)).join(m, "date"), "net", "mkt")


@query("bt24_stopped_trailing")
def _(p):
    return td.book_returns(td.stopped_book(signals(p), "signal", stop=0.5, take=1.0, trail=0.3)).select("date", "gross", "turnover", "net")


@query("bt24_trade_concentration", digits=5)
def _(p):
    return td.trade_summary(td.stopped_book(signals(p), "signal", stop=0.5, take=1.0, trail=0.3))


# -- learning -------------------------------------------------------------------------------------------------------


@query("ml2_expanding_and_rolling_folds", f"WITH {PX}, n AS (SELECT count(DISTINCT date) AS n FROM px), c AS (SELECT 'expanding' AS kind, unnest(range(504, n - 1, 126)) AS cut FROM n UNION ALL SELECT 'rolling', unnest(range(504, n - 1, 126)) FROM n) SELECT kind, CAST((cut - 504) / 126 AS INTEGER) AS fold, CAST(CASE WHEN kind = 'rolling' THEN greatest(cut - 252, 0) ELSE 0 END AS INTEGER) AS train_from, CAST(cut - 1 AS INTEGER) AS train_to, CAST(cut + 1 AS INTEGER) AS test_from, CAST(cut + 126 AS INTEGER) AS test_to FROM c")
def _(p):
    kinds = {"expanding": None, "rolling": 252}
    a, b = (ml.folds(p, start=504, step=126, embargo=1, history=h).withColumn("kind", F.lit(k)) for k, h in kinds.items())
    return a.unionByName(b)


@query("ml7_random_forest")
def _(p):
    return ml.random_forest(learnable(p), ("m5", "m21"), "y", F.col("date") < F.lit(FIT_UNTIL).cast("date")).select(*K, "prediction")


@query("ml7_linear_svr", digits=4)
def _(p):
    return wf.support_vector_regression(learnable(p), ("m5", "m21"), "y", F.col("date") < F.lit(FIT_UNTIL).cast("date")).select(*K, "prediction")


def _perceptron(p, label, classes):
    """Accuracy by fold of perceptrons refitted every third year on all rows before."""
    q = learnable(p).withColumn("label", F.when(F.col("y").isNotNull(), label))
    return wf.accuracy_by_fold(wf.walk_forward_perceptron(q, ("m5", "m21"), "label", classes, ml.folds(q, start=504, step=756), seeds=(1, 2), rounds=25))


@query("ml17_perceptron_three_classes", digits=5)
def _(p):
    return _perceptron(p, tr.three_classes("y", 0.3), 3)


@query("ml17_perceptron_binary", digits=5)
def _(p):
    return _perceptron(p, (F.col("y") > 0).cast("int"), 2)


@query("sg10_stacking_grid", digits=5)
def _(p):
    """Ridge over the walk-forward predictions of three ridge models, by penalty."""
    q = learnable(p)
    bases = {"short": ["m5"], "long": ["m21"], "both": ["m5", "m21"]}
    return wf.grid_scores(wf.stacked(q, bases, "y", ml.folds(q, step=63, history=504), ml.folds(q, start=756, step=63), (0.1, 10.0, 1000.0)))


@query("ml11_decayed_predictions")
def _(p):
    """Walk-forward predictions smoothed along each ticker."""
    q = learnable(p)
    predicted = ml.walk_forward_ridge(q, ("m5", "m21"), "y", ml.folds(q, step=63, history=504))
    return sc.scan(predicted.select(*K, "prediction"), {"smooth": sc.decay("prediction", 0.3)}).select(*K, "smooth")


@query("ml13_ablation", digits=5)
def _(p):
    q = learnable(p)
    return dg.ablation(q, ["m5", "m21"], "y", ml.folds(q, step=252, history=504))


@query("ml13_noise_injection", digits=5)
def _(p):
    """The daily rank correlation of walk-forward predictions as noise of growing size is added to the features."""
    q, parts = learnable(p), []
    for size in (0.0, 0.5, 2.0):
        noisy = dg.with_noise(q, ["m5", "m21"], size)
        ic = tr.information_coefficient(ml.walk_forward_ridge(noisy, ("m5", "m21"), "y", ml.folds(q, step=252, history=504)), "prediction", "target")
        parts.append(ic.agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n")).select(F.lit(size).alias("noise"), "mean_ic", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ml14_simplex_weights", digits=3)
def _(p):
    """Weights of three books that maximise mean by deviation of the sum: momentum, its opposite over five rows, and the market."""
    a = tr.backtest(book(p)).select("date", F.col("net").alias("a"))
    short = fe.add(p.withColumn("signal", -w.rsum("ret", 5)), tr.top_bottom("signal"))
    b = tr.backtest(short).select("date", F.col("net").alias("b"))
    c = daily(p).select("date", F.col("net").alias("c"))
    weights = dg.simplex_weights(a.join(b, "date").join(c, "date"), ["a", "b", "c"])
    return p.sparkSession.createDataFrame(list(zip(("momentum", "reversal", "market"), weights)), "book string, weight double")


@query("ml15_leaderboard", f"WITH {_DAILY}, m AS (SELECT CASE WHEN month(date) <= 6 THEN 'first' ELSE 'second' END AS name, avg(net) / stddev_samp(net) * sqrt(252) AS value, count(net) AS n FROM daily GROUP BY 1) SELECT name, round(value, 6) + 0.0 AS value FROM m")
def _(p):
    """Two experiments appended to a log kept as Parquet, read back best first."""
    path = scratch(p.sparkSession, "experiments")
    halves = daily(p).withColumn("name", F.when(F.month("date") <= 6, "first").otherwise("second"))
    for r in tr.performance(halves, by=("name",)).collect():  # one row a strategy
        panel.append_experiment(p.sparkSession, path, r["name"], {"sharpe": r["sharpe"]})
    return panel.leaderboard(p.sparkSession.read.parquet(path), "sharpe").select("name", "value")


@query("ml16_smoothed_pipeline")
def _(p):
    """Features, walk-forward predictions, smoothing, book and metrics in one plan."""
    q = learnable(p)
    predicted = ml.walk_forward_ridge(q, ("m5", "m21"), "y", ml.folds(q, step=63, history=504)).select(*K, F.col("prediction"))
    smooth = sc.ewm(predicted, "signal", "prediction", span=5).select(*K, "signal")
    return tr.performance(tr.backtest(fe.add(p.join(smooth, K), tr.top_bottom("signal"))))


@query("ml16_orchestrations", digits=5)
def _(p):
    """The whole way from features to results: a baseline, it with a new feature, that smoothed, and that in rising markets alone."""
    q = learnable(p)
    predicted = {name: ml.walk_forward_ridge(q, x, "y", ml.folds(q, step=63, history=504)).select(*K, F.col("prediction").alias("signal")) for name, x in {"baseline": ["m5"], "with_feature": ["m5", "m21"]}.items()}
    for name, rows in predicted.items():  # read several times
        folder = scratch(p.sparkSession, name)
        rows.write.parquet(folder)
        predicted[name] = p.sparkSession.read.parquet(folder)
    smooth = sc.scan(predicted["with_feature"], {"signal": sc.decay("signal", 0.3)})
    rising = fe.market(p).select("date", F.lag(flag(F.col("mkt_trend_20") > 0)).over(Window.partitionBy(F.lit(1)).orderBy("date")).alias("on"))
    ways = {**{k: (v, None) for k, v in predicted.items()}, "smoothed": (smooth, None), "regime": (predicted["with_feature"], rising)}
    rows = [wf.pipeline_results(p, signals, mask).withColumn("way", F.lit(k)) for k, (signals, mask) in ways.items()]
    return reduce(lambda a, b: a.unionByName(b), rows)


@query("ml17_three_classes", digits=5)
def _(p):
    q = learnable(p).withColumn("label", F.when(F.col("y").isNotNull(), tr.three_classes("y", 0.3)))
    got = dg.one_against_rest(q, ("m5", "m21"), "label", (0, 1, 2), ml.folds(q, step=126, history=504))
    return got.groupBy("fold").agg(F.count("label").alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


@query("ml18_frozen_retraining")
def _(p):
    """Folds that begin within the in-sample dates alone: the last of their models predicts all later dates."""
    q = learnable(p)
    table = ml.folds(q, step=126, history=504)
    frozen = table.where("fold <= 6").withColumn("test_to", F.when(F.col("fold") == 6, F.lit(1_000_000)).otherwise(F.col("test_to")))
    return ml.walk_forward_ridge(q, ("m5", "m21"), "y", frozen)


@query("ml19_cumulative_importance", digits=4)
def _(p):
    q = learnable(p).withColumns({"v21": w.std("ret", 21), "vr": F.try_divide(F.col("volume"), w.mean("volume", 20))})
    names = ("m5", "m21", "v21", "vr")
    _, found = ml.boosted_trees(q, names, "y", F.col("date") < F.lit(FIT_UNTIL).cast("date"))
    return p.sparkSession.createDataFrame(dg.cumulative_importance(names, found), "feature string, importance double, cumulative double, kept boolean")


@query("src7_saved_model")
def _(p):
    """A pipeline of scaler and linear model saved, loaded and applied."""
    return ml.saved_and_loaded(learnable(p), ("m5", "m21"), "y", F.col("date") < F.lit(FIT_UNTIL).cast("date"), scratch(p.sparkSession, "model")).select(*K, "prediction")


# -- reshaping, sources and sinks -----------------------------------------------------------------------------------


@query("rsh3_stack", f"WITH {R}, u AS (SELECT ticker, date, 'close' AS name, close AS value FROM r UNION ALL SELECT ticker, date, 'volume', volume FROM r) SELECT ticker, date, name, round(CAST(value AS DOUBLE), 4) + 0.0 AS value FROM u", digits=4)
def _(p):
    return p.select(*K, F.col("close").cast("double").alias("close"), F.col("volume").cast("double").alias("volume")).unpivot(K, ["close", "volume"], "name", "value")


@query("rsh8_intersection", f"WITH {R}, a AS (SELECT ticker, date, ret FROM r WHERE volume > 30), b AS (SELECT ticker, date, close FROM r WHERE month(date) <= 6) SELECT a.ticker, a.date, round(a.ret, 6) + 0.0 AS ret, round(b.close, 6) + 0.0 AS close FROM a JOIN b ON a.ticker = b.ticker AND a.date = b.date")
def _(p):
    """Two frames cut to the rows that both have."""
    return p.where("volume > 30").select(*K, "ret").join(p.where("month(date) <= 6").select(*K, "close"), K)


_STORE = {"mom_5d": roll("sum", "ret", 5), "mom_21d": roll("sum", "ret", 21), "vol_5d": roll("stddev_samp", "ret", 5), "vol_21d": roll("stddev_samp", "ret", 21)}
_STORED = f"{R}, f AS (SELECT ticker, date, {', '.join(f'{v} AS {k}' for k, v in _STORE.items())}, lead(ret) OVER ({TICKER}) AS y FROM r)"


def _store(p):
    return p.select(*K, w.rsum("ret", 5).alias("mom_5d"), w.rsum("ret", 21).alias("mom_21d"), w.std("ret", 5).alias("vol_5d"), w.std("ret", 21).alias("vol_21d"), w.lag("ret", -1).alias("y"))


@query("fe27_feature_report", f"WITH {_STORED}, u AS (UNPIVOT (SELECT ticker, date, y, mom_5d, mom_21d, vol_5d, vol_21d FROM f) ON mom_5d, mom_21d, vol_5d, vol_21d INTO NAME feature VALUE x), c AS (SELECT feature, date, CASE WHEN count(*) >= 5 THEN covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) END AS c FROM u WHERE y IS NOT NULL GROUP BY 1, 2), i AS (SELECT feature, count(c) AS dates, avg(c) AS ic, stddev_samp(c) AS s FROM c GROUP BY 1), m AS (SELECT feature, 1 - count(*) / (SELECT count(*) FROM f) AS missing FROM u GROUP BY 1) SELECT feature, CASE WHEN feature LIKE 'mom%' THEN 'momentum' ELSE 'volatility' END AS category, dates, round(missing, 5) + 0.0 AS missing, round(ic, 5) + 0.0 AS ic, round(ic / s * sqrt(dates), 5) + 0.0 AS t, missing <= 0.2 AS kept FROM i JOIN m USING (feature)", digits=5)
def _(p):
    return bk.feature_report(_store(p), {"mom_5d": "momentum", "mom_21d": "momentum", "vol_5d": "volatility", "vol_21d": "volatility"}, "y", most_missing=0.2)


@query("fe27_filled_features", f"WITH {_STORED}, a AS (SELECT ticker, date, " + ", ".join(f"last_value({c} IGNORE NULLS) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS {c}" for c in _STORE) + " FROM f) SELECT ticker, date, " + ", ".join(f"round(coalesce({c}, quantile_cont({c}, 0.5) OVER (PARTITION BY date), 0), 6) + 0.0 AS {c}" for c in _STORE) + " FROM a")
def _(p):
    """Missing features are the ticker's last, else the date's median, else 0."""
    return bk.filled(_store(p).drop("y"), list(_STORE))


@query("prj3_selected_features", f"WITH {R}, f AS (SELECT ticker, date, {roll('sum', 'ret', 5)} AS mom_5d, {roll('stddev_samp', 'ret', 5)} AS vol_5d FROM r) SELECT ticker, date, round(mom_5d, 6) + 0.0 AS mom_5d, round(vol_5d, 6) + 0.0 AS vol_5d FROM f")
def _(p):
    """Features whose names end in 5d and don't tell of reversal."""
    q = fe.add(p, fe.momentum(), fe.volatility())
    return q.select(*K, *(c for c in q.columns if c.endswith("_5d") and "reversal" not in c))


_ASSET = "'Asset_' || substr(ticker, 7)"


def _asset_files(p, name):
    """The panel as CSV files, one folder an asset, with column names as vendors write them."""
    folder = scratch(p.sparkSession, name)
    asset = F.concat(F.lit("Asset_"), F.substring("ticker", 7, 9))
    rows = p.select(asset.alias("asset"), F.col("date").cast("string").alias("Date"), *(F.col(c).cast("double").alias(c.title()) for c in ("open", "high", "low", "close", "volume")))
    return folder, rows


@query("src1_asset_files", f"WITH {PX} SELECT {_ASSET} AS ticker, date, round(open, 4) + 0.0 AS open, round(high, 4) + 0.0 AS high, round(low, 4) + 0.0 AS low, round(close, 4) + 0.0 AS close, round(volume, 4) + 0.0 AS volume FROM px", digits=4)
def _(p):
    folder, rows = _asset_files(p, "assets")
    panel.write_panel(rows, folder, "csv", ["asset"])
    return panel.read_assets(p.sparkSession, folder, r"asset=(Asset_\d+)")


@query("src2_unclean_asset_files", f"WITH {PX} SELECT {_ASSET} AS ticker, date, round(open, 4) + 0.0 AS open, round(high, 4) + 0.0 AS high, round(low, 4) + 0.0 AS low, CASE WHEN day(date) <> 7 THEN round(close, 4) + 0.0 END AS close, round(volume, 4) + 0.0 AS volume FROM px WHERE day(date) <> 13", digits=4)
def _(p):
    """Dates of the 13th can't be read and go; closes of the 7th are NaN and become null; every row of the 5th stands there twice and counts once."""
    folder, rows = _asset_files(p, "unclean")
    day = F.dayofmonth(F.col("Date").cast("date"))
    rows = rows.withColumns({"Close": F.when(day == 7, F.lit(float("nan"))).otherwise(F.col("Close")), "_n": F.explode(F.when(day == 5, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))})
    panel.write_panel(rows.withColumn("Date", F.when(day == 13, "n/a").otherwise(F.col("Date"))).drop("_n"), folder, "csv", ["asset"])
    return panel.read_assets(p.sparkSession, folder, r"asset=(Asset_\d+)")


@query("src6_json_settings", f"WITH {PX} SELECT 'Asset_' || substr(ticker, 7) AS ticker, count(*) AS n, CAST(min(date) AS VARCHAR) AS first_date, round(avg(close), 4) + 0.0 AS mean_close FROM px GROUP BY ticker", digits=4)
def _(p):
    """What is known of each asset, written as JSON and read back."""
    folder = scratch(p.sparkSession, "settings")
    about = p.groupBy(F.concat(F.lit("Asset_"), F.substring("ticker", 7, 9)).alias("ticker")).agg(F.count(F.lit(1)).alias("n"), F.min("date").cast("string").alias("first_date"), F.avg("close").alias("mean_close"))
    panel.write_panel(about, folder, "json")
    return p.sparkSession.read.schema(about.schema).json(folder)


@query("snk1_parquet_round_trip", f"WITH {PX} SELECT ticker, date, round(close, 4) + 0.0 AS close, volume FROM px", digits=4)
def _(p):
    path = scratch(p.sparkSession, "panel")
    panel.write_panel(p.select(*K, "close", "volume"), path, by=["ticker"])
    return panel.read_panel(p.sparkSession, path).select("ticker", "date", "close", "volume")


@query("snk2_csv_round_trip", f"WITH {PX} SELECT ticker, date, round(close, 6) + 0.0 AS close FROM px")
def _(p):
    path = scratch(p.sparkSession, "csv")
    panel.write_panel(p.select(*K, "close"), path, "csv")
    return p.sparkSession.read.csv(path, header=True, schema="ticker string, date date, close double")


@query("src5_feature_store", f"WITH {R}, f AS (SELECT ticker, date, {roll('sum', 'ret', 5)} AS a, {roll('stddev_samp', 'ret', 21)} AS b FROM r) SELECT ticker, date, round(a, 6) + 0.0 AS a, round(b, 6) + 0.0 AS b FROM f WHERE a IS NOT NULL OR b IS NOT NULL")
def _(p):
    path = scratch(p.sparkSession, "store")
    panel.write_store(p.select(*K, w.rsum("ret", 5).alias("a"), w.std("ret", 21).alias("b")), path, ["a", "b"])
    return panel.read_store(p.sparkSession, path)


@query("snk5_content_hash", f"WITH {PX} SELECT count(*) AS n, CAST(sum(CAST('0x' || substr(sha256(ticker || '|' || CAST(date AS VARCHAR) || '|' || CAST(CAST(round(high * 100) AS BIGINT) AS VARCHAR) || '|' || CAST(CAST(round(volume) AS BIGINT) AS VARCHAR)), 1, 15) AS HUGEINT)) AS VARCHAR) AS hash FROM px")
def _(p):
    """Of whole numbers, as the text of doubles differs between engines: the highest price in hundredths, and the volume."""
    return panel.content_hash(p.select(*K, F.round(F.col("high") * 100).cast("long").alias("high"), F.round("volume").cast("long").alias("volume")), ["ticker", "date", "high", "volume"])


# -- streams ----------------------------------------------------------------------------------------------------------


@table_query("str3_sessions", "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e) SELECT user_id, CAST(min(ts) AS TIMESTAMP) AS start, CAST(max(ts) + INTERVAL 30 MINUTE AS TIMESTAMP) AS \"end\", count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, s", digits=4)
def _(spark, sf_dir):
    return _streamed(spark, f"{sf_dir}/events.parquet", lambda e: online.sessions(e), "complete").withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@table_query("str3_deduplicated", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    """Every event twice in the stream, once in the result."""
    return _streamed(spark, f"{sf_dir}/events.parquet", lambda e: online.deduplicated(e.unionAll(e))).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@table_query("str3_hit_ratios", "WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ticker, ts AS date, value, CASE WHEN value IS NOT NULL THEN CASE WHEN (value - 50 > 0) = (40 - value > 0) THEN 1.0 ELSE 0.0 END END AS h FROM events) SELECT ticker, CAST(date AS TIMESTAMP) AS date, round(avg(h) OVER (PARTITION BY ticker ORDER BY date, value ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING), 6) + 0.0 AS hit_ratio FROM e")
def _(spark, sf_dir):
    """The share of hits among the last 63 settled predictions before each event of a user."""
    op = online.hits("p", "y", 63)
    build = lambda e: online.ordered(user_events(e).select("ticker", "date", (F.col("value") - 50).alias("p"), (40 - F.col("value")).alias("y")), op)
    return _streamed(spark, f"{sf_dir}/events.parquet", build, recursion=op).withColumn("date", F.col("date").cast("timestamp_ntz"))
