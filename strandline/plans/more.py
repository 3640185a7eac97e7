"""Further queries: reshaping and joins of whole books, feature-store steps, regimes, ensembles, path-dependent books."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.scalars import flag, ratio
from strandline.operators import books as bk
from strandline.operators import features as fe
from strandline.operators import graphs as gr
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import stats as st
from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.plans.kernels import _DEG, _HVG, learnable
from strandline.plans.registry import PX, R, TICKER, query, rank, roll, staged
from strandline.plans.research import _BOOK, _BOTH, _DAILY, _TOP, K, SIG, book, daily, signals


def by_date():
    """All dates in order: series of the market have one row per date."""
    return Window.partitionBy(F.lit(1)).orderBy("date")


@query("prj4_combine_blocks", f"WITH {R}, a AS (SELECT ticker, date, {roll('sum', 'ret', 5)} AS x FROM r), b AS (SELECT ticker, date, {roll('sum', 'ret', 21)} AS x FROM r) SELECT a.ticker, a.date, round(a.x, 6) + 0.0 AS block0_x, round(b.x, 6) + 0.0 AS block1_x FROM a JOIN b ON a.ticker = b.ticker AND a.date = b.date")
def _(p):
    return bk.combine([p.select(*K, w.rsum("ret", 5).alias("x")), p.select(*K, w.rsum("ret", 21).alias("x"))])


@query("flt3_drop_nulls", f"WITH {R}, m AS (SELECT *, {roll('avg', 'ret', 21)} AS m21 FROM r) SELECT ticker, date, round(m21, 6) + 0.0 AS m21 FROM m WHERE ret IS NOT NULL AND m21 IS NOT NULL")
def _(p):
    return p.withColumn("m21", w.mean("ret", 21)).dropna(subset=["ret", "m21"]).select(*K, "m21")


@query("rsh6_broadcast_series", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date) SELECT r.ticker, r.date, round(m.mkt, 6) + 0.0 AS mkt FROM r JOIN m USING (date)")
def _(p):
    return p.select(*K, F.avg("ret").over(w.section()).alias("mkt"))


@query("rsh7_align_target", f"WITH {R}, t AS (SELECT ticker, date, lead(ret) OVER ({TICKER}) AS target FROM r) SELECT r.ticker, r.date, round(r.ret, 6) + 0.0 AS ret, round(t.target, 6) + 0.0 AS target FROM r LEFT JOIN t ON t.ticker = r.ticker AND t.date = r.date")
def _(p):
    t = p.select(*K, w.lag("ret", -1).alias("target"))
    return p.join(t, K, "left").select(*K, "ret", "target")


@query("jn4_regime_scaling", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), s AS (SELECT date, CASE WHEN avg(mkt) OVER (ORDER BY date ROWS 19 PRECEDING) > 0 THEN 1.0 ELSE 0.5 END AS scale FROM m) SELECT r.ticker, r.date, round(CAST(r.ret * s.scale AS DOUBLE), 6) + 0.0 AS scaled FROM r JOIN s USING (date)")
def _(p):
    m = p.groupBy("date").agg(F.avg("ret").alias("mkt"))
    s = m.select("date", F.when(F.avg("mkt").over(by_date().rowsBetween(-19, 0)) > 0, 1.0).otherwise(0.5).alias("scale"))
    return p.join(s, "date").select(*K, (F.col("ret") * F.col("scale")).alias("scaled"))


@query("jn5_dedupe_then_join", f"WITH {R}, u AS (SELECT ticker, date, ret FROM r UNION ALL SELECT ticker, date, ret FROM r WHERE ret > 0), d AS (SELECT DISTINCT ticker, date, ret FROM u) SELECT r.ticker, r.date, round(r.close, 4) + 0.0 AS close, round(d.ret, 4) + 0.0 AS ret FROM r LEFT JOIN d ON d.ticker = r.ticker AND d.date = r.date", digits=4)
def _(p):
    build = p.select(*K, "ret").unionByName(p.where("ret > 0").select(*K, "ret")).dropDuplicates(K)
    return p.select(*K, "close").join(build, K, "left").select(*K, "close", "ret")


@query("jn7_lagged_self_join", f"WITH {R}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM r)), j AS (SELECT r.ticker, r.date, d.i, r.ret FROM r JOIN d USING (date)) SELECT a.date, count(*) AS n, CASE WHEN count(*) > 3 THEN round(corr(a.ret, b.ret), 5) + 0.0 END AS ac FROM j a JOIN j b ON a.ticker = b.ticker AND b.i = a.i - 5 WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY a.date", digits=5)
def _(p):
    j = ml.with_day(p).where("ret is not null")
    b = j.select("ticker", (F.col("day") + 5).alias("day"), F.col("ret").alias("before"))
    return j.join(b, ["ticker", "day"]).groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 3, tr.safe_corr("ret", "before")).alias("ac"))


@query("set4_symmetric_difference", f"WITH {R}, h AS (SELECT date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS k FROM r) WHERE k <= 5), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM h)), x AS (SELECT d.date, (SELECT count(*) FROM h n WHERE n.date = d.date AND n.ticker NOT IN (SELECT ticker FROM h o WHERE o.date = d.before)) AS added, (SELECT count(*) FROM h o WHERE o.date = d.before AND o.ticker NOT IN (SELECT ticker FROM h n WHERE n.date = d.date)) AS dropped FROM d WHERE before IS NOT NULL) SELECT date, CAST(added AS INTEGER) AS added, CAST(dropped AS INTEGER) AS dropped FROM x")
def _(p):
    tops = w.top_k(p, "volume", "top", 5).where("top").groupBy("date").agg(F.collect_set("ticker").alias("s")).withColumn("o", F.lag("s").over(by_date())).where("o is not null")
    return tops.select("date", F.size(F.array_except("s", "o")).alias("added"), F.size(F.array_except("o", "s")).alias("dropped"))


@query("ag25_regime_performance", f"WITH {_DAILY}, v AS (SELECT date, net, CASE WHEN count(net) OVER w >= 20 THEN stddev_samp(net) OVER w END AS vol FROM daily WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)), g AS (SELECT *, CASE WHEN vol > quantile_cont(vol, 0.5) OVER () THEN 'high' WHEN vol IS NOT NULL THEN 'low' END AS regime FROM v) SELECT regime, count(*) AS n, round(CASE WHEN count(*) >= 10 THEN avg(net) / stddev_samp(net) * sqrt(252) END, 6) + 0.0 AS sharpe, round(avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS win_rate FROM g WHERE regime IS NOT NULL GROUP BY regime")
def _(p):
    v = daily(p).withColumn("vol", w.std("net", 20, w=by_date()))
    med = v.agg(F.percentile("vol", 0.5).alias("med"))
    g = v.join(F.broadcast(med)).withColumn("regime", F.when(F.col("vol") > F.col("med"), "high").when(F.col("vol").isNotNull(), "low")).where("regime is not null")
    return g.groupBy("regime").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) >= 10, F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("win_rate"))


@query("fe6_regime_interactions")
def _(p):
    q = fe.add(p, fe.momentum(), fe.volatility(), fe.regime())
    q = w.run_length(q, "regime_state", "regime_duration")
    return fe.add(q, fe.regime_interactions()).select(*K, "mom_x_confidence", "reversal_x_high", "mom_x_duration", "vol_x_entropy")


@query("fe8_panel_builder")
def _(p):
    return bk.feature_panel(p)


@query("fe10_min_period_blocks", staged({"m": roll("sum", "ret", 20, 15), "v": roll("stddev_samp", "ret", 20, 15), "vr": f"volume / nullif({roll('avg', 'volume', 20, 15)}, 0)"}, keep="m v vr"))
def _(p):
    return p.select(*K, w.rsum("ret", 20, 15).alias("m"), w.std("ret", 20, 15).alias("v"), ratio("volume", w.mean("volume", 20, 15)).alias("vr"))


@query("fe13_risk_adjusted_ranks", staged({f"a{n}": f"({roll('sum', 'ret', n)}) / nullif({roll('stddev_samp', 'ret', n)}, 0)" for n in (5, 20, 60)}, {f"k{n}": rank(f"a{n}") for n in (5, 20, 60)}, {"quality": "(coalesce(k5, 0) + coalesce(k20, 0) + coalesce(k60, 0)) / nullif((k5 IS NOT NULL)::INT + (k20 IS NOT NULL)::INT + (k60 IS NOT NULL)::INT, 0)"}, keep="a20 k20 quality"))
def _(p):
    q = p.withColumns({f"a{n}": ratio(w.rsum("ret", n), w.std("ret", n)) for n in (5, 20, 60)}).withColumns({f"k{n}": w.pct_rank(f"a{n}") for n in (5, 20, 60)})
    return q.select(*K, "a20", "k20", fe.composite(["k5", "k20", "k60"]).alias("quality"))


@query("fe20_research_momentum", staged({"r63": roll("sum", "ret", 63), "r21": roll("sum", "ret", 21), "ab": "abs(ret)", "v": roll("stddev_samp", "ret", 63)}, {"spread": "r63 - r21", "ts": "CASE WHEN r63 IS NOT NULL AND v IS NOT NULL THEN least(greatest(r63 / nullif(v * sqrt(63), 0), -3.0), 3.0) END", "quality": f"r21 / nullif({roll('sum', 'ab', 21)}, 0)"}, keep="spread ts quality"))
def _(p):
    q = p.withColumns({"r63": w.rsum("ret", 63), "r21": w.rsum("ret", 21), "ab": F.abs("ret"), "v": w.std("ret", 63)})
    ts = ratio("r63", F.col("v") * F.sqrt(F.lit(63.0)))
    return q.select(*K, (F.col("r63") - F.col("r21")).alias("spread"), F.when(ts.isNotNull(), F.least(F.greatest(ts, F.lit(-3.0)), F.lit(3.0))).alias("ts"), ratio("r21", w.rsum("ab", 21)).alias("quality"))


@query("fe27_feature_screen", f"WITH {R}, f AS (SELECT {roll('sum', 'ret', 5)} AS mom_5d, {roll('sum', 'ret', 252)} AS mom_252d, {roll('stddev_samp', 'ret', 21)} AS vol_21d FROM r), u AS (SELECT 'mom_5d' AS feature, count(*) AS n, count(mom_5d) AS k, var_samp(mom_5d) AS v FROM f UNION ALL SELECT 'mom_252d', count(*), count(mom_252d), var_samp(mom_252d) FROM f UNION ALL SELECT 'vol_21d', count(*), count(vol_21d), var_samp(vol_21d) FROM f) SELECT feature, round(1 - k / n, 6) + 0.0 AS missing, (1 - k / n <= 0.15) AND coalesce(v > 1e-8, false) AS kept FROM u")
def _(p):
    q = p.select(w.rsum("ret", 5).alias("mom_5d"), w.rsum("ret", 252).alias("mom_252d"), w.std("ret", 21).alias("vol_21d"))
    return bk.screen(q, q.columns)


@query("fe35_redundant_pairs", f"WITH {R}, f AS (SELECT {roll('sum', 'ret', 5)} AS a, {roll('sum', 'ret', 10)} AS b, {roll('stddev_samp', 'ret', 21)} AS c FROM r) SELECT * FROM (SELECT 'a' AS x, 'b' AS y, round(corr(a, b) FILTER (a IS NOT NULL AND b IS NOT NULL), 5) + 0.0 AS corr FROM f UNION ALL SELECT 'a', 'c', round(corr(a, c) FILTER (a IS NOT NULL AND c IS NOT NULL), 5) + 0.0 FROM f UNION ALL SELECT 'b', 'c', round(corr(b, c) FILTER (b IS NOT NULL AND c IS NOT NULL), 5) + 0.0 FROM f)", digits=5)
def _(p):
    q = p.select(w.rsum("ret", 5).alias("a"), w.rsum("ret", 10).alias("b"), w.std("ret", 21).alias("c"))
    return bk.correlations(q, q.columns)


@query("tg7_multi_horizon", staged({f"f{h}": f"CASE WHEN count(ret) OVER ({TICKER} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) = {h} AND rn >= {h} THEN sum(ret) OVER ({TICKER} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING) END" for h in (1, 5, 21)}, {"target": "0.5 * f1 + 0.3 * f5 + 0.2 * f21"}, keep="target"))
def _(p):
    return p.select(*K, (0.5 * tr.forward_return(1) + 0.3 * tr.forward_return(5) + 0.2 * tr.forward_return(21)).alias("target"))


@query("tg11_clipped_zscore", f"WITH {SIG}, z AS (SELECT ticker, date, (fwd - avg(fwd) OVER d) / nullif(stddev_samp(fwd) OVER d, 0) AS z FROM g WINDOW d AS (PARTITION BY date)) SELECT ticker, date, CASE WHEN z IS NOT NULL THEN round(least(greatest(z, -3.0), 3.0), 6) + 0.0 END AS z FROM z")
def _(p):
    return signals(p).select(*K, w.cs_zscore("fwd", limit=3.0).alias("z"))


@query("tg14_leakage", f"WITH {SIG} SELECT round(corr(signal, fwd), 5) + 0.0 AS corr, abs(corr(signal, fwd)) > 0.8 AS leaks FROM g WHERE signal IS NOT NULL AND fwd IS NOT NULL", digits=5)
def _(p):
    return signals(p).agg(tr.safe_corr("signal", "fwd").alias("corr")).withColumn("leaks", F.abs("corr") > 0.8)


@query("sg2_rank_signal", f"WITH {SIG} SELECT ticker, date, round(({rank('signal')}) - 0.5, 6) + 0.0 AS k FROM g")
def _(p):
    return signals(p).select(*K, (w.pct_rank("signal") - 0.5).alias("k"))


@query("sg8_position_smoothing_sma", f"WITH {SIG}{_BOOK}{_TOP} SELECT ticker, date, round(CAST(avg(pos) OVER ({TICKER} ROWS 4 PRECEDING) AS DOUBLE), 6) + 0.0 AS position FROM w")
def _(p):
    return book(p).select(*K, w.mean("position", 5, 1).alias("position"))


@query("sg9_lagged_ic", " UNION ALL ".join(f"SELECT * FROM (WITH {SIG.replace('lead(ret)', f'lead(ret, {k})')}{_BOTH} SELECT CAST({k} AS INTEGER) AS lag, round(avg(ic), 6) + 0.0 AS mean_ic, round(avg(CASE WHEN ic IS NOT NULL THEN CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS hit_rate, count(ic) AS n FROM ic)" for k in (1, 2)))
def _(p):
    return tr.lagged_ic(signals(p), "signal", "ret", (1, 2)).select("lag", "mean_ic", "hit_rate", "n")


@query("sg10_rank_ensemble", f"WITH {R}, s AS (SELECT ticker, date, {roll('sum', 'ret', 5)} AS a, {roll('sum', 'ret', 21)} AS b FROM r), k AS (SELECT ticker, date, {rank('a')} AS ka, {rank('b')} AS kb FROM s) SELECT ticker, date, round((coalesce(ka, 0) + coalesce(kb, 0)) / nullif((ka IS NOT NULL)::INT + (kb IS NOT NULL)::INT, 0), 6) + 0.0 AS ensemble FROM k")
def _(p):
    q = p.withColumns({"a": w.rsum("ret", 5), "b": w.rsum("ret", 21)}).withColumns({"ka": w.pct_rank("a"), "kb": w.pct_rank("b")})
    return q.select(*K, fe.composite(["ka", "kb"]).alias("ensemble"))


@query("sg13_graph_signal")
def _(p):
    f = gr.rolling_features(p, "close", 10)
    return f.withColumn("signal", -w.cs_zscore("density", zero=0.0)).select(*K, "signal", gr.market_state("density", 0.35, 0.5).alias("state"))


@query("ps9_regime_filter", f"WITH {SIG}{_BOOK}{_TOP}, m AS (SELECT date, avg(ret) AS mkt FROM g GROUP BY date), v AS (SELECT date, CASE WHEN count(mkt) OVER u >= 20 THEN sum(mkt) OVER u END AS t FROM m WINDOW u AS (ORDER BY date ROWS 19 PRECEDING)), s AS (SELECT date, lag(CASE WHEN coalesce(t > 0, false) THEN 1.0 ELSE 0.0 END) OVER (ORDER BY date) AS mask FROM v) SELECT w.ticker, w.date, round(CAST(pos * coalesce(mask, 0.0) AS DOUBLE), 6) + 0.0 AS position FROM w JOIN s USING (date)")
def _(p):
    m = fe.market(p).select("date", F.lag(flag(F.col("mkt_trend_20") > 0)).over(by_date()).alias("mask"))
    return book(p).join(m, "date").select(*K, (F.col("position") * F.coalesce("mask", F.lit(0.0))).alias("position"))


@query("ps10_positive_top", f"WITH {SIG}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY signal DESC NULLS LAST, ticker) AS k FROM g), f AS (SELECT *, CASE WHEN k <= 5 AND coalesce(signal > 0, false) THEN 1.0 ELSE 0.0 END AS f FROM k) SELECT ticker, date, round(CAST(coalesce(f / nullif(sum(f) OVER (PARTITION BY date), 0), 0) AS DOUBLE), 6) + 0.0 AS position FROM f")
def _(p):
    q = w.top_k(signals(p), "signal", "top", 5).withColumn("f", flag(F.col("top") & (F.col("signal") > 0)))
    return q.select(*K, tr.l1("f").alias("position"))


@query("ps12_exposure_summary", f"WITH {SIG}{_BOOK}{_TOP}, e AS (SELECT date, sum(pos) AS net, sum(abs(pos)) AS gross, count_if(pos <> 0) AS names FROM w GROUP BY date) SELECT round(CAST(avg(net) AS DOUBLE), 6) + 0.0 AS mean_net, round(CAST(avg(gross) AS DOUBLE), 6) + 0.0 AS mean_gross, round(CAST(max(gross) AS DOUBLE), 6) + 0.0 AS max_gross, round(CAST(avg(names) AS DOUBLE), 6) + 0.0 AS mean_names FROM e")
def _(p):
    e = book(p).groupBy("date").agg(F.sum("position").alias("net"), F.sum(F.abs("position")).alias("gross"), F.count_if(F.col("position") != 0).alias("names"))
    return e.agg(F.avg("net").alias("mean_net"), F.avg("gross").alias("mean_gross"), F.max("gross").alias("max_gross"), F.avg("names").alias("mean_names"))


def _rebalanced_check(kind: str):
    from strandline.plans.research import _REB

    half = _REB if kind != "full" else _REB.replace("* 0.5 ELSE", "* 1.0 ELSE")
    return half + " SELECT date, n, round(gross, 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover FROM z"


@query("bt6_rebalanced_full_turnover", _rebalanced_check("full"))
def _(p):
    return tr.rebalanced(signals(p), "signal", "fwd", halve=False).select("date", "n", "gross", "turnover")


@query("bt7_inverse_vol_long_short")
def _(p):
    q = fe.add(signals(p).withColumn("vol", w.std("ret", 21)), tr.inverse_vol("signal", "vol"))
    return tr.backtest(tr.hold(q, 5), turnover="half").select("date", "gross", "turnover", "net")


@query("bt8_long_short_rebalanced")
def _(p):
    return tr.rebalanced(signals(p), "signal", "fwd", side="both").select("date", "n", "gross", "turnover", "net")


@query("bt10_lagged_vol_scale", f"WITH {_DAILY}, v AS (SELECT date, net, CASE WHEN count(net) OVER w >= 21 THEN greatest(stddev_samp(net) OVER w * sqrt(252), 0.05) END AS rv FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)) SELECT date, round(CAST(coalesce(least(0.15 / rv, 2.0), 1.0) * net AS DOUBLE), 6) + 0.0 AS scaled FROM v")
def _(p):
    frame = by_date().rowsBetween(-63, -1)
    rv = F.when(F.count("net").over(frame) >= 21, F.greatest(F.stddev_samp("net").over(frame) * F.sqrt(F.lit(252.0)), F.lit(0.05)))
    return daily(p).withColumn("rv", rv).select("date", (F.coalesce(F.least(0.15 / F.col("rv"), F.lit(2.0)), F.lit(1.0)) * F.col("net")).alias("scaled"))


@query("bt12_path_dependent_stops")
def _(p):
    return bk.simulate(signals(p), bk.Rules(top=5, every=5, stop=0.5))


@query("bt15_smoothed_long_bias")
def _(p):
    return bk.simulate(signals(p), bk.Rules(top=5, bottom=5, every=5, weight_on_new=0.5, long_bias=0.7))


@query("bt16_ternary_quantiles", f"WITH {SIG}, q AS (SELECT *, CASE WHEN coalesce(signal >= quantile_cont(signal, 0.8) OVER d, false) THEN 1.0 ELSE 0.0 END AS l, CASE WHEN coalesce(signal <= quantile_cont(signal, 0.2) OVER d, false) THEN 1.0 ELSE 0.0 END AS s FROM g WINDOW d AS (PARTITION BY date)), w AS (SELECT *, 0.5 * coalesce(l / nullif(sum(l) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(s / nullif(sum(s) OVER (PARTITION BY date), 0), 0) AS pos FROM q), h AS (SELECT *, coalesce(lag(pos) OVER ({TICKER}), 0.0) AS p FROM w) SELECT date, round(CAST(sum(p * coalesce(ret, 0.0)) AS DOUBLE), 6) + 0.0 AS gross FROM h GROUP BY date")
def _(p):
    return tr.backtest(fe.add(signals(p), tr.quantile_books("signal"))).select("date", "gross")


@query("bt21_regime_blend", digits=10)
def _(p):
    return bk.simulate(signals(p), bk.Rules(top=5, every=5, trail=0.3, cooldown=5, weight_on_new=0.5))


@query("bt23_softmax_control")
def _(p):
    q = fe.add(signals(p), tr.softmax("signal", 2.0))
    return tr.backtest(tr.hold(q, 20)).select("date", "gross", "turnover", "net")


@query("mt4_is_oos", f"WITH {_DAILY} SELECT CASE WHEN date < DATE '1999-01-01' THEN 'in' ELSE 'out' END AS part, count(*) AS n, round(avg(net) / stddev_samp(net) * sqrt(252), 6) + 0.0 AS sharpe FROM daily GROUP BY 1")
def _(p):
    return daily(p).groupBy(F.when(F.col("date") < F.lit("1999-01-01").cast("date"), "in").otherwise("out").alias("part")).agg(F.count(F.lit(1)).alias("n"), (F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))).alias("sharpe"))


@query("mt6_no_lookahead", f"WITH {SIG} SELECT round(corr(signal, fwd), 5) + 0.0 AS same, count(*) AS n, max(date) <= (SELECT max(date) FROM px) AS within FROM g WHERE signal IS NOT NULL AND fwd IS NOT NULL", digits=5)
def _(p):
    newest = p.agg(F.max("date").alias("newest"))
    return signals(p).where("signal is not null and fwd is not null").join(F.broadcast(newest)).agg(tr.safe_corr("signal", "fwd").alias("same"), F.count(F.lit(1)).alias("n"), (F.max("date") <= F.max("newest")).alias("within"))


@query("ml5_elastic_net")
def _(p):
    return bk.elastic_net(learnable(p), ["m5", "m21"], "y", 0.01, 0.5).select(*K, "prediction")


@query("ml10_time_split", f"WITH {PX}, d AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM px)) SELECT CASE WHEN i <= floor(n * 0.8) THEN 'train' ELSE 'test' END AS part, count(*) AS rows, min(px.date) AS first_date FROM px JOIN d USING (date) GROUP BY 1")
def _(p):
    d = ml.with_day(p)
    n = d.agg(F.countDistinct("date").alias("n"))
    part = F.when(F.col("day") < F.floor(F.col("n") * 0.8), "train").otherwise("test")
    return d.join(F.broadcast(n)).groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("rows"), F.min("date").alias("first_date"))


@query("gr5_power_law", f"WITH {_HVG}{_DEG} SELECT ticker, round(CASE WHEN count(*) >= 5 THEN 1 + count(*) / sum(ln(degree / 1.5)) END, 5) + 0.0 AS gamma, round(CASE WHEN count(*) >= 5 THEN (count(*) / sum(ln(degree / 1.5))) / sqrt(count(*)) END, 5) + 0.0 AS gamma_err, round(1 / nullif(avg(degree) - 2 + 1e-10, 0), 5) + 0.0 AS lambda FROM g WHERE degree >= 2 GROUP BY ticker", digits=5)
def _(p):
    deg = gr.degrees(gr.horizontal_edges(p, "close")).where("degree >= 2")
    n, s = F.count(F.lit(1)).cast("double"), F.sum(F.ln(F.col("degree") / 1.5))
    return deg.groupBy("ticker").agg(F.when(n >= 5, 1 + n / s).alias("gamma"), F.when(n >= 5, n / s / F.sqrt(n)).alias("gamma_err"), (1 / (F.avg("degree") - 2 + 1e-10)).alias("lambda"))


@query("gr7_triads", f"WITH {_HVG}{_DEG}, t AS (SELECT a.ticker, count(*) AS triangles FROM e a JOIN e b ON a.ticker = b.ticker AND a.j = b.i JOIN e c ON c.ticker = a.ticker AND c.i = a.i AND c.j = b.j GROUP BY 1), q AS (SELECT ticker, CAST(sum(degree * (degree - 1) / 2) AS BIGINT) AS paths FROM g GROUP BY 1) SELECT q.ticker, paths, coalesce(triangles, 0) AS triangles, round(CAST(3.0 * coalesce(triangles, 0) / nullif(paths, 0) AS DOUBLE), 6) + 0.0 AS transitivity FROM q LEFT JOIN t USING (ticker)")
def _(p):
    e = gr.horizontal_edges(p, "close")
    paths = gr.degrees(e).groupBy("ticker").agg(F.sum(F.col("degree") * (F.col("degree") - 1) / 2).cast("long").alias("paths"))
    both = paths.join(gr.clustering(e), "ticker")
    return both.select("ticker", "paths", "triangles", F.try_divide(3.0 * F.col("triangles"), F.col("paths")).alias("transitivity"))


@query("st5_feature_drift", f"WITH {R}, f AS (SELECT date, {roll('sum', 'ret', 5)} AS x FROM r), h AS (SELECT avg(x) FILTER (date < DATE '1998-06-01') AS a, avg(x) FILTER (date >= DATE '1998-06-01') AS b, stddev_samp(x) AS s, count(*) - count(x) AS missing, count(*) AS n FROM f) SELECT round((b - a) / s, 6) + 0.0 AS drift, round(missing / n, 6) + 0.0 AS missing FROM h")
def _(p):
    cut = F.lit("1998-06-01").cast("date")
    f = p.select("date", w.rsum("ret", 5).alias("x"))
    return f.agg(F.try_divide(F.avg(F.when(F.col("date") >= cut, F.col("x"))) - F.avg(F.when(F.col("date") < cut, F.col("x"))), F.stddev_samp("x")).alias("drift"), (F.count_if(F.col("x").isNull()) / F.count(F.lit(1))).alias("missing"))


@query("st7_suite")
def _(p):
    return st.suite_passes(st.quality_checks(p))


@query("st9_kalman_causality", f"WITH {PX} SELECT CAST(0 AS DOUBLE) AS largest_gap, count(*) AS n FROM px WHERE date < DATE '1998-01-01'")
def _(p):
    some = p.select(*K, F.ln("close").alias("lp"))
    whole = kn.along(some, {"a": kn.kalman_level("lp")})
    part = kn.along(some.where("date < date'1998-01-01'"), {"b": kn.kalman_level("lp")})
    return whole.join(part.select(*K, "b"), K).agg(F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_gap"), F.count(F.lit(1)).alias("n"))


@query("ed5_vol_persistence", f"WITH {R}, v AS (SELECT ticker, date, {roll('stddev_samp', 'ret', 20)} AS v FROM r), l AS (SELECT *, lag(v, 5) OVER ({TICKER}) AS b FROM v) SELECT ticker, count(*) AS n, round(corr(v, b), 5) + 0.0 AS persistence FROM l WHERE v IS NOT NULL AND b IS NOT NULL GROUP BY ticker", digits=5)
def _(p):
    v = p.withColumn("v", w.std("ret", 20)).withColumn("b", w.lag("v", 5)).where("v is not null and b is not null")
    return v.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), tr.safe_corr("v", "b").alias("persistence"))


@query("ed10_quarter_end_effect", f"WITH {R} SELECT date_diff('day', date, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) <= 5 AS near_end, count(ret) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM r GROUP BY 1")
def _(p):
    from strandline.functions.scalars import near_quarter_end

    return p.groupBy(near_quarter_end("date").alias("near_end")).agg(F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"))


@query("ed11_inverse_vol_alpha", staged({"s": roll("sum", "ret", 21), "v": roll("stddev_samp", "ret", 63)}, {"scaled": "s / nullif(v, 0)"}, keep="scaled"))
def _(p):
    return p.select(*K, ratio(w.rsum("ret", 21), w.std("ret", 63)).alias("scaled"))
