"""Queries of the window, cross-section, selection and set operators."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.operators import features as fe
from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.operators.intervals import interval_join
from strandline.operators.order_stats import Quantile, ShareBelow, with_order_stats
from strandline.plans.registry import PX, R, TICKER, lagged, query, rank, roll, staged, table_query, win
from strandline.sources import panel

K = ["ticker", "date"]


@query("src4_parquet_panel", f"WITH {PX} SELECT ticker, date, round(open, 4) + 0.0 AS open, round(high, 4) + 0.0 AS high, round(low, 4) + 0.0 AS low, round(close, 4) + 0.0 AS close, round(volume, 4) + 0.0 AS volume FROM px", digits=4)
def _(p):
    return p.select(*K, "open", "high", "low", "close", "volume")


@query("src9_split_by_date", f"WITH {R} SELECT date < DATE '1996-01-01' AS in_sample, count(*) AS n, count(DISTINCT ticker) AS tickers, round(avg(ret), 6) + 0.0 AS mean_ret FROM r GROUP BY 1")
def _(p):
    return panel.in_sample(p, "1996-01-01").withColumn("in_sample", F.lit(True)).unionByName(panel.out_of_sample(p, "1996-01-01").withColumn("in_sample", F.lit(False))).groupBy("in_sample").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("ticker").alias("tickers"), F.avg("ret").alias("mean_ret"))


@query("w1_lag_lead", staged({"lag1": lagged("ret"), "lag5": lagged("ret", 5), "lead1": lagged("ret", -1)}, keep="lag1 lag5 lead1"))
def _(p):
    return p.select(*K, w.lag("ret").alias("lag1"), w.lag("ret", 5).alias("lag5"), w.lag("ret", -1).alias("lead1"))


@query("w2_diff_pct_change", staged({"d1": f"ret - {lagged('ret')}", "p5": f"close / {lagged('close', 5)} - 1", "p21": f"close / {lagged('close', 21)} - 1"}, keep="d1 p5 p21"))
def _(p):
    return p.select(*K, w.diff("ret").alias("d1"), w.pct_change("close", 5).alias("p5"), w.pct_change("close", 21).alias("p21"))


@query("w3_rolling_moments", staged({"s": roll("sum", "ret", 5), "m": roll("avg", "ret", 21), "d": roll("stddev_samp", "ret", 21), "v": roll("var_samp", "ret", 10), "lo": roll("min", "ret", 21), "hi": roll("max", "ret", 21)}, keep="s m d v lo hi"))
def _(p):
    return p.select(*K, w.rsum("ret", 5).alias("s"), w.mean("ret", 21).alias("m"), w.std("ret", 21).alias("d"), w.rolling(F.var_samp("ret"), "ret", 10).alias("v"), w.rmin("ret", 21).alias("lo"), w.rmax("ret", 21).alias("hi"))


@query("w4_rolling_min_periods", staged({"m": roll("avg", "ret", 20, 14), "d": roll("stddev_samp", "ret", 20, 14), "p": roll("stddev_pop", "ret", 60, 30)}, keep="m d p"))
def _(p):
    return p.select(*K, w.mean("ret", 20, 14).alias("m"), w.std("ret", 20, 14).alias("d"), w.std("ret", 60, 30, ddof=0).alias("p"))


@query("w5_rolling_quantiles", staged({"q80": roll("quantile_cont({x}, 0.8)", "ret", 126), "med": roll("quantile_cont({x}, 0.5)", "ret", 21), "pct": f"CASE WHEN count(ret) OVER {win(21)} >= 21 THEN len(list_filter(list(ret) FILTER (ret IS NOT NULL) OVER {win(21)}, lambda v: v < ret)) / 20.0 END"}, keep="q80 med pct"))
def _(p):
    return with_order_stats(p.select(*K, "ret"), {"q80": Quantile("ret", 126, 0.8), "med": Quantile("ret", 21, 0.5), "pct": ShareBelow("ret", 21)}).drop("ret")


_B = {"a": "CASE WHEN ret IS NOT NULL AND volume IS NOT NULL THEN ret END", "b": "CASE WHEN ret IS NOT NULL AND volume IS NOT NULL THEN volume END"}


@query("w6_rolling_corr_beta", staged(_B, {"c": f"CASE WHEN count(a) OVER {win(21)} >= 21 THEN covar_pop(a, b) OVER {win(21)} / nullif(stddev_pop(a) OVER {win(21)} * stddev_pop(b) OVER {win(21)}, 0) END", "cv": f"CASE WHEN count(a) OVER {win(21)} >= 21 THEN covar_samp(a, b) OVER {win(21)} / nullif(var_samp(b) OVER {win(21)}, 0) END"}, keep="c cv"))
def _(p):
    return p.select(*K, w.corr("ret", "volume", 21).alias("c"), w.beta("ret", "volume", 21).alias("cv"))


@query("w7_rolling_skew_kurt", staged({"sk": roll("skewness", "ret", 63), "ku": roll("kurtosis", "ret", 63)}, keep="sk ku", digits=4), digits=4)
def _(p):
    return p.select(*K, w.skew("ret", 63).alias("sk"), w.kurt("ret", 63).alias("ku"))


@query("w8_rolling_reducers", staged({"pos": "CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END", "up": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END", "ab": "abs(ret)", "g": "1 + ret"}, {"ps": roll("avg", "pos", 21), "ur": f"({roll('sum', 'up', 21)}) / (({roll('sum', 'ab', 21)}) + 1e-10)", "pr": f"({roll('product', 'g', 21)}) - 1"}, keep="ps ur pr"))
def _(p):
    return p.select(*K, w.positive_share("ret", 21).alias("ps"), w.up_ratio("ret", 21).alias("ur"), w.rolling_product("ret", 21).alias("pr"))


_MKT = R + ", m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date)"


@query("w9_expanding_median", f"WITH {_MKT}, e AS (SELECT date, mkt, CASE WHEN count(mkt) OVER w >= 60 THEN quantile_cont(mkt, 0.5) OVER w END AS med FROM m WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)) SELECT date, round(mkt, 6) + 0.0 AS mkt, round(med, 6) + 0.0 AS med FROM e")
def _(p):
    m = p.groupBy("date").agg(F.avg("ret").alias("mkt"))
    return with_order_stats(m, {"med": Quantile("mkt", None, 0.5, 60)}, key=None)


@query("w10_cumulative", staged({"r0": "0.001 * coalesce(ret, 0.0)"}, {"cs": f"sum(r0) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)", "cp": f"product(1 + r0) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)"}, {"dd": f"cp / max(cp) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) - 1"}, keep="cs cp dd"))
def _(p):
    q = p.withColumn("r0", F.lit(0.001) * F.coalesce("ret", F.lit(0.0))).withColumns({"cs": F.sum("r0").over(w.so_far()), "cp": w.cumprod("r0")})
    return q.select(*K, "cs", "cp", w.drawdown("cp").alias("dd"))


@query("w14_pct_rank", staged({"rk": rank("ret"), "rkv": rank("volume")}, keep="rk rkv"))
def _(p):
    return p.select(*K, w.pct_rank("ret").alias("rk"), w.pct_rank("volume").alias("rkv"))


@query("w15_ranks", f"WITH {PX} SELECT ticker, date, CAST(row_number() OVER (PARTITION BY date ORDER BY volume, ticker) AS INTEGER) AS first_rank, CAST(dense_rank() OVER (PARTITION BY date ORDER BY volume) AS INTEGER) AS dense, CAST(rank() OVER (PARTITION BY date ORDER BY volume DESC) AS INTEGER) AS down FROM px")
def _(p):
    d = Window.partitionBy("date")
    return p.select(*K, F.row_number().over(d.orderBy("volume", "ticker")).alias("first_rank"), F.dense_rank().over(d.orderBy("volume")).alias("dense"), F.rank().over(d.orderBy(F.desc("volume"))).alias("down"))


@query("w16_quantile_bucket", f"WITH {PX} SELECT ticker, date, CAST((volume > quantile_cont(volume, 0.2) OVER d)::INT + (volume > quantile_cont(volume, 0.4) OVER d)::INT + (volume > quantile_cont(volume, 0.6) OVER d)::INT + (volume > quantile_cont(volume, 0.8) OVER d)::INT AS INTEGER) AS bucket FROM px WINDOW d AS (PARTITION BY date)")
def _(p):
    return p.select(*K, w.quantile_bucket("volume", 5).alias("bucket"))


@query("w17_cut", f"WITH {R} SELECT ticker, date, CASE WHEN ret IS NULL THEN NULL WHEN ret <= -0.2 THEN 'crash' WHEN ret <= 0 THEN 'down' WHEN ret <= 0.2 THEN 'up' ELSE 'surge' END AS label FROM r")
def _(p):
    r = F.col("ret")
    return p.select(*K, F.when(r.isNull(), None).when(r <= -0.2, "crash").when(r <= 0, "down").when(r <= 0.2, "up").otherwise("surge").alias("label"))


@query("w18_run_length", f"WITH {R}, s AS (SELECT ticker, date, CAST(CASE WHEN ret > 0 THEN 1 ELSE 0 END AS INTEGER) AS state, row_number() OVER ({TICKER}) - row_number() OVER (PARTITION BY ticker, CASE WHEN ret > 0 THEN 1 ELSE 0 END ORDER BY date) AS island FROM r) SELECT ticker, date, state, CAST(row_number() OVER (PARTITION BY ticker, state, island ORDER BY date) AS INTEGER) AS run FROM s")
def _(p):
    q = p.select(*K, F.when(F.col("ret") > 0, 1).otherwise(0).alias("state"))
    return w.run_length(q, "state", "run")


@query("w19_change_rate", staged({"state": "CASE WHEN ret > 0 THEN 1 ELSE 0 END"}, {"change": f"CASE WHEN state <> {lagged('state')} THEN 1.0 ELSE 0.0 END"}, {"rate": roll("avg", "change", 21)}, keep="change rate"))
def _(p):
    q = p.withColumn("state", F.when(F.col("ret") > 0, 1).otherwise(0)).withColumn("change", scalars.flag(F.col("state") != w.lag("state")))
    return q.select(*K, "change", w.mean("change", 21).alias("rate"))


@query("w20_market_rolling", f"WITH {_MKT}, x AS (SELECT date, mkt, CASE WHEN count(mkt) OVER w >= 20 THEN stddev_samp(mkt) OVER w END AS vol FROM m WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)) SELECT r.ticker, r.date, round(x.mkt, 6) + 0.0 AS mkt, round(x.vol, 6) + 0.0 AS vol, round(r.ret - x.mkt, 6) + 0.0 AS excess FROM r LEFT JOIN x USING (date)")
def _(p):
    return fe.with_market(p).select(*K, "mkt", F.col("mkt_vol_20").alias("vol"), (F.col("ret") - F.col("mkt")).alias("excess"))


@query("w21_expanding_zscore", staged({"z": f"(ret - avg(ret) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)) / nullif(stddev_samp(ret) OVER ({TICKER} ROWS UNBOUNDED PRECEDING), 0)"}, keep="z"))
def _(p):
    return p.select(*K, scalars.ratio(F.col("ret") - F.avg("ret").over(w.so_far()), F.stddev_samp("ret").over(w.so_far())).alias("z"))


# -- projections, filters, nulls, reshaping ------------------------------------------------------------------


@query("prj5_conditional", f"WITH {R} SELECT ticker, date, CASE WHEN ret > 0 THEN 'up' WHEN ret < 0 THEN 'down' ELSE 'flat' END AS side, round(CASE WHEN abs(ret) > 0.5 THEN sign(ret) * 0.5 ELSE ret END, 6) + 0.0 AS cut FROM r")
def _(p):
    r = F.col("ret")
    return p.select(*K, F.when(r > 0, "up").when(r < 0, "down").otherwise("flat").alias("side"), F.when(F.abs(r) > 0.5, F.signum(r) * 0.5).otherwise(r).alias("cut"))


@query("flt2_date_membership", f"WITH {R}, d AS (SELECT date FROM r GROUP BY date HAVING avg(ret) > 0.2) SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM r WHERE date IN (SELECT date FROM d)")
def _(p):
    days = p.groupBy("date").agg(F.avg("ret").alias("m")).where("m > 0.2").select("date")
    return p.join(days, "date", "left_semi").select(*K, "ret")


@query("flt4_first_valid_date", f"WITH {R}, m AS (SELECT *, {roll('avg', 'ret', 21)} AS m21 FROM r), c AS (SELECT date, count(m21) AS n FROM m GROUP BY date), f AS (SELECT min(date) AS start FROM c WHERE n >= 12) SELECT ticker, date, round(m21, 6) + 0.0 AS m21 FROM m WHERE date >= (SELECT start FROM f)")
def _(p):
    q = p.withColumn("m21", w.mean("ret", 21))
    start = q.groupBy("date").agg(F.count("m21").alias("n")).where("n >= 12").agg(F.min("date").alias("start"))
    return q.join(F.broadcast(start), F.col("date") >= F.col("start")).select(*K, "m21")


@query("flt5_complete_dates", f"WITH {PX}, n AS (SELECT count(DISTINCT ticker) AS k FROM px), d AS (SELECT date FROM px GROUP BY date HAVING count(close) = (SELECT k FROM n)) SELECT ticker, date, round(close, 4) + 0.0 AS close FROM px WHERE date IN (SELECT date FROM d)", digits=4)
def _(p):
    return panel.complete_dates(p).select(*K, "close")


@query("flt6_min_count", f"WITH {R} SELECT date, count(ret) AS n, round(CASE WHEN count(ret) > 10 THEN stddev_samp(ret) END, 6) + 0.0 AS dispersion FROM r GROUP BY date HAVING count(ret) > 5")
def _(p):
    return p.groupBy("date").agg(F.count("ret").alias("n"), F.when(F.count("ret") > 10, F.stddev_samp("ret")).alias("dispersion")).where("n > 5")


@query("nul1_fill", f"WITH {R}, m AS (SELECT *, {roll('avg', 'ret', 21)} AS m21 FROM r) SELECT ticker, date, round(coalesce(m21, 0.0), 6) + 0.0 AS zero, round(coalesce(m21, quantile_cont(m21, 0.5) OVER (PARTITION BY date)), 6) + 0.0 AS median FROM m")
def _(p):
    q = p.withColumn("m21", w.mean("ret", 21))
    return q.select(*K, F.coalesce("m21", F.lit(0.0)).alias("zero"), F.coalesce("m21", F.percentile("m21", 0.5).over(w.section())).alias("median"))


@query("nul2_fill_along", staged({"x": "CASE WHEN rn % 3 = 0 THEN ret END"}, {"f": f"last_value(x IGNORE NULLS) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)", "b": f"first_value(x IGNORE NULLS) OVER ({TICKER} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"}, keep="f b"))
def _(p):
    q = p.withColumn("x", F.when(F.col("rn") % 3 == 0, F.col("ret")))
    return q.select(*K, w.ffill("x").alias("f"), w.bfill("x").alias("b"))


@query("nul3_replace", staged({"v": "nullif(volume, 1.0)", "q": "ret / CASE WHEN volume - 1 = 0 THEN 1 ELSE volume - 1 END"}, keep="v q"))
def _(p):
    d = F.col("volume") - 1
    return p.select(*K, F.nullif(F.col("volume"), F.lit(1.0)).alias("v"), (F.col("ret") / F.when(d == 0, 1.0).otherwise(d)).alias("q"))


_BR = [f"Brand#{i}" for i in (11, 12, 13)]


@query("rsh1_pivot", f"WITH {R} SELECT date, " + ", ".join(f"round(max(CASE WHEN ticker = '{b}' THEN ret END), 6) + 0.0 AS {b.lower().replace('#', '_')}" for b in _BR) + " FROM r GROUP BY date")
def _(p):
    wide = p.groupBy("date").pivot("ticker", _BR).agg(F.first("ret"))
    return wide.toDF("date", *(b.lower().replace("#", "_") for b in _BR))


@query("rsh2_unpivot", f"WITH {PX} SELECT ticker, date, field, round(value, 4) + 0.0 AS value FROM (SELECT ticker, date, unnest(['open', 'close', 'volume']) AS field, unnest([open, close, volume]) AS value FROM px)", digits=4)
def _(p):
    return p.unpivot(K, ["open", "close", "volume"], "field", "value")


@query("rsh5_transitions", f"WITH {R}, s AS (SELECT ticker, CASE WHEN ret > 0 THEN 1 ELSE 0 END AS a, lead(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER ({TICKER}) AS b FROM r) SELECT CAST(a AS INTEGER) AS state, round(avg(CASE WHEN b = 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS to_0, round(avg(CASE WHEN b = 1 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS to_1 FROM s WHERE b IS NOT NULL GROUP BY a")
def _(p):
    q = p.select("ticker", "date", F.when(F.col("ret") > 0, 1).otherwise(0).alias("state"))
    q = q.withColumn("next", w.lag("state", -1)).where("next is not null")
    return q.groupBy("state").agg(F.avg((F.col("next") == 0).cast("double")).alias("to_0"), F.avg((F.col("next") == 1).cast("double")).alias("to_1"))


@query("rsh9_reindex_fill", f"WITH {PX}, g AS (SELECT t.ticker, d.date FROM (SELECT DISTINCT ticker FROM px) t CROSS JOIN (SELECT DISTINCT date FROM px) d) SELECT g.ticker, g.date, round(last_value(px.close IGNORE NULLS) OVER (PARTITION BY g.ticker ORDER BY g.date ROWS UNBOUNDED PRECEDING), 4) + 0.0 AS close FROM g LEFT JOIN px ON px.ticker = g.ticker AND px.date = g.date", digits=4)
def _(p):
    days = p.select("date").distinct()
    grid = p.select("ticker").distinct().crossJoin(days)  # the calendar of every ticker is the result itself
    return grid.join(p.select(*K, "close"), K, "left").select(*K, w.ffill("close").alias("close"))


# -- joins ---------------------------------------------------------------------------------------------------


@query("jn1_left_fill", f"WITH {R}, b AS (SELECT ticker, date, 1.0 / count(*) OVER (PARTITION BY date) AS pos FROM r WHERE ret > 0.5) SELECT r.ticker, r.date, round(coalesce(b.pos, 0.0), 6) + 0.0 AS pos FROM r LEFT JOIN b ON b.ticker = r.ticker AND b.date = r.date")
def _(p):
    b = p.where("ret > 0.5").select(*K, (1.0 / F.count(F.lit(1)).over(w.section())).alias("pos"))
    return p.join(b, K, "left").select(*K, F.coalesce("pos", F.lit(0.0)).alias("pos"))


@query("jn3_outer_ensemble", f"WITH {R}, a AS (SELECT ticker, date, {roll('sum', 'ret', 5)} AS x FROM r), b AS (SELECT ticker, date, -ret AS x FROM r), j AS (SELECT coalesce(a.ticker, b.ticker) AS ticker, coalesce(a.date, b.date) AS date, a.x AS x1, b.x AS x2 FROM (SELECT * FROM a WHERE x IS NOT NULL) a FULL JOIN (SELECT * FROM b WHERE x > 0) b ON a.ticker = b.ticker AND a.date = b.date) SELECT ticker, date, round((coalesce(x1, 0) + coalesce(x2, 0)) / ((x1 IS NOT NULL)::INT + (x2 IS NOT NULL)::INT), 6) + 0.0 AS ensemble FROM j")
def _(p):
    a = p.withColumn("x1", w.rsum("ret", 5)).where("x1 is not null").select(*K, "x1")
    b = p.withColumn("x2", -F.col("ret")).where("x2 > 0").select(*K, "x2")
    return a.join(b, K, "full").select(*K, fe.composite(["x1", "x2"]).alias("ensemble"))


@query("jn6_semi_anti", f"WITH {R}, h AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) <= 3 AS held FROM r), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM h)) SELECT n.ticker, n.date FROM h n JOIN d ON d.date = n.date LEFT JOIN h o ON o.ticker = n.ticker AND o.date = d.before AND o.held WHERE n.held AND d.before IS NOT NULL AND o.ticker IS NULL")
def _(p):
    h = w.top_k(p, "volume", "held", 3).where("held").select(*K)
    days = h.select("date").distinct().withColumn("next", F.lead("date").over(Window.partitionBy(F.lit(1)).orderBy("date")))
    old = h.join(days, "date").where("next is not null").select("ticker", F.col("next").alias("date"))
    later = h.join(days.select(F.col("next").alias("date")).where("date is not null"), "date", "left_semi")
    return later.join(old, K, "left_anti").select(*K)


@query("jn8_pairs", f"WITH {R} SELECT a.ticker AS ticker_a, b.ticker AS ticker_b, count(*) AS n, round(corr(a.ret, b.ret), 5) + 0.0 AS corr FROM r a JOIN r b ON a.date = b.date AND a.ticker < b.ticker WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY 1, 2", digits=5)
def _(p):
    a, b = (p.where("ret is not null").select("date", F.col("ticker").alias(f"ticker_{s}"), F.col("ret").alias(f"ret_{s}")) for s in "ab")
    return a.join(b, "date").where("ticker_a < ticker_b").groupBy("ticker_a", "ticker_b").agg(F.count(F.lit(1)).alias("n"), tr.safe_corr("ret_a", "ret_b").alias("corr"))


@query("jn9_band_match", f"WITH {R}, f AS (SELECT ticker, avg(ret) AS m, stddev_samp(ret) AS s FROM r GROUP BY ticker) SELECT a.ticker AS ticker_a, min_by(b.ticker, (abs(a.m - b.m), b.ticker)) AS best, count(*) AS candidates FROM f a JOIN f b ON a.ticker <> b.ticker AND abs(a.s - b.s) <= 0.2 * abs(a.s) GROUP BY 1")
def _(p):
    f = p.groupBy("ticker").agg(F.avg("ret").alias("m"), F.stddev_samp("ret").alias("s"))
    # Bands on a logarithmic scale: a deviation within a fifth lies in one of four neighbouring bands, so the join has a key.
    banded = f.where("s >= 0").withColumn("band", F.coalesce(F.floor(F.ln(F.nullif("s", F.lit(0.0))) / math.log(1.2)), F.lit(-(1 << 40))))
    a = banded.toDF("ticker_a", "m_a", "s_a", "own").withColumn("band", F.explode(F.sequence(F.col("own") - 2, F.col("own") + 1)))
    b = banded.toDF("ticker_b", "m_b", "s_b", "band")
    near = a.join(b, "band").where((F.col("ticker_a") != F.col("ticker_b")) & (F.abs(F.col("s_a") - F.col("s_b")) <= 0.2 * F.abs("s_a")))
    return near.groupBy("ticker_a").agg(F.min_by("ticker_b", F.struct(F.abs(F.col("m_a") - F.col("m_b")), "ticker_b")).alias("best"), F.count(F.lit(1)).alias("candidates"))


@query("jn10_event_window", f"WITH {R}, e AS (SELECT ticker, date AS event FROM r WHERE ret > 2) SELECT e.ticker, e.event, count(*) AS n, round(avg(r.ret), 6) + 0.0 AS mean_ret FROM e JOIN r ON r.ticker = e.ticker AND r.date BETWEEN e.event - INTERVAL 10 DAY AND e.event + INTERVAL 10 DAY GROUP BY 1, 2")
def _(p):
    e = p.where("ret > 2").select("ticker", F.col("date").alias("event"))
    near = interval_join(p, e, "date", F.date_sub("event", 10), F.date_add("event", 10), 21, ["ticker"])
    return near.groupBy("ticker", "event").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


@query("jn11_folds", f"WITH {R}, f AS (SELECT CAST(range AS INTEGER) AS fold, DATE '1995-01-01' + INTERVAL (range * 180) DAY AS a, DATE '1995-01-01' + INTERVAL (range * 180 + 365) DAY AS b FROM range(8)) SELECT fold, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean_ret FROM f JOIN r ON r.date >= f.a AND r.date < f.b GROUP BY fold")
def _(p):
    start = F.lit("1995-01-01").cast("date")
    folds = p.sparkSession.range(8).select(F.col("id").cast("int").alias("fold"), F.date_add(start, (F.col("id") * 180).cast("int")).alias("a"), F.date_add(start, (F.col("id") * 180 + 365).cast("int")).alias("b"))
    return interval_join(p, folds, "date", F.col("a"), F.date_sub("b", 1), 365).groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"))


# -- sorting, selection, sets ----------------------------------------------------------------------------------


@query("tk1_top_share", f"WITH {R}, k AS (SELECT ticker, date, row_number() OVER (PARTITION BY date ORDER BY ret DESC, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM r WHERE ret IS NOT NULL) SELECT ticker, date FROM k WHERE k <= greatest(floor(n * 0.2), 1)")
def _(p):
    return w.top_k(p.where("ret is not null"), "ret", "top", share=0.2, at_least=1).where("top").select(*K)


@query("tk2_smallest", f"WITH {R}, k AS (SELECT ticker, date, ret, row_number() OVER (PARTITION BY date ORDER BY ret, ticker) AS k FROM r WHERE ret IS NOT NULL) SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM k WHERE k <= 3")
def _(p):
    return w.top_k(p.where("ret is not null"), "ret", "low", 3, descending=False).where("low").select(*K, "ret")


@query("tk3_quantile_threshold", f"WITH {R} SELECT ticker, date, CAST(CASE WHEN ret >= quantile_cont(ret, 0.8) OVER d THEN 1 WHEN ret <= quantile_cont(ret, 0.2) OVER d THEN -1 ELSE 0 END AS INTEGER) AS side FROM r WINDOW d AS (PARTITION BY date)")
def _(p):
    d = w.section()
    return p.select(*K, F.when(F.col("ret") >= F.percentile("ret", 0.8).over(d), 1).when(F.col("ret") <= F.percentile("ret", 0.2).over(d), -1).otherwise(0).alias("side"))


@query("tk4_leaderboard", f"WITH {R} SELECT ticker, round(avg(ret) / stddev_samp(ret), 6) + 0.0 AS score FROM r GROUP BY ticker ORDER BY score DESC, ticker LIMIT 10")
def _(p):
    return p.groupBy("ticker").agg(F.round(F.try_divide(F.avg("ret"), F.stddev_samp("ret")), 6).alias("score")).orderBy(F.desc("score"), "ticker").limit(10)


@query("set2_union_keep_last", f"WITH {R}, u AS (SELECT ticker, date, ret, 1 AS src FROM r WHERE date < DATE '1996-01-01' UNION ALL SELECT ticker, date, -ret, 2 FROM r WHERE date >= DATE '1995-06-01'), k AS (SELECT *, row_number() OVER (PARTITION BY ticker, date ORDER BY src DESC) AS n FROM u) SELECT ticker, date, round(ret, 6) + 0.0 AS ret FROM k WHERE n = 1")
def _(p):
    a = p.where("date < date'1996-01-01'").select(*K, "ret", F.lit(1).alias("src"))
    b = p.where("date >= date'1995-06-01'").select(*K, (-F.col("ret")).alias("ret"), F.lit(2).alias("src"))
    return a.unionByName(b).groupBy(*K).agg(F.max_by("ret", "src").alias("ret"))


@query("set3_intersect", f"WITH {R} SELECT date FROM r WHERE ticker = 'Brand#11' INTERSECT SELECT date FROM r WHERE ticker = 'Brand#12'")
def _(p):
    return p.where("ticker = 'Brand#11'").select("date").intersect(p.where("ticker = 'Brand#12'").select("date"))


# -- scalars ---------------------------------------------------------------------------------------------------


def _cdf(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    poly = f"((((1.061405429 * {t} - 1.453152027) * {t} + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    return f"0.5 * (1.0 + sign({x}) * (1.0 - {poly} * exp(-{x} * {x} / 2.0)))"


@query("fn_math", f"WITH {R} SELECT ticker, date, round(exp(-abs(ret)), 6) + 0.0 AS e, round(sqrt(abs(ret)), 6) + 0.0 AS s, round(greatest(least(ret, 1.0), -0.5), 6) + 0.0 AS c, round(atan2(ret, 1.0), 6) + 0.0 AS a, round(log2(volume), 6) + 0.0 AS l, round({_cdf('ret')}, 6) + 0.0 AS phi FROM r WHERE ret IS NOT NULL")
def _(p):
    r = F.col("ret")
    return p.where("ret is not null").select(*K, F.exp(-F.abs(r)).alias("e"), F.sqrt(F.abs(r)).alias("s"), scalars.clip("ret", -0.5, 1.0).alias("c"), F.atan2(r, F.lit(1.0)).alias("a"), F.log2("volume").alias("l"), scalars.normal_cdf("ret").alias("phi"))


@query("fn_dates", f"WITH {PX} SELECT DISTINCT date, CAST(year(date) AS INTEGER) AS y, CAST(month(date) AS INTEGER) AS m, CAST(date_trunc('month', date) AS DATE) AS month_start, CAST((dayofweek(date) + 6) % 7 AS INTEGER) AS weekday, day(date) <= 3 OR date_diff('day', date, last_day(date)) < 1 AS tom, date_diff('day', date, CAST(date_trunc('quarter', date) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE)) <= 5 AS quarter_end, round((date_diff('day', DATE '2000-01-06', date) - 29.53 * floor(date_diff('day', DATE '2000-01-06', date) / 29.53)) / 29.53, 6) + 0.0 AS lunar FROM px")
def _(p):
    d = "date"
    return p.select(d).distinct().select(d, F.year(d).alias("y"), F.month(d).alias("m"), F.trunc(d, "month").alias("month_start"), F.weekday(d).alias("weekday"), scalars.turn_of_month(d).alias("tom"), scalars.near_quarter_end(d).alias("quarter_end"), scalars.lunar_phase(d).alias("lunar"))


@table_query("fn_json", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k FROM events GROUP BY event_type")
def _(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count(F.get_json_object("props", "$.k")).alias("with_k"))
