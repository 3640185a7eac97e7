"""Queries of aggregates, feature blocks, targets, signals, positions, backtests and metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clip, flag, ratio
from strandline.operators import features as fe
from strandline.operators import stats as st
from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.plans.registry import PX, R, TICKER, lagged, query, rank, roll, staged, win
from strandline.plans.windows import _cdf

K = ["ticker", "date"]
MOM = {"m5": roll("sum", "ret", 5), "m21": roll("sum", "ret", 21)}
#: A signal and the next row's return, for everything after the features.
SIG = R + f", g AS (SELECT *, {roll('sum', 'ret', 21)} AS signal, lead(ret) OVER ({TICKER}) AS fwd FROM r)"


def signals(p):
    return p.withColumns({"signal": w.rsum("ret", 21), "fwd": w.lag("ret", -1)})


# -- aggregates ----------------------------------------------------------------------------------------------


@query("ag1_daily_distribution", f"WITH {R} SELECT date, round(avg(ret), 6) + 0.0 AS mean, round(stddev_samp(ret), 6) + 0.0 AS std, round(min(ret), 6) + 0.0 AS min, round(max(ret), 6) + 0.0 AS max, round(median(ret), 6) + 0.0 AS median, count(ret) AS n, CAST(coalesce(count_if(ret > 0), 0) AS BIGINT) AS n_pos FROM r GROUP BY date")
def _(p):
    return p.groupBy("date").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.min("ret").alias("min"), F.max("ret").alias("max"), F.percentile("ret", 0.5).alias("median"), F.count("ret").alias("n"), F.count_if(F.col("ret") > 0).alias("n_pos"))


@query("ag2_conditional_counts", f"WITH {R} SELECT ticker, CAST(coalesce(count_if(ret > 0), 0) AS BIGINT) AS up, CAST(coalesce(count_if(ret < 0), 0) AS BIGINT) AS down, round(avg(CASE WHEN ret IS NOT NULL THEN CASE WHEN abs(ret) > 0.2 THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS big FROM r GROUP BY ticker")
def _(p):
    return p.groupBy("ticker").agg(F.count_if(F.col("ret") > 0).alias("up"), F.count_if(F.col("ret") < 0).alias("down"), F.avg((F.abs("ret") > 0.2).cast("double")).alias("big"))


@query("ag3_exposures", f"WITH {R} SELECT date, round(sum(ret), 6) + 0.0 AS net, round(sum(abs(ret)), 6) + 0.0 AS gross, round(sum(greatest(ret, 0.0)) / nullif(-sum(least(ret, 0.0)), 0), 6) + 0.0 AS long_short FROM r WHERE ret IS NOT NULL GROUP BY date")
def _(p):
    r = F.col("ret")
    return p.where("ret is not null").groupBy("date").agg(F.sum(r).alias("net"), F.sum(F.abs(r)).alias("gross"), F.try_divide(F.sum(F.greatest(r, F.lit(0.0))), F.nullif(-F.sum(F.least(r, F.lit(0.0))), F.lit(0.0))).alias("long_short"))


@query("ag5_daily_pearson", f"WITH {SIG} SELECT date, CASE WHEN count(*) > 5 THEN round(corr(signal, fwd), 5) + 0.0 END AS ic, count(*) AS n FROM g WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY date", digits=5)
def _(p):
    return tr.information_coefficient(signals(p), "signal", "fwd", rank=False)


_BOTH = f", b AS (SELECT * FROM g WHERE signal IS NOT NULL AND fwd IS NOT NULL), k AS (SELECT *, {rank('signal')} AS rx, {rank('fwd')} AS ry FROM b), ic AS (SELECT date, CASE WHEN count(*) > 5 THEN covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0) END AS ic, count(*) AS n FROM k GROUP BY date)"


@query("ag6_daily_spearman", f"WITH {SIG}{_BOTH} SELECT date, round(ic, 6) + 0.0 AS ic, n FROM ic")
def _(p):
    return tr.information_coefficient(signals(p), "signal", "fwd")


@query("ag7_beta_alpha", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), j AS (SELECT r.*, m.mkt FROM r JOIN m USING (date) WHERE ret IS NOT NULL) SELECT ticker, round(covar_samp(ret, mkt) / var_samp(mkt), 5) + 0.0 AS beta, round(avg(ret) - covar_samp(ret, mkt) / var_samp(mkt) * avg(mkt), 5) + 0.0 AS alpha FROM j GROUP BY ticker", digits=5)
def _(p):
    b = F.try_divide(F.covar_samp("ret", "mkt"), F.var_samp("mkt"))
    return fe.with_market(p).where("ret is not null").groupBy("ticker").agg(b.alias("beta"), (F.avg("ret") - b * F.avg("mkt")).alias("alpha"))


@query("ag8_winsorise", f"WITH {R} SELECT ticker, date, CASE WHEN ret IS NOT NULL THEN round(least(greatest(ret, quantile_cont(ret, 0.05) OVER d), quantile_cont(ret, 0.95) OVER d), 6) + 0.0 END AS ret FROM r WINDOW d AS (PARTITION BY date)")
def _(p):
    return p.select(*K, w.winsorise("ret", 0.05, 0.95).alias("ret"))


@query("ag9_moments", f"WITH {R} SELECT ticker, round(skewness(ret), 4) + 0.0 AS skew, round(kurtosis(ret), 4) + 0.0 AS kurt FROM r GROUP BY ticker", digits=4)
def _(p):
    return p.groupBy("ticker").agg(st.sample_skew("ret").alias("skew"), st.sample_kurt("ret").alias("kurt"))


@query("ag10_mode", f"WITH {PX}, c AS (SELECT ticker, volume, count(*) AS n FROM px GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY n DESC, volume) AS k FROM c) SELECT ticker, volume AS mode, n FROM k WHERE k = 1")
def _(p):
    c = p.groupBy("ticker", "volume").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("ticker").agg(F.max_by("volume", F.struct("n", -F.col("volume"))).alias("mode"), F.max("n").alias("n"))


@query("ag11_argmax", f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY ret DESC NULLS LAST, date) AS k FROM r) SELECT ticker, date AS best_date, round(ret, 6) + 0.0 AS best FROM k WHERE k = 1")
def _(p):
    return p.where("ret is not null").groupBy("ticker").agg(F.max_by("date", F.struct("ret", -F.unix_date("date"))).alias("best_date"), F.max("ret").alias("best"))


@query("ag12_distinct", f"WITH {PX} SELECT count(DISTINCT ticker) AS tickers, count(DISTINCT date) AS dates, count(DISTINCT volume) AS volumes, count(*) AS n FROM px")
def _(p):
    return p.agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("date").alias("dates"), F.countDistinct("volume").alias("volumes"), F.count(F.lit(1)).alias("n"))


@query("ag13_monthly_returns", f"WITH {R}, m AS (SELECT date, 0.01 * avg(ret) AS net FROM r GROUP BY date) SELECT CAST(date_trunc('month', date) AS DATE) AS period, round(product(1 + net) - 1, 6) + 0.0 AS ret, count(net) AS n FROM m WHERE net IS NOT NULL GROUP BY 1")
def _(p):
    m = p.groupBy("date").agg((0.01 * F.avg("ret")).alias("net")).where("net is not null")
    return tr.compounded(m)


@query("ag14_describe", f"WITH {PX} SELECT ticker, count(close) AS n, round(min(volume), 4) + 0.0 AS lo, round(quantile_cont(volume, 0.25), 4) + 0.0 AS q25, round(quantile_cont(volume, 0.5), 4) + 0.0 AS q50, round(quantile_cont(volume, 0.75), 4) + 0.0 AS q75, round(max(volume), 4) + 0.0 AS hi, count_if(volume < 0) > 0 AS has_negative FROM px GROUP BY ticker", digits=4)
def _(p):
    q = F.percentile
    return p.groupBy("ticker").agg(F.count("close").alias("n"), F.min("volume").alias("lo"), q("volume", 0.25).alias("q25"), q("volume", 0.5).alias("q50"), q("volume", 0.75).alias("q75"), F.max("volume").alias("hi"), (F.count_if(F.col("volume") < 0) > 0).alias("has_negative"))


@query("ag15_completeness", f"WITH {R} SELECT ticker, count(*) AS n, CAST(coalesce(count_if(ret IS NULL), 0) AS BIGINT) AS missing_ret, count(*) - count(DISTINCT date) AS duplicates FROM r GROUP BY ticker")
def _(p):
    return p.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("ret").isNull()).alias("missing_ret"), (F.count(F.lit(1)) - F.countDistinct("date")).alias("duplicates"))


@query("ag16_quality_report", f"WITH {R} SELECT count(*) AS n, round(100.0 * count_if(ret IS NULL) / count(*), 6) AS missing_pct, round(100.0 * count_if(ret = 0) / count(ret), 6) AS zero_pct, round(100.0 * count_if(abs(ret) > 0.2) / count(ret), 6) AS extreme_pct, round(avg(ret), 6) AS mean_ret, round(stddev_samp(ret), 6) AS vol FROM r")
def _(p):
    n, k = F.count(F.lit(1)), F.count("ret")
    return p.agg(n.alias("n"), (100.0 * F.count_if(F.col("ret").isNull()) / n).alias("missing_pct"), (100.0 * F.count_if(F.col("ret") == 0) / k).alias("zero_pct"), (100.0 * F.count_if(F.abs("ret") > 0.2) / k).alias("extreme_pct"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("vol"))


@query("ag17_entropy", f"WITH {R}, c AS (SELECT ticker, floor(ret * 4) AS b, count(*) AS n FROM r WHERE ret IS NOT NULL GROUP BY 1, 2), q AS (SELECT ticker, n / sum(n) OVER (PARTITION BY ticker) AS q FROM c) SELECT ticker, round(-sum(q * log2(q + 1e-10)), 6) + 0.0 AS entropy FROM q GROUP BY ticker")
def _(p):
    c = p.where("ret is not null").groupBy("ticker", F.floor(F.col("ret") * 4).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    q = c.withColumn("q", F.col("n") / F.sum("n").over(w.section("ticker")))
    return q.groupBy("ticker").agg((-F.sum(F.col("q") * F.log2(F.col("q") + 1e-10))).alias("entropy"))


@query("ag18_concentration", f"WITH {R}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY abs(ret) DESC NULLS LAST, ticker) AS k FROM r) SELECT date, round(coalesce(sum(ret * ret) / nullif(sum(abs(ret)) * sum(abs(ret)), 0), 0), 6) + 0.0 AS hhi, round(coalesce(sum(CASE WHEN k <= 5 THEN abs(ret) END) / nullif(sum(abs(ret)), 0), 0), 6) + 0.0 AS top5, round(coalesce(sum(CASE WHEN k <= 10 THEN abs(ret) END) / nullif(sum(abs(ret)), 0), 0), 6) + 0.0 AS top10 FROM k GROUP BY date")
def _(p):
    return tr.top_share(p, "ret")


@query("ag19_rank_stability", f"WITH {R}, k AS (SELECT date, ticker FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY volume DESC, ticker) AS k FROM r) WHERE k <= 5), d AS (SELECT date, lag(date) OVER (ORDER BY date) AS before FROM (SELECT DISTINCT date FROM k)) SELECT d.date, round(count(o.ticker) / 5.0, 6) + 0.0 AS overlap FROM d JOIN k ON k.date = d.date LEFT JOIN k o ON o.date = d.before AND o.ticker = k.ticker WHERE d.before IS NOT NULL GROUP BY d.date")
def _(p):
    tops = w.top_k(p, "volume", "top", 5).where("top").groupBy("date").agg(F.collect_set("ticker").alias("s"))
    over = Window.partitionBy(F.lit(1)).orderBy("date")
    return tops.withColumn("o", F.lag("s").over(over)).where("o is not null").select("date", (F.size(F.array_intersect("s", "o")) / F.lit(5.0)).alias("overlap"))


@query("ag20_information_ratio", f"WITH {SIG}{_BOTH} SELECT round(avg(ic), 6) + 0.0 AS mean_ic, round(stddev_samp(ic), 6) + 0.0 AS std_ic, round(avg(ic) / stddev_samp(ic), 6) + 0.0 AS ir, round(avg(CASE WHEN ic IS NOT NULL THEN CASE WHEN round(ic, 9) > 0 THEN 1.0 ELSE 0.0 END END), 6) + 0.0 AS hit_rate, round(avg(ic) / (stddev_samp(ic) / sqrt(count(ic))), 6) + 0.0 AS t_stat, count(ic) AS n FROM ic")
def _(p):
    return tr.information_ratio(tr.information_coefficient(signals(p), "signal", "fwd"))


@query("ag21_conditional_ic", f"WITH {SIG}, v AS (SELECT *, CAST((volume > quantile_cont(volume, 0.25) OVER d)::INT + (volume > quantile_cont(volume, 0.5) OVER d)::INT + (volume > quantile_cont(volume, 0.75) OVER d)::INT AS INTEGER) AS bucket FROM g WINDOW d AS (PARTITION BY date)) SELECT bucket, count(*) AS n, round(corr(signal, fwd), 5) + 0.0 AS ic FROM v WHERE signal IS NOT NULL AND fwd IS NOT NULL GROUP BY bucket", digits=5)
def _(p):
    v = signals(p).withColumn("bucket", w.quantile_bucket("volume", 4)).where("signal is not null and fwd is not null")
    return v.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), tr.safe_corr("signal", "fwd").alias("ic"))


@query("ag22_period_stability", f"WITH {R}, d AS (SELECT *, dense_rank() OVER (ORDER BY date) AS i FROM r), n AS (SELECT max(i) AS m FROM d) SELECT CAST(least(floor((i - 1) / floor(m / 4.0)), 3) AS BIGINT) AS period, round(avg(ret), 6) + 0.0 AS mean, round(stddev_samp(ret), 6) + 0.0 AS std, round(avg(CASE WHEN ret IS NULL THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS missing FROM d, n GROUP BY 1")
def _(p):
    days = p.select("date").distinct().withColumn("i", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)
    n = days.agg(F.count(F.lit(1)).alias("m"))
    part = days.join(F.broadcast(n)).select("date", F.least(F.floor(F.col("i") / F.floor(F.col("m") / 4.0)), F.lit(3).cast("long")).alias("period"))
    return p.join(part, "date").groupBy("period").agg(F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("std"), F.avg(F.col("ret").isNull().cast("double")).alias("missing"))


@query("ag23_asset_summary", f"WITH {R}, c AS (SELECT *, product(1 + 0.01 * coalesce(ret, 0)) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS v FROM r), d AS (SELECT *, v / max(v) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM c) SELECT ticker, round(avg(ret) * 252, 6) + 0.0 AS ann_ret, round(stddev_samp(ret) * sqrt(252), 6) + 0.0 AS ann_vol, round(avg(ret) / stddev_samp(ret) * sqrt(252), 6) + 0.0 AS sharpe, round(min(dd), 6) + 0.0 AS max_dd FROM d GROUP BY ticker")
def _(p):
    q = p.withColumn("s", 0.01 * F.col("ret")).withColumn("v", w.cumprod("s")).withColumn("dd", w.drawdown("v"))
    return q.groupBy("ticker").agg((F.avg("ret") * 252).alias("ann_ret"), (F.stddev_samp("ret") * F.sqrt(F.lit(252.0))).alias("ann_vol"), (F.try_divide(F.avg("ret"), F.stddev_samp("ret")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.min("dd").alias("max_dd"))


@query("ag24_fingerprint", f"WITH {R} SELECT ticker, min(date) AS start, max(date) AS stop, count(*) AS n, round(avg(ret), 6) + 0.0 AS mean_ret, round(stddev_pop(ret), 6) + 0.0 AS std_ret, round(arg_max(close, date) / arg_min(close, date) - 1, 6) + 0.0 AS total_ret FROM r GROUP BY ticker")
def _(p):
    return p.groupBy("ticker").agg(F.min("date").alias("start"), F.max("date").alias("stop"), F.count(F.lit(1)).alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_pop("ret").alias("std_ret"), (F.max_by("close", "date") / F.min_by("close", "date") - 1).alias("total_ret"))


_DAILY = R + ", daily AS (SELECT date, 0.01 * avg(ret) AS net FROM r GROUP BY date HAVING avg(ret) IS NOT NULL)"


def daily(p):
    return p.groupBy("date").agg((0.01 * F.avg("ret")).alias("net")).where("net is not null")


@query("ag26_win_loss_runs", f"WITH {_DAILY}, u AS (SELECT date, net, net > 0 AS up, row_number() OVER (ORDER BY date) - row_number() OVER (PARTITION BY net > 0 ORDER BY date) AS i FROM daily), q AS (SELECT up, i, count(*) AS n, sum(net) AS s FROM u GROUP BY 1, 2) SELECT max(n) FILTER (up) AS max_wins, max(n) FILTER (NOT up) AS max_losses, round(sum(s) FILTER (up) / sum(n) FILTER (up), 6) + 0.0 AS avg_win, round(sum(s) FILTER (NOT up) / sum(n) FILTER (NOT up), 6) + 0.0 AS avg_loss FROM q")
def _(p):
    return tr.longest_runs(daily(p))


# -- features --------------------------------------------------------------------------------------------------


@query("fe1_momentum", staged({f"mom_{n}d": roll("sum", "ret", n) for n in (5, 10, 21, 63)} | {"pos": "CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END"}, {"mom_acceleration": "mom_5d - mom_21d", "mom_reversal": "-mom_5d", "mom_consistency": roll("avg", "pos", 21), "mom_zscore": f"(mom_21d - ({roll('avg', 'mom_21d', 63)})) / (({roll('stddev_samp', 'mom_21d', 63)}) + 1e-10)"}, keep="mom_5d mom_10d mom_21d mom_63d mom_acceleration mom_reversal mom_zscore mom_consistency"))
def _(p):
    return fe.add(p, fe.momentum()).select(*K, "mom_5d", "mom_10d", "mom_21d", "mom_63d", "mom_acceleration", "mom_reversal", "mom_zscore", "mom_consistency")


@query("fe2_volatility", staged({f"vol_{n}d": roll("stddev_samp", "ret", n) for n in (5, 10, 21)}, {"vol_ratio": "vol_5d / (vol_21d + 1e-10)", "vol_zscore": f"(vol_21d - ({roll('avg', 'vol_21d', 63)})) / (({roll('stddev_samp', 'vol_21d', 63)}) + 1e-10)", "vol_regime": f"CASE WHEN coalesce(vol_21d > ({roll('quantile_cont({x}, 0.8)', 'vol_21d', 126)}), false) THEN 1.0 ELSE 0.0 END"}, keep="vol_5d vol_10d vol_21d vol_ratio vol_zscore vol_regime"))
def _(p):
    return fe.add(p, fe.volatility()).select(*K, "vol_5d", "vol_10d", "vol_21d", "vol_ratio", "vol_zscore", "vol_regime")


@query("fe3_mean_reversion", staged({"lp": "ln(close)", "up": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END", "ab": "abs(ret)"}, {"ma_20_dev": f"lp - ({roll('avg', 'lp', 20)})", "ma_50_dev": f"lp - ({roll('avg', 'lp', 50)})", "bb_position": f"(lp - ({roll('avg', 'lp', 20)})) / (2 * ({roll('stddev_samp', 'lp', 20)}) + 1e-10)", "rsi_21": f"({roll('sum', 'up', 21)}) / (({roll('sum', 'ab', 21)}) + 1e-10)"}, keep="ma_20_dev ma_50_dev bb_position rsi_21"))
def _(p):
    return fe.add(p, fe.mean_reversion()).select(*K, "ma_20_dev", "ma_50_dev", "bb_position", "rsi_21")


def _soft(lo: str, hi: str) -> dict[str, str]:
    c = (f"0.5 * {lo}", f"({lo} + {hi}) / 2", f"1.5 * {hi}")
    e = [f"exp(-pow((v - {x}) / ({hi} - {lo} + 1e-10), 2))" for x in c]
    return {n: f"CASE WHEN {hi} <= {lo} THEN {d} ELSE {x} / ({e[0]} + {e[1]} + {e[2]}) END" for n, x, d in zip(("p_low", "p_mid", "p_high"), e, (0.33, 0.34, 0.33))}


@query("fe5_regime_softmax", staged({"v": roll("stddev_samp", "ret", 63)}, {"lo": roll("quantile_cont({x}, 0.33)", "v", 252), "hi": roll("quantile_cont({x}, 0.67)", "v", 252)}, _soft("lo", "hi"), {"regime_state": "CAST(CASE WHEN v IS NULL OR lo IS NULL THEN 0 WHEN v <= lo THEN 0 WHEN v >= hi THEN 2 ELSE 1 END AS INTEGER)", "regime_confidence": "greatest(p_low, p_mid, p_high)", "regime_entropy": "coalesce(-(p_low * ln(p_low + 1e-10) + p_mid * ln(p_mid + 1e-10) + p_high * ln(p_high + 1e-10)), 0.0)"}, keep="p_low p_mid p_high regime_confidence regime_entropy", raw="regime_state", digits=5), digits=5)
def _(p):
    return fe.add(p, fe.regime()).select(*K, "p_low", "p_mid", "p_high", "regime_confidence", "regime_entropy", "regime_state")


@query("fe7_cross_section", staged(MOM, {"r5": rank("m5"), "r21": rank("m21")}, keep="r5 r21"))
def _(p):
    q = p.withColumns({"m5": w.rsum("ret", 5), "m21": w.rsum("ret", 21)})
    return q.select(*K, w.pct_rank("m5").alias("r5"), w.pct_rank("m21").alias("r21"))


@query("fe9_baseline", staged({"m5": roll("sum", "ret", 5), "mom_20": roll("sum", "ret", 20), "vol_20": roll("stddev_samp", "ret", 20)}, {"mom5_over_vol20": "m5 / nullif(vol_20, 0)"}, keep="mom_20 vol_20 mom5_over_vol20"))
def _(p):
    return fe.add(p, fe.baseline()).select(*K, "mom_20", "vol_20", "mom5_over_vol20")


@query("fe11_trend", staged({"st": f"({roll('sum', 'ret', 20)}) / nullif(({roll('stddev_samp', 'ret', 20)}) * sqrt(20), 0)", "pos": "CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END"}, {"ac": f"st - {lagged('st', 5)}", "co": roll("avg", "pos", 20)}, {"trend_strength": lagged("st"), "trend_acceleration": lagged("ac"), "trend_consistency": lagged("co")}, keep="trend_strength trend_acceleration trend_consistency"))
def _(p):
    return fe.add(p, fe.trend()).select(*K, "trend_strength", "trend_acceleration", "trend_consistency")


@query("fe12_market_regime", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), v AS (SELECT date, CASE WHEN count(mkt) OVER w >= 20 THEN stddev_samp(mkt) OVER w END AS vol, CASE WHEN count(mkt) OVER w >= 20 THEN sum(mkt) OVER w END AS tr FROM m WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)), e AS (SELECT *, CASE WHEN count(vol) OVER w >= 60 THEN quantile_cont(vol, 0.5) OVER w END AS med FROM v WINDOW w AS (ORDER BY date ROWS UNBOUNDED PRECEDING)), f AS (SELECT date, CASE WHEN coalesce(vol > med, false) THEN 1.0 ELSE 0.0 END AS high_vol, CASE WHEN coalesce(tr > 0, false) THEN 1.0 ELSE 0.0 END AS uptrend FROM e) SELECT date, round(CAST(high_vol AS DOUBLE), 6) AS high_vol, round(CAST(uptrend AS DOUBLE), 6) AS uptrend, round(CAST(2 * uptrend + high_vol AS DOUBLE), 6) AS state FROM f")
def _(p):
    return fe.market_regime(p).select("date", "high_vol", "uptrend", "state")


@query("fe14_downside_clustering", staged({"dn": "CASE WHEN ret < 0 THEN ret END", "up": "CASE WHEN ret > 0 THEN ret END", "r2": "ret * ret"}, {"r2l": lagged("r2"), "downside_vol": roll("stddev_samp", "dn", 60, 20), "upside_vol": roll("stddev_samp", "up", 60, 20)}, {"a": "CASE WHEN r2l IS NOT NULL THEN r2 END", "b": "CASE WHEN r2 IS NOT NULL THEN r2l END"}, {"vol_clustering": f"CASE WHEN count(a) OVER {win(20)} >= 20 THEN covar_pop(a, b) OVER {win(20)} / nullif(stddev_pop(a) OVER {win(20)} * stddev_pop(b) OVER {win(20)}, 0) END"}, keep="downside_vol upside_vol vol_clustering", digits=4), digits=4)
def _(p):
    return fe.add(p, fe.downside()).select(*K, "downside_vol", "upside_vol", "vol_clustering")


@query("fe18_price_patterns", staged({"span": "high - low"}, {"bar_range": "span / nullif(close, 0)", "upper_shadow": "(high - greatest(open, close)) / nullif(span, 0)", "lower_shadow": "(least(open, close) - low) / nullif(span, 0)", "body": "abs(close - open) / nullif(span, 0)"}, keep="bar_range upper_shadow lower_shadow body"))
def _(p):
    return fe.add(p, fe.shadows()).select(*K, "bar_range", "upper_shadow", "lower_shadow", "body")


@query("fe19_short_composite", staged({"ext": f"close / nullif({roll('avg', 'close', 21)}, 0) - 1", "dd": f"close / nullif({roll('max', 'close', 55)}, 0) - 1", "vr": f"({roll('stddev_samp', 'ret', 21)}) / nullif({roll('stddev_samp', 'ret', 63)}, 0)"}, {"z1": "(ext - avg(ext) OVER d) / nullif(stddev_samp(ext) OVER d, 0)", "z2": "(dd - avg(dd) OVER d) / nullif(stddev_samp(dd) OVER d, 0)", "z3": "(vr - avg(vr) OVER d) / nullif(stddev_samp(vr) OVER d, 0)"}, {"sig": "(coalesce(z1, 0) + coalesce(z3, 0)) / nullif((z1 IS NOT NULL)::INT + (z3 IS NOT NULL)::INT, 0)", "risk": "z2"}, {"composite": "sig - 0.3 * risk"}, keep="composite").replace("FROM s0), s2", "FROM s0 WINDOW d AS (PARTITION BY date)), s2"))
def _(p):
    q = p.withColumns({"ext": ratio("close", w.mean("close", 21)) - 1, "dd": ratio("close", w.rmax("close", 55)) - 1, "vr": ratio(w.std("ret", 21), w.std("ret", 63))})
    q = q.withColumns({z: w.cs_zscore(c) for z, c in (("z1", "ext"), ("z2", "dd"), ("z3", "vr"))})
    return q.select(*K, (fe.composite(["z1", "z3"]) - 0.3 * F.col("z2")).alias("composite"))


@query("fe21_range_volatility", staged({"hl": "pow(ln(high / low), 2)", "gk": "0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2)", "t": f"greatest(high - low, abs(high - {lagged('close')}), abs(low - {lagged('close')}))"}, {"parkinson_21": f"sqrt(({roll('avg', 'hl', 21)}) / (4 * ln(2)) * 252)", "garman_klass_21": f"sqrt(greatest({roll('avg', 'gk', 21)}, CASE WHEN ({roll('avg', 'gk', 21)}) IS NOT NULL THEN 0.0 END) * 252)", "atr": roll("avg", "t", 14)}, {"atr_ratio": "atr / nullif(close, 0)"}, keep="parkinson_21 garman_klass_21 atr_ratio"))
def _(p):
    q = fe.add(p, fe.range_volatility())
    return q.select(*K, "parkinson_21", F.when(F.col("parkinson_21").isNotNull(), F.col("garman_klass_21")).alias("garman_klass_21"), "atr_ratio")


@query("fe22_oscillators", staged({"stoch_k": f"100 * (close - ({roll('min', 'low', 14)})) / nullif(({roll('max', 'high', 14)}) - ({roll('min', 'low', 14)}), 0)", "dist_from_high_55": f"close / nullif({roll('max', 'high', 55)}, 0) - 1", "up": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END", "ab": "abs(ret)"}, {"stoch_d": roll("avg", "stoch_k", 3), "rsi_simple": f"100 * ({roll('sum', 'up', 14)}) / (({roll('sum', 'ab', 14)}) + 1e-10)"}, keep="stoch_k stoch_d dist_from_high_55 rsi_simple"))
def _(p):
    return fe.add(p, fe.technical(), [{"rsi_simple": fe.rsi("simple")}]).select(*K, "stoch_k", "stoch_d", "dist_from_high_55", "rsi_simple")


@query("fe23_technical", staged({"sma_cross_5_21": f"({roll('avg', 'close', 5)}) / nullif({roll('avg', 'close', 21)}, 0) - 1", "donchian_20": f"(close - ({roll('min', 'low', 20)})) / nullif(({roll('max', 'high', 20)}) - ({roll('min', 'low', 20)}), 0)", "gap": f"open / nullif({lagged('close')}, 0) - 1", "volume_ratio": f"volume / nullif({roll('avg', 'volume', 20)}, 0)", "tp": "(high + low + close) / 3"}, {"fl": "tp * volume", "u": f"tp - {lagged('tp')}"}, {"pf": "CASE WHEN u > 0 THEN fl ELSE 0.0 END", "nf": "CASE WHEN u < 0 THEN fl ELSE 0.0 END"}, {"mfi_14": f"100 * ({roll('sum', 'pf', 14)}) / nullif(({roll('sum', 'pf', 14)}) + ({roll('sum', 'nf', 14)}), 0)"}, keep="sma_cross_5_21 donchian_20 gap volume_ratio mfi_14"))
def _(p):
    return fe.add(p, fe.technical(), fe.volume_features()).select(*K, "sma_cross_5_21", "donchian_20", "gap", "volume_ratio", "mfi_14")


@query("fe24_stat_arb", f"WITH {R}, m AS (SELECT date, avg(ret) AS mkt FROM r GROUP BY date), j AS (SELECT r.*, CASE WHEN ret IS NOT NULL THEN m.mkt END AS x FROM r LEFT JOIN m USING (date)), b AS (SELECT *, CASE WHEN count(x) OVER w >= 63 THEN covar_samp(ret, x) OVER w / nullif(var_samp(x) OVER w, 0) END AS beta FROM j WINDOW w AS ({TICKER} ROWS 62 PRECEDING)) SELECT ticker, date, round(beta, 5) + 0.0 AS beta_63, round(ret - beta * x, 5) + 0.0 AS idio_ret, round(ret - quantile_cont(ret, 0.5) OVER (PARTITION BY date), 5) + 0.0 AS rel_to_median FROM b", digits=5)
def _(p):
    return fe.add(fe.with_market(p), fe.relative()).select(*K, "beta_63", "idio_ret", "rel_to_median")


@query("fe25_standardise", staged({"z": "(ret - avg(ret) OVER d) / nullif(stddev_samp(ret) OVER d, 0)", "med": "quantile_cont(ret, 0.5) OVER d", "rk": f"({rank('ret')}) - 0.5"}, {"zc": "CASE WHEN z IS NOT NULL THEN least(greatest(z, -3.0), 3.0) END", "dv": "ret - med"}, {"rb": "dv / nullif(1.4826 * quantile_cont(abs(dv), 0.5) OVER (PARTITION BY date), 0)"}, {"rbc": "CASE WHEN rb IS NOT NULL THEN least(greatest(rb, -4.0), 4.0) END"}, keep="zc rk rbc").replace("FROM r), s1", "FROM r WINDOW d AS (PARTITION BY date)), s1"))
def _(p):
    q = fe.add(p, fe.standardise(["ret"], suffix="_z"), fe.standardise(["ret"], "rank", suffix="_k"), fe.standardise(["ret"], "robust", 4.0, "_b"))
    return q.select(*K, F.col("ret_z").alias("zc"), F.col("ret_k").alias("rk"), F.col("ret_b").alias("rbc"))


@query("fe28_volatility_class", staged({"v": roll("stddev_samp", "ret", 21)}, {"med": roll("quantile_cont({x}, 0.5)", "v", 252, 60), "dev": roll("stddev_samp", "v", 252, 60)}, {"vol_class": "CAST(CASE WHEN med IS NULL OR v IS NULL THEN 1 WHEN v < med - 0.5 * dev THEN 0 WHEN v > med + 0.5 * dev THEN 2 ELSE 1 END AS INTEGER)"}, keep="v", raw="vol_class"))
def _(p):
    return fe.add(p.withColumn("vol_21d", w.std("ret", 21)), fe.volatility_class()).select(*K, F.col("vol_21d").alias("v"), "vol_class")


@query("fe30_product_momentum", staged({"g": "1 + ret", "mom_sum": roll("sum", "ret", 21), "mom_pct": f"close / nullif({lagged('close', 21)}, 0) - 1"}, {"mom_product": f"({roll('product', 'g', 21)}) - 1"}, {"mom_skip": lagged("mom_product", 5)}, keep="mom_sum mom_product mom_pct mom_skip"))
def _(p):
    return fe.add(p, fe.kinds_of_momentum()).select(*K, "mom_sum", "mom_product", "mom_pct", "mom_skip")


@query("fe31_sector_relative", f"WITH {R}, s AS (SELECT *, substr(ticker, 7, 1) AS sector FROM r) SELECT ticker, date, sector, round(ret - avg(ret) OVER (PARTITION BY date, sector), 6) + 0.0 AS rel FROM s")
def _(p):
    q = p.withColumn("sector", F.substring("ticker", 7, 1))
    return q.select(*K, "sector", w.demean("ret", ["date", "sector"]).alias("rel"))


# -- targets and signals -----------------------------------------------------------------------------------------


def _fsum(h: int) -> str:
    f = f"({TICKER} ROWS BETWEEN 1 FOLLOWING AND {h} FOLLOWING)"
    return f"CASE WHEN count(ret) OVER {f} = {h} AND rn >= {h} THEN sum(ret) OVER {f} END"


@query("tg1_forward_sum", staged({"f5": _fsum(5), "f21": _fsum(21)}, {"m5": "f5 / 5"}, keep="f5 f21 m5"))
def _(p):
    return p.select(*K, tr.forward_return(5).alias("f5"), tr.forward_return(21).alias("f21"), tr.forward_return(5, "mean").alias("m5"))


@query("tg2_vol_normalised", staged({"f": _fsum(5), "v": roll("stddev_samp", "ret", 21)}, {"target": "f / (v + 1e-10)"}, keep="target"))
def _(p):
    return p.select(*K, ratio(tr.forward_return(5), w.std("ret", 21), 1e-10).alias("target"))


@query("tg3_rank_targets", staged({"f": _fsum(5)}, {"pct": rank("f"), "z": "(f - avg(f) OVER d) / nullif(stddev_samp(f) OVER d, 0)"}, {"sgn": "2 * pct - 1"}, keep="pct z sgn").replace("FROM s0), s2", "FROM s0 WINDOW d AS (PARTITION BY date)), s2"))
def _(p):
    q = p.withColumn("f", tr.forward_return(5))
    return q.select(*K, tr.rank_target("f").alias("pct"), tr.rank_target("f", "zscore").alias("z"), tr.rank_target("f", "signed").alias("sgn"))


@query("tg4_sign_targets", staged({"f": _fsum(5)}, {"bin": "CASE WHEN coalesce(f > 0, false) THEN 1.0 ELSE 0.0 END", "ter": "CASE WHEN f > 0.5 THEN 1.0 WHEN f < -0.5 THEN -1.0 ELSE 0.0 END"}, keep="bin ter"))
def _(p):
    q = p.withColumn("f", tr.forward_return(5))
    return q.select(*K, tr.sign_target("f").alias("bin"), tr.sign_target("f", 0.5).alias("ter"))


@query("tg5_price_forward", staged({f"f{h}": f"{lagged('close', -h)} / nullif(close, 0) - 1" for h in (1, 5, 21)}, keep="f1 f5 f21"))
def _(p):
    return p.select(*K, *(tr.forward_return(h, "price").alias(f"f{h}") for h in (1, 5, 21)))


@query("tg6_market_demeaned", staged({"f": _fsum(5)}, {"target": "f - avg(f) OVER (PARTITION BY date)"}, keep="target"))
def _(p):
    return p.withColumn("f", tr.forward_return(5)).select(*K, w.demean("f").alias("target"))


@query("tg8_ternary_rank", staged({"f": _fsum(5)}, {"k": rank("f")}, {"label": "CAST(CASE WHEN k >= 0.6 THEN 1 WHEN k <= 0.4 THEN -1 ELSE 0 END AS INTEGER)"}, keep="k", raw="label"))
def _(p):
    q = p.withColumn("f", tr.forward_return(5)).withColumn("k", w.pct_rank("f"))
    return q.select(*K, "k", tr.ternary_by_rank("k").alias("label"))


@query("tg9_probability", staged({"f": _fsum(5)}, {"z": "(f - avg(f) OVER d) / nullif(stddev_samp(f) OVER d, 0)"}, {"prob": _cdf("z")}, keep="prob").replace("FROM s0), s2", "FROM s0 WINDOW d AS (PARTITION BY date)), s2"))
def _(p):
    q = p.withColumn("f", tr.forward_return(5)).withColumn("z", w.cs_zscore("f"))
    return q.select(*K, tr.probability_target("z").alias("prob"))


@query("tg10_three_classes", staged({"f": _fsum(1)}, {"label": "CAST(CASE WHEN f > 0.01 THEN 2 WHEN f < -0.01 THEN 0 ELSE 1 END AS INTEGER)"}, keep="f", raw="label"))
def _(p):
    q = p.withColumn("f", tr.forward_return(1))
    return q.select(*K, "f", tr.three_classes("f").alias("label"))


@query("tg12_ic_decay", " UNION ALL ".join(f"SELECT * FROM (WITH {R}, g AS (SELECT ticker, date, {roll('sum', 'ret', 21)} AS s, lead(ret, {k}) OVER ({TICKER}) AS y FROM r) SELECT CAST({k} AS INTEGER) AS lag, count(*) AS n, round(corr(s, y), 5) + 0.0 AS ic FROM g WHERE s IS NOT NULL AND y IS NOT NULL)" for k in (1, 5, 10)), digits=5)
def _(p):
    q = p.select(*K, w.rsum("ret", 21).alias("s"), *(w.lag("ret", -k).alias(f"y{k}") for k in (1, 5, 10)))
    tall = q.select("s", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"y{k}").alias("y")) for k in (1, 5, 10)))).alias("e")).select("s", "e.lag", "e.y").where("s is not null and y is not null")
    return tall.groupBy("lag").agg(F.count(F.lit(1)).alias("n"), tr.safe_corr("s", "y").alias("ic"))


@query("sg1_zscore_signal", f"WITH {SIG} SELECT ticker, date, CASE WHEN signal IS NOT NULL THEN round(coalesce((signal - avg(signal) OVER d) / nullif(stddev_samp(signal) OVER d, 0), 0), 6) + 0.0 END AS z FROM g WINDOW d AS (PARTITION BY date)")
def _(p):
    return signals(p).select(*K, w.cs_zscore("signal", zero=0.0).alias("z"))


_BOOK = f", k AS (SELECT *, {rank('signal')} AS k FROM g)"


@query("sg3_threshold_turnover", f"WITH {SIG}{_BOOK}, t AS (SELECT unnest([0.6, 0.7, 0.8]) AS threshold), b AS (SELECT t.threshold, ticker, date, CASE WHEN round(k, 9) > threshold THEN 1.0 WHEN round(k, 9) < round(1 - threshold, 9) THEN -1.0 ELSE 0.0 END AS side FROM k, t), q AS (SELECT *, coalesce(side / nullif(sum(abs(side)) OVER (PARTITION BY threshold, date), 0), 0) AS pos FROM b), d AS (SELECT *, abs(pos - lag(pos) OVER (PARTITION BY threshold, ticker ORDER BY date)) AS d FROM q) SELECT CAST(threshold AS DOUBLE) AS threshold, date, round(coalesce(sum(d), 0), 6) + 0.0 AS turnover FROM d GROUP BY 1, 2")
def _(p):
    q = signals(p).withColumn("k", w.pct_rank("signal")).withColumn("threshold", F.explode(F.array(*map(F.lit, (0.6, 0.7, 0.8)))))
    q = q.withColumn("side", F.when(F.round("k", 9) > F.col("threshold"), 1.0).when(F.round("k", 9) < F.round(1 - F.col("threshold"), 9), -1.0).otherwise(0.0))
    q = q.withColumn("pos", tr.l1("side", by=["threshold", "date"]))
    d = F.abs(F.col("pos") - F.lag("pos").over(Window.partitionBy("threshold", "ticker").orderBy("date")))
    return q.withColumn("d", d).groupBy("threshold", "date").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("turnover"))


@query("sg4_autocorrelation", f"WITH {SIG}, l AS (SELECT ticker, date, signal, lag(signal) OVER ({TICKER}) AS before FROM g) SELECT date, count(*) AS n, CASE WHEN count(*) > 10 THEN round(corr(signal, before), 5) + 0.0 END AS ac FROM l WHERE signal IS NOT NULL AND before IS NOT NULL GROUP BY date", digits=5)
def _(p):
    q = signals(p).withColumn("before", w.lag("signal")).where("signal is not null and before is not null")
    return q.groupBy("date").agg(F.count(F.lit(1)).alias("n"), F.when(F.count(F.lit(1)) > 10, tr.safe_corr("signal", "before")).alias("ac"))


@query("sg11_reliability", f"WITH {SIG}, h AS (SELECT *, CASE WHEN signal IS NOT NULL AND fwd IS NOT NULL THEN CASE WHEN sign(signal) = sign(fwd) THEN 1.0 ELSE 0.0 END END AS hit FROM g) SELECT ticker, date, round(CAST(CASE WHEN count(hit) OVER w >= 20 THEN avg(hit) OVER w ELSE 1.0 / 3 END AS DOUBLE), 6) + 0.0 AS reliability FROM h WINDOW w AS ({TICKER} ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)")
def _(p):
    q = signals(p).withColumn("hit", (F.signum("signal") == F.signum("fwd")).cast("double"))
    return q.select(*K, tr.hit_ratio("hit").alias("reliability"))


@query("sg12_decay_weights", f"WITH {PX}, d AS (SELECT ticker, date, exp(-ln(2.0) * date_diff('day', date, max(date) OVER ()) / 126.0) AS wt FROM px) SELECT ticker, date, round(wt / avg(wt) OVER (PARTITION BY ticker), 6) + 0.0 AS weight FROM d")
def _(p):
    newest = p.agg(F.max("date").alias("newest"))
    q = p.join(F.broadcast(newest)).withColumn("wt", tr.decay_weight("date", "newest", 126))
    return q.select(*K, (F.col("wt") / F.avg("wt").over(w.section("ticker"))).alias("weight"))


# -- positions ---------------------------------------------------------------------------------------------------

_SIDE = ", s AS (SELECT *, CASE WHEN k > 0.5 THEN 1.0 WHEN k IS NOT NULL THEN -1.0 END AS side FROM k)"


def _l1(x: str, lev: float = 1.0) -> str:
    return f"coalesce({x} * {lev} / nullif(sum(abs({x})) OVER (PARTITION BY date), 0), 0)"


@query("ps1_equal_weight", f"WITH {SIG}{_BOOK}{_SIDE}, w AS (SELECT *, {_l1('side')} AS p FROM s) SELECT ticker, date, round(least(greatest(p, -0.1), 0.1), 6) + 0.0 AS position FROM w")
def _(p):
    return fe.add(signals(p), tr.equal_weight("signal", cap=0.1)).select(*K, "position")


@query("ps2_proportional", f"WITH {SIG}, a AS (SELECT *, CASE WHEN abs(signal) >= 0.5 THEN signal ELSE 0.0 END AS s FROM g), n AS (SELECT *, s - avg(s) OVER (PARTITION BY date) AS n FROM a) SELECT ticker, date, round({_l1('n')}, 6) + 0.0 AS position FROM n")
def _(p):
    return fe.add(signals(p), tr.proportional("signal", 0.5)).select(*K, "position")


@query("ps3_inverse_vol", f"WITH {SIG}, v AS (SELECT *, {roll('stddev_samp', 'ret', 21)} AS v0 FROM g), m AS (SELECT *, coalesce(v0, quantile_cont(v0, 0.5) OVER (PARTITION BY date)) AS v FROM v), q AS (SELECT *, sign(signal) / nullif(v, 0) AS q FROM m) SELECT ticker, date, round({_l1('q')}, 6) + 0.0 AS position FROM q")
def _(p):
    return fe.add(signals(p).withColumn("vol", w.std("ret", 21)), tr.inverse_vol("signal", "vol")).select(*K, "position")


_TOP = ", t AS (SELECT *, CASE WHEN coalesce(k > 1 - 0.2, false) THEN 1.0 ELSE 0.0 END AS l, CASE WHEN coalesce(k <= 0.2, false) THEN 1.0 ELSE 0.0 END AS sh FROM k), w AS (SELECT *, 0.5 * coalesce(l / nullif(sum(l) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(sh / nullif(sum(sh) OVER (PARTITION BY date), 0), 0) AS pos FROM t)"


def book(p):
    return fe.add(signals(p), tr.top_bottom("signal"))


@query("ps5_top_bottom", f"WITH {SIG}{_BOOK}{_TOP} SELECT ticker, date, round(CAST(pos AS DOUBLE), 6) + 0.0 AS position FROM w")
def _(p):
    return book(p).select(*K, "position")


@query("ps6_quantile_books", f"WITH {SIG}, q AS (SELECT *, CASE WHEN coalesce(signal >= quantile_cont(signal, 0.8) OVER d, false) THEN 1.0 ELSE 0.0 END AS l, CASE WHEN coalesce(signal <= quantile_cont(signal, 0.2) OVER d, false) THEN 1.0 ELSE 0.0 END AS s FROM g WINDOW d AS (PARTITION BY date)) SELECT ticker, date, round(CAST(0.5 * coalesce(l / nullif(sum(l) OVER (PARTITION BY date), 0), 0) - 0.5 * coalesce(s / nullif(sum(s) OVER (PARTITION BY date), 0), 0) AS DOUBLE), 6) + 0.0 AS position FROM q")
def _(p):
    return fe.add(signals(p), tr.quantile_books("signal")).select(*K, "position")


@query("ps7_softmax", f"WITH {SIG}, e AS (SELECT *, exp(signal / 2.0 - max(signal / 2.0) OVER (PARTITION BY date)) AS e FROM g) SELECT ticker, date, round(coalesce(e / nullif(sum(e) OVER (PARTITION BY date), 0), 0), 6) + 0.0 AS position FROM e")
def _(p):
    return fe.add(signals(p), tr.softmax("signal", 2.0)).select(*K, "position")


@query("ps11_hold", f"WITH {SIG}{_BOOK}{_TOP}, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM w)), j AS (SELECT w.ticker, w.date, d.day, d.day // 5 AS bucket, w.pos FROM w JOIN d USING (date)), f AS (SELECT ticker, bucket, pos FROM j WHERE day % 5 = 0) SELECT j.ticker, j.date, round(CAST(coalesce(f.pos, 0) AS DOUBLE), 6) + 0.0 AS position FROM j LEFT JOIN f ON f.ticker = j.ticker AND f.bucket = j.bucket")
def _(p):
    return tr.hold(book(p), 5).select(*K, "position")


# -- backtests and metrics -------------------------------------------------------------------------------------------


def _bt(lag: int, factor: float) -> str:
    held = f"lag(pos, {lag}) OVER ({TICKER})" if lag else "pos"
    return f"WITH {SIG}{_BOOK}{_TOP}, h AS (SELECT *, coalesce({held}, 0.0) AS p FROM w), d AS (SELECT *, abs(p - lag(p) OVER ({TICKER})) AS d FROM h), y AS (SELECT date, sum(p * coalesce(ret, 0.0)) AS gross, {factor} * coalesce(sum(d), 0.0) AS turnover, CAST(coalesce(count_if(p > 0), 0) AS BIGINT) AS longs, CAST(coalesce(count_if(p < 0), 0) AS BIGINT) AS shorts FROM d GROUP BY date) SELECT date, round(CAST(gross AS DOUBLE), 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover, longs, shorts, round(CAST(gross - turnover * 0.001 AS DOUBLE), 6) + 0.0 AS net FROM y"


def _bt_columns(d):
    return d.select("date", "gross", "turnover", "longs", "shorts", "net")


@query("bt1_same_row", _bt(0, 1.0))
def _(p):
    return _bt_columns(tr.backtest(book(p), lag=0))


@query("bt2_lagged_half_turnover", _bt(1, 0.5))
def _(p):
    return _bt_columns(tr.backtest(book(p), turnover="half"))


@query("bt3_lagged_full_turnover", _bt(1, 1.0))
def _(p):
    return _bt_columns(tr.backtest(book(p)))


@query("bt4_alpha_normalised", f"WITH {SIG}, a AS (SELECT *, coalesce(lag(signal) OVER ({TICKER}), 0.0) AS a FROM g), w AS (SELECT *, {_l1('a')} AS p FROM a), d AS (SELECT *, abs(p - coalesce(lag(p) OVER ({TICKER}), 0.0)) AS d FROM w) SELECT date, round(sum(p * coalesce(ret, 0)), 6) + 0.0 AS gross, round(0.5 * sum(d), 6) + 0.0 AS turnover FROM d GROUP BY date")
def _(p):
    q = signals(p).withColumn("a", F.coalesce(w.lag("signal"), F.lit(0.0))).withColumn("p", tr.l1("a"))
    q = q.withColumn("d", F.abs(F.col("p") - F.coalesce(w.lag("p"), F.lit(0.0))))
    return q.groupBy("date").agg(F.sum(F.col("p") * F.coalesce("ret", F.lit(0.0))).alias("gross"), (0.5 * F.sum("d")).alias("turnover"))


_REB = f"""WITH {SIG}, dd AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS day FROM (SELECT DISTINCT date FROM g)),
    x AS (SELECT g.*, dd.day, dd.day // 5 AS bucket FROM g JOIN dd USING (date) WHERE signal IS NOT NULL),
    f AS (SELECT ticker, bucket, row_number() OVER (PARTITION BY date ORDER BY signal DESC, ticker) AS k, count(*) OVER (PARTITION BY date) AS n FROM x WHERE day % 5 = 0),
    c AS (SELECT ticker, bucket FROM f WHERE k <= greatest(floor(n * 0.2), 1)),
    kept AS (SELECT c.bucket, count(*) AS held, count(o.ticker) AS stayed FROM c LEFT JOIN c o ON o.ticker = c.ticker AND o.bucket = c.bucket - 1 GROUP BY 1),
    gone AS (SELECT bucket + 1 AS bucket, count(*) AS had FROM c GROUP BY 1),
    ch AS (SELECT kept.bucket, held, (held - stayed) + coalesce(had - stayed, 0) AS changed FROM kept LEFT JOIN gone USING (bucket)),
    y AS (SELECT x.bucket, x.day, x.date, count(*) AS n, avg(x.fwd) AS gross FROM x JOIN c ON c.ticker = x.ticker AND c.bucket = x.bucket WHERE x.fwd IS NOT NULL GROUP BY 1, 2, 3),
    z AS (SELECT y.date, y.n, y.gross, CASE WHEN day % 5 = 0 THEN changed / held * 0.5 ELSE 0.0 END AS turnover FROM y JOIN ch USING (bucket))"""


@query("bt5_rebalanced_long", _REB + " SELECT date, n, round(gross, 6) + 0.0 AS gross, round(CAST(turnover AS DOUBLE), 6) + 0.0 AS turnover, round(CAST(gross - turnover * 0.001 AS DOUBLE), 6) + 0.0 AS net FROM z")
def _(p):
    return tr.rebalanced(signals(p), "signal", "fwd")


@query("bt9_vol_target", f"WITH {_DAILY}, v AS (SELECT date, net, CASE WHEN count(net) OVER w >= 63 THEN stddev_pop(net) OVER w * sqrt(252) END AS rv FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 63 PRECEDING AND 1 PRECEDING)), l AS (SELECT *, coalesce(CASE WHEN rv IS NOT NULL THEN least(greatest(0.15 / nullif(rv, 0), 0.2), 2.0) END, 1.0) AS leverage FROM v) SELECT date, round(CAST(leverage AS DOUBLE), 6) + 0.0 AS leverage, round(CAST(leverage * net AS DOUBLE), 6) + 0.0 AS levered FROM l")
def _(p):
    return tr.vol_target(daily(p)).select("date", "leverage", "levered")


@query("bt14_stop_out", f"WITH {_DAILY}, v AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM daily), dd AS (SELECT *, v / greatest(1.0, max(v) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS dd FROM v), b AS (SELECT *, max(CASE WHEN dd <= -0.01 THEN 1 ELSE 0 END) OVER (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS hit FROM dd) SELECT date, round(CAST(CASE WHEN coalesce(hit, 0) = 1 THEN 0.0 ELSE net END AS DOUBLE), 6) + 0.0 AS stopped FROM b")
def _(p):
    return tr.stop_out(daily(p), stop=0.01).select("date", "stopped")


@query("bt17_benchmark", f"WITH {R} SELECT date, round(avg(ret), 6) + 0.0 AS gross, count(ret) AS n FROM r GROUP BY date")
def _(p):
    return p.groupBy("date").agg(F.avg("ret").alias("gross"), F.count("ret").alias("n"))


@query("bt20_sweep", " UNION ALL ".join("SELECT * FROM (" + _REB.replace("0.2), 1)", f"{s}), 1)") + f" SELECT 'top{int(s * 100)}' AS strategy, count(*) AS n, round(avg(gross), 6) + 0.0 AS mean_gross, round(CAST(avg(turnover) AS DOUBLE), 6) + 0.0 AS mean_turnover FROM z)" for s in (0.1, 0.3)))
def _(p):
    s = signals(p)
    out = [tr.rebalanced(s, "signal", "fwd", share=x).withColumn("strategy", F.lit(f"top{int(x * 100)}")) for x in (0.1, 0.3)]
    return out[0].unionByName(out[1]).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"), F.avg("gross").alias("mean_gross"), F.avg("turnover").alias("mean_turnover"))


_EQ = f"WITH {_DAILY}, v AS (SELECT *, product(1 + net) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS value FROM daily), dd AS (SELECT *, value / greatest(1.0, max(value) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING)) - 1 AS drawdown FROM v)"


@query("mt1_performance", _EQ + ", a AS (SELECT count(net) AS n, arg_max(value, date) AS value, avg(net) AS m, stddev_samp(net) AS s, stddev_samp(CASE WHEN net < 0 THEN net END) AS ds, min(drawdown) AS max_drawdown, avg(CASE WHEN drawdown < 0 THEN drawdown END) AS avg_drawdown, avg(CASE WHEN net > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, sum(greatest(net, 0)) / -sum(least(net, 0)) AS profit_factor FROM dd), c AS (SELECT *, pow(value, 252.0 / n) - 1 AS cagr, s * sqrt(252) AS ann_vol FROM a) SELECT n, round(cagr, 6) + 0.0 AS cagr, round(ann_vol, 6) + 0.0 AS ann_vol, round(m / s * sqrt(252), 6) + 0.0 AS sharpe, round(m / ds * sqrt(252), 6) + 0.0 AS sortino, round(max_drawdown, 6) + 0.0 AS max_drawdown, round(avg_drawdown, 6) + 0.0 AS avg_drawdown, round(CAST(win_rate AS DOUBLE), 6) + 0.0 AS win_rate, round(profit_factor, 6) + 0.0 AS profit_factor, round(cagr / (ann_vol + 1e-10), 6) + 0.0 AS geo_sharpe, round(cagr / abs(max_drawdown), 6) + 0.0 AS calmar FROM c")
def _(p):
    return tr.performance(daily(p)).drop("value")


@query("mt3_rolling_sharpe", _EQ + ", s AS (SELECT *, CASE WHEN count(net) OVER w >= 63 THEN avg(net) OVER w / nullif(stddev_samp(net) OVER w, 0) * sqrt(252) END AS sharpe FROM dd WINDOW w AS (ORDER BY date ROWS 62 PRECEDING)) SELECT date, round(drawdown, 6) + 0.0 AS drawdown, round(sharpe, 6) + 0.0 AS sharpe FROM s")
def _(p):
    over = Window.partitionBy(F.lit(1)).orderBy("date")
    return tr.equity(daily(p)).select("date", "drawdown", (ratio(w.mean("net", 63, w=over), w.std("net", 63, w=over)) * F.sqrt(F.lit(252.0))).alias("sharpe"))


@query("mt5_yearly", f"WITH {_DAILY} SELECT CAST(date_trunc('year', date) AS DATE) AS period, round(product(1 + net) - 1, 6) + 0.0 AS ret, count(net) AS n FROM daily GROUP BY 1")
def _(p):
    return tr.compounded(daily(p), unit="year")


@query("mt7_underwater", _EQ + ", u AS (SELECT *, sum(CASE WHEN drawdown < 0 THEN 0 ELSE 1 END) OVER (ORDER BY date ROWS UNBOUNDED PRECEDING) AS spell FROM dd) SELECT min(date) AS start, max(date) AS \"end\", count(*) AS days, round(min(drawdown), 6) + 0.0 AS depth FROM u WHERE drawdown < 0 GROUP BY spell")
def _(p):
    return tr.underwater(daily(p))
