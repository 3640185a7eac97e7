"""Queries of the wide feature blocks, each with its DuckDB SQL in the same stages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import blocks as bl
from strandline.operators import books as bk
from strandline.operators import features as fe
from strandline.operators import models as md
from strandline.operators import scans as sc
from strandline.plans.registry import R, TICKER, lagged, query, rank, roll, staged, win
from strandline.plans.research import K

UP = {"_u": "CASE WHEN ret IS NOT NULL THEN greatest(ret, 0.0) END", "_ab": "abs(ret)", "_p": "CASE WHEN ret IS NOT NULL THEN CASE WHEN ret > 0 THEN 1.0 ELSE 0.0 END END"}
HL, PREV = "(high - low)", lagged("close")
TRUE_RANGE = f"greatest(high - low, abs(high - {PREV}), abs(low - {PREV}))"


def s(x: str, n: int) -> str:
    return f"({roll('sum', x, n)})"


def a(x: str, n: int) -> str:
    return f"({roll('avg', x, n)})"


def d(x: str, n: int) -> str:
    return f"({roll('stddev_samp', x, n)})"


def hi(x: str, n: int) -> str:
    return f"({roll('max', x, n)})"


def lo(x: str, n: int) -> str:
    return f"({roll('min', x, n)})"


def div(x: str, y: str) -> str:
    return f"(({x}) / nullif({y}, 0))"


def clip(x: str, k: float = 3.0) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, -{k}), {k}) END"


def rsi(n: int) -> str:
    return f"({s('_u', n)} / ({s('_ab', n)} + 1e-10))"


def channel(n: int) -> str:
    return div(f"close - {lo('low', n)}", f"({hi('high', n)} - {lo('low', n)})")


def dist(n: int) -> str:
    return div("close", a("close", n)) + " - 1"


def band(n: int) -> str:
    return div(f"close - {a('close', n)}", f"(2 * {d('close', n)})")


def corr(x: str, y: str, n: int) -> str:
    """x and y are null together or made so before."""
    w = win(n)
    return f"CASE WHEN count({x}) OVER {w} >= {n} THEN covar_pop({x}, {y}) OVER {w} / nullif(stddev_pop({x}) OVER {w} * stddev_pop({y}) OVER {w}, 0) END"


def z_of(columns: str) -> tuple[dict[str, str], dict[str, str]]:
    raw = {f"{c}_r": f"(round({c}, 9) - avg(round({c}, 9)) OVER (PARTITION BY date)) / nullif(stddev_samp(round({c}, 9)) OVER (PARTITION BY date), 0)" for c in columns.split()}
    return raw, {f"{c}_z": clip(f"{c}_r") for c in columns.split()}


SHADOWS = {"bar_range": div("high - low", "close"), "upper_shadow": div("high - greatest(open, close)", HL), "lower_shadow": div("least(open, close) - low", HL), "body": div("abs(close - open)", HL)}

_LONG = [
    {**UP, "_vol": "CASE WHEN ret IS NOT NULL THEN volume END"},
    {f"_s{n}": s("ret", n) for n in (5, 10, 21, 63)} | {f"vol_{n}": d("ret", n) for n in (10, 21, 63)} | {f"dist_{n}": dist(n) for n in (10, 21, 50)} | SHADOWS
    | {"persistence": a("_p", 21), "volume_ratio": div("volume", a("volume", 20)), "volume_trend": div(a("volume", 5), a("volume", 21)), "ret_volume_corr": corr("ret", "_vol", 21), "rsi_14": rsi(14), "band_21": band(21)},
    {f"mom_{n}": lagged(f"_s{n}") for n in (5, 10, 21, 63)} | {"mom_adjusted": div("_s21", "vol_21"), "vol_ratio": div("vol_10", "vol_63"), "vol_of_vol": d("vol_21", 21)},
]


@query("fe18_long_side", staged(*_LONG, *z_of(bl.LONG), keep=" ".join(f"{c}_z" for c in bl.LONG.split()), digits=5), digits=5)
def _(p):
    return fe.add(p, bl.long_side()).select(*K, *(f"{c}_z" for c in bl.LONG.split()))


_SHORT = [
    {**UP, "_up": "CASE WHEN ret > 0 THEN volume ELSE 0.0 END", "close_place": f"coalesce({div('2 * close - high - low', HL)}, 0)", "_gap": div("open", PREV) + " - 1", "_obv": f"coalesce(sign(close - {PREV}), 0) * volume", "_roc": div("close", lagged("close", 10)) + " - 1", "_vroc": div("volume", lagged("volume", 10)) + " - 1"},
    {f"ext_{n}": dist(n) for n in (21, 50, 100)} | {f"_v{n}": d("ret", n) for n in (5, 21, 252)} | {f"_s{n}": s("ret", n) for n in (5, 21)}
    | {"from_high_252": div("close", hi("close", 252)) + " - 1", "channel_21": channel(21), "rsi_14": rsi(14), "_band": band(21), "drawdown": f"close / max(close) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) - 1", "_ad": "close_place * volume"},
    {"above_band": "CASE WHEN _band IS NOT NULL THEN greatest(_band - 1, 0) ELSE 0 END", "deceleration": "_s5 - _s21 * (CAST(5 AS DOUBLE) / 21)", "up_volume": div(s("_up", 21), s("volume", 21)), "obv_change": div(s("_obv", 21), s("volume", 21)), "roc_divergence": "_roc - _vroc", "vol_ratio_252": div("_v21", "_v252"),
     "vol_expansion": div("_v5", "_v21"), "gap_risk": d("_gap", 21), "reversal": "-_s5", "ad_change": div(s("_ad", 21), s("volume", 21)), "peak_vol_ratio": div("_v21", hi("_v21", 63))},
]


@query("fe19_short_side", staged(*_SHORT, *z_of(bl.SHORT), keep=" ".join(f"{c}_z" for c in bl.SHORT.split()), digits=5), digits=5)
def _(p):
    return fe.add(p, bl.short_side()).select(*K, *(f"{c}_z" for c in bl.SHORT.split()))


@query("fe20_momentum_block", staged(
    {**UP, **{f"ret_{n}": s("ret", n) for n in (5, 10, 21, 42, 63)}, "_y": s("ret", 252), "_v63": d("ret", 63), "_m63": a("ret", 63), "_sg": "sign(ret)"},
    {"spread_5_21": "ret_5 - ret_21", "spread_21_63": "ret_21 - ret_63", "twelve_less_one": "_y - ret_21", "acceleration": f"ret_21 - {lagged('ret_21', 21)}", "up_21": a("_p", 21), "up_63": a("_p", 63), "_t": div("ret_63", "_v63 * sqrt(63)"), "quality": div("ret_21", s("_ab", 21)), "info_ratio": div("_m63", "_v63"), "_turned": f"CASE WHEN rn = 1 OR _sg IS DISTINCT FROM {lagged('_sg')} THEN rn END"},
    {"tsmom": clip("_t"), "_began": f"max(_turned) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)"}, {"streak": "_sg * (rn - _began + 1)"}, keep=bl.MOMENTUM))
def _(p):
    return fe.add(p, bl.research_momentum()).select(*K, *bl.MOMENTUM.split())


@query("fe21_volatility_block", staged(
    {**{f"rv_{n}": f"{d('ret', n)} * sqrt(252)" for n in (5, 10, 21, 63)}, "_tr": TRUE_RANGE},
    {"_l": f"list(rv_21) FILTER (rv_21 IS NOT NULL) OVER {win(252)}", "_n": f"count(rv_21) OVER {win(252)}", "rv_5_21": div("rv_5", "rv_21"), "rv_21_63": div("rv_21", "rv_63"), "rv_change": f"rv_21 - {lagged('rv_21', 5)}", "rv_z_252": div(f"rv_21 - {a('rv_21', 252)}", d("rv_21", 252)), "vol_of_vol": d("rv_21", 21), "surprise": div("abs(ret) * sqrt(252)", lagged("rv_21")) + " - 1", **{f"atr_{n}": div(a("_tr", n), "close") for n in (5, 14, 21)}},
    {"rv_rank_252": "CASE WHEN _n >= 252 THEN len(list_filter(_l, lambda v: v < rv_21)) / (_n - 1.0) END"}, keep=bl.VOLATILITY))
def _(p):
    return fe.add(p, bl.research_volatility()).select(*K, *bl.VOLATILITY.split())


@query("fe22_reversion_block", staged(
    UP, {**{f"z_{n}": div(f"close - {a('close', n)}", d("close", n)) for n in (10, 21, 42, 63)}, **{f"rsi_{n}": f"2 * {rsi(n)} - 1" for n in (7, 14, 21)}, "band_place": band(20), "band_width": div(f"4 * {d('close', 20)}", a("close", 20)), "reversal_1": "-ret", "reversal_5": f"-{s('ret', 5)}", "reversal_10": f"-{s('ret', 10)}", "from_high_21": div("close", hi("close", 21)) + " - 1", "from_high_63": div("close", hi("close", 63)) + " - 1", "_top": hi("close", 21), "ret_deviation": div(f"ret - {a('ret', 252)}", d("ret", 252)), "stoch_k": f"100 * {channel(14)}"},
    {"_at": "CASE WHEN _top IS NOT NULL THEN CASE WHEN close >= _top THEN 1.0 ELSE 0.0 END END", "stoch_d": a("stoch_k", 3)}, {"at_high": a("_at", 63)}, keep=bl.REVERSION, digits=5), digits=5)
def _(p):
    return fe.add(p, bl.research_reversion()).select(*K, *bl.REVERSION.split())


@query("fe23_technical_block", staged(
    {"cross_5_21": div(a("close", 5), a("close", 21)) + " - 1", "cross_10_50": div(a("close", 10), a("close", 50)) + " - 1", "cross_50_200": div(a("close", 50), a("close", 200)) + " - 1", "volume_ratio": div("volume", a("volume", 20)), "volume_trend": div(a("volume", 5), a("volume", 20)), "_obv": f"coalesce(sign(close - {PREV}), 0) * volume", "_mv": a("volume", 20), "_sv": d("volume", 20), "donchian_20": channel(20), "donchian_55": channel(55), "gap": div("open", PREV) + " - 1", "_tp": "(high + low + close) / 3"},
    {"obv_flow": div(s("_obv", 20), s("volume", 20)), "spike": "CASE WHEN _sv IS NOT NULL THEN CASE WHEN volume > _mv + 2 * _sv THEN 1.0 ELSE 0.0 END END", "gap_mean": a("gap", 20), "_flow": "_tp * volume", "_dtp": f"_tp - {lagged('_tp')}"},
    {"_pos": "CASE WHEN _dtp > 0 THEN _flow ELSE 0.0 END", "_neg": "CASE WHEN _dtp < 0 THEN _flow ELSE 0.0 END"}, {"mfi_14": f"100 * {div(s('_pos', 14), s('_pos', 14) + ' + ' + s('_neg', 14))}"}, keep=bl.TECHNICAL))
def _(p):
    return fe.add(p, bl.research_technical()).select(*K, *bl.TECHNICAL.split())


@query("fe24_arbitrage_block", staged(
    {"_s21": s("ret", 21)}, {"ret_rank": rank("ret"), "sum_rank": rank("_s21"), "_x": "CASE WHEN ret IS NOT NULL THEN mkt END", "to_median": "ret - quantile_cont(ret, 0.5) OVER (PARTITION BY date)", "_far": "CASE WHEN ret IS NOT NULL AND disp IS NOT NULL THEN CASE WHEN abs(ret - mkt) > 2 * disp THEN 1.0 ELSE 0.0 END END"},
    {f"beta_{n}": f"CASE WHEN count(_x) OVER {win(n)} >= {n} THEN covar_samp(ret, _x) OVER {win(n)} / nullif(var_samp(_x) OVER {win(n)}, 0) END" for n in (21, 63)} | {"market_corr": corr("ret", "_x", 63), "extremes": "avg(_far) OVER (PARTITION BY date)"},
    {"idio": "ret - beta_63 * mkt"}, {"idio_21": s("idio", 21)}, keep=bl.ARBITRAGE, base="j", digits=5,
    ctes=R + ", m AS (SELECT date, avg(ret) AS mkt, stddev_samp(ret) AS disp FROM r GROUP BY date), mz AS (SELECT *, CASE WHEN count(disp) OVER w >= 63 THEN (disp - avg(disp) OVER w) / nullif(stddev_samp(disp) OVER w, 0) END AS dispersion_z FROM m WINDOW w AS (ORDER BY date ROWS 62 PRECEDING)), j AS (SELECT r.*, mkt, disp, dispersion_z FROM r LEFT JOIN mz USING (date))"), digits=5)
def _(p):
    return bl.research_arbitrage(p).select(*K, *bl.ARBITRAGE.split())


@query("fe29_cumulative_reversion", staged(
    {**UP, "_c": f"sum(coalesce(lr, 0)) OVER ({TICKER} ROWS UNBOUNDED PRECEDING)", "_before": lagged("ret"), "gap_reversal": "1 - " + div("open", PREV), "_range": div("high - low", "close"), "_v20": d("ret", 20)},
    {"rsi_14": rsi(14), "reversal_5": f"-{s('ret', 5)}", "rv_ratio": div(d("ret", 5), d("ret", 20)), "stoch": div(f"_c - {lo('_c', 14)}", f"({hi('_c', 14)} - {lo('_c', 14)})"), "z_20": div(f"_c - {a('_c', 20)}", d("_c", 20)), "band_20": div(f"_c - {a('_c', 20)}", f"(2 * {d('_c', 20)})"), "from_high_60": f"_c - {hi('_c', 60)}", "from_low_60": f"_c - {lo('_c', 60)}", "_b": "CASE WHEN _before IS NOT NULL THEN ret END", "contraction": div(a("_range", 5), a("_range", 20))},
    {"speed": f"-({corr('_b', '_before', 20)})", "adjusted_z": "z_20 / (1 + _v20)"}, keep=bl.CUMULATIVE, digits=5), digits=5)
def _(p):
    return fe.add(p, bl.cumulative_reversion()).select(*K, *bl.CUMULATIVE.split())


@query("fe34_clean_features", staged(
    {**UP, "_tr": TRUE_RANGE}, {**{f"mom_{n}": div("close", lagged("close", n)) + " - 1" for n in (5, 10, 20, 60)}, "rsi_14": f"100 * {rsi(14)}", "volume_ratio": div("volume", a("volume", 20)), "dev_20": dist(20), "dev_50": dist(50), "trend": div(s("ret", 20), f"({d('ret', 20)} * sqrt(20))"), "atr_ratio": div(a("_tr", 14), "close")}, keep=bl.CLEAN))
def _(p):
    return fe.add(p, bl.clean_features()).select(*K, *bl.CLEAN.split())


@query("fe15_interactions", staged(
    UP, {"_m": s("ret", 21), "_r": f"-{s('ret', 5)}", "_v": d("ret", 21), "_vr": div("volume", a("volume", 20)), "_t": div(s("ret", 20), f"({d('ret', 20)} * sqrt(20))"), "_upshare": a("_p", 20)}, {"_vk": rank("_v")},
    {"mom_x_calm": "_m * (1 - _vk)", "reversal_x_vol": "_r * _vk", "mom_x_volume": "_m * _vr", "trend_x_consistency": "_t * _upshare"}, keep="mom_x_calm reversal_x_vol mom_x_volume trend_x_consistency"))
def _(p):
    return fe.add(p, bl.interactions()).select(*K, "mom_x_calm", "reversal_x_vol", "mom_x_volume", "trend_x_consistency")


def _smoothed(x: str, base: str, alpha: str, name: str) -> str:
    """CTEs that give ``base`` a column ``name``: x smoothed along each ticker from its first value."""
    return (
        f", {name}_q AS (SELECT ticker, list({x} ORDER BY date) FILTER ({x} IS NOT NULL) AS a FROM {base} GROUP BY ticker), {name}_c AS (SELECT *, count({x}) OVER ({TICKER} ROWS UNBOUNDED PRECEDING) AS n FROM {base}), "
        f"{name}_t AS (SELECT c.* EXCLUDE (n), CASE WHEN n > 0 THEN list_reduce(a[1:n], lambda u, v: u * (1 - {alpha}) + v * {alpha}) END AS {name} FROM {name}_c c LEFT JOIN {name}_q q USING (ticker))"
    )


@query("fe23_macd", f"WITH {R}{_smoothed('close', 'r', '2.0 / 13', 'ema_12')}{_smoothed('close', 'ema_12_t', '2.0 / 27', 'ema_26')}, m AS (SELECT *, (ema_12 - ema_26) / close AS macd FROM ema_26_t){_smoothed('macd', 'm', '2.0 / 10', 'macd_signal')} SELECT ticker, date, round(ema_12, 4) + 0.0 AS ema_12, round(ema_26, 4) + 0.0 AS ema_26, round(macd, 4) + 0.0 AS macd, round(macd_signal, 4) + 0.0 AS macd_signal, round(macd - macd_signal, 4) + 0.0 AS macd_gap FROM macd_signal_t", digits=4)
def _(p):
    q = sc.ewm(sc.ewm(p.select(*K, "close"), "ema_12", "close", span=12), "ema_26", "close", span=26).withColumn("macd", (F.col("ema_12") - F.col("ema_26")) / F.col("close"))
    return sc.ewm(q, "macd_signal", "macd", span=9).select(*K, "ema_12", "ema_26", "macd", "macd_signal", (F.col("macd") - F.col("macd_signal")).alias("macd_gap"))


@query("fe26_rolling_factors", digits=4)
def _(p):
    return bl.rolling_factors(p)


@query("fe33_reproducible_features")
def _(p):
    """The panel's features, the Kalman trend and the filtered hidden regimes side by side."""
    level = sc.kalman_level(p.select(*K, F.ln("close").alias("lp")), "trend", "lp").select(*K, (F.col("trend") - F.col("lp")).alias("kalman_trend"))
    hidden = md.hmm_regimes(p).select(*K, "regime", *(F.col("probabilities")[i].alias(f"p_state_{i}") for i in range(3)))
    return bk.feature_panel(p).join(level, K, "left").join(hidden, K, "left")
