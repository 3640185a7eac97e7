"""The wide feature blocks of long, short and research engineers, as stages of named columns (see ``features.add``)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clip, flag, ratio
from strandline.functions.shipping import ship
from strandline.operators import features as fe
from strandline.operators import windows as w
from strandline.operators.order_stats import ShareBelow


def scored(columns: str, limit: float = 3.0) -> dict[str, Column]:
    """Cross-sectional z-scores cut at ``limit``, named after their columns; values that differ beyond the ninth digit alone are equal."""
    return {f"{c}_z": w.cs_zscore(F.round(c, 9), limit=limit) for c in columns.split()}


def distance(n: int) -> Column:
    """Of the close from its moving average."""
    return ratio("close", w.mean("close", n)) - 1


def band(n: int) -> Column:
    """Place within two deviations of the moving average."""
    return ratio(F.col("close") - w.mean("close", n), 2 * w.std("close", n))


def channel(n: int) -> Column:
    return ratio(F.col("close") - w.rmin("low", n), w.rmax("high", n) - w.rmin("low", n))


LONG = "mom_5 mom_10 mom_21 mom_63 mom_adjusted persistence vol_10 vol_21 vol_63 vol_ratio vol_of_vol bar_range upper_shadow lower_shadow body volume_ratio volume_trend ret_volume_corr dist_10 dist_21 dist_50 rsi_14 band_21"


def long_side() -> fe.Stages:
    """Momentum (sums up to the row before), volatility, bars, volume and mean reversion; z-scores of all of them last."""
    return [
        {f"_s{n}": w.rsum("ret", n) for n in (5, 10, 21, 63)} | {f"vol_{n}": w.std("ret", n) for n in (10, 21, 63)} | {f"dist_{n}": distance(n) for n in (10, 21, 50)} | fe.shadows()[0]
        | {"persistence": w.positive_share("ret", 21), "volume_ratio": ratio("volume", w.mean("volume", 20)), "volume_trend": ratio(w.mean("volume", 5), w.mean("volume", 21)), "ret_volume_corr": w.corr("ret", "volume", 21), "rsi_14": w.up_ratio("ret", 14), "band_21": band(21)},
        {f"mom_{n}": w.lag(f"_s{n}") for n in (5, 10, 21, 63)} | {"mom_adjusted": ratio("_s21", "vol_21"), "vol_ratio": ratio("vol_10", "vol_63"), "vol_of_vol": w.std("vol_21", 21)},
        scored(LONG),
    ]


SHORT = "ext_21 ext_50 ext_100 from_high_252 above_band channel_21 deceleration rsi_14 up_volume ad_change close_place obv_change roc_divergence vol_ratio_252 vol_expansion gap_risk drawdown peak_vol_ratio reversal"


def short_side() -> fe.Stages:
    """Overextension, exhaustion, distribution, volatility and squeeze risk; z-scores last."""
    place = F.coalesce(ratio(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low")), F.lit(0.0))
    up = F.when(F.col("ret") > 0, F.col("volume")).otherwise(0.0)
    return [
        {f"ext_{n}": distance(n) for n in (21, 50, 100)} | {f"_v{n}": w.std("ret", n) for n in (5, 21, 252)} | {f"_s{n}": w.rsum("ret", n) for n in (5, 21)}
        | {"from_high_252": ratio("close", w.rmax("close", 252)) - 1, "channel_21": channel(21), "rsi_14": w.up_ratio("ret", 14), "_band": band(21), "_up": up, "close_place": place, "_gap": ratio("open", w.lag("close")) - 1,
           "_obv": F.coalesce(F.signum(w.diff("close")), F.lit(0.0)) * F.col("volume"), "drawdown": ratio("close", F.max("close").over(w.so_far())) - 1, "_roc10": w.pct_change("close", 10), "_vroc10": w.pct_change("volume", 10)},
        {"above_band": F.greatest(F.col("_band") - 1, F.lit(0.0)), "deceleration": F.col("_s5") - F.col("_s21") * (5 / 21), "up_volume": ratio(w.rsum("_up", 21), w.rsum("volume", 21)), "_ad": F.col("close_place") * F.col("volume"),
         "obv_change": ratio(w.rsum("_obv", 21), w.rsum("volume", 21)), "roc_divergence": F.col("_roc10") - F.col("_vroc10"), "vol_ratio_252": ratio("_v21", "_v252"), "vol_expansion": ratio("_v5", "_v21"), "gap_risk": w.std("_gap", 21), "reversal": -F.col("_s5")},
        {"ad_change": ratio(w.rsum("_ad", 21), w.rsum("volume", 21)), "peak_vol_ratio": ratio("_v21", w.rmax("_v21", 63))},
        scored(SHORT),
    ]


MOMENTUM = "ret_5 ret_10 ret_21 ret_42 ret_63 spread_5_21 spread_21_63 twelve_less_one acceleration up_21 up_63 streak tsmom quality info_ratio"


def research_momentum() -> fe.Stages:
    turned = F.when((F.col("rn") == 1) | ~F.col("_sign").eqNullSafe(w.lag("_sign")), F.col("rn"))
    return [
        {f"ret_{n}": w.rsum("ret", n) for n in (5, 10, 21, 42, 63)} | {"_y": w.rsum("ret", 252), "_abs": F.abs("ret"), "_v63": w.std("ret", 63), "_m63": w.mean("ret", 63), "up_21": w.positive_share("ret", 21), "up_63": w.positive_share("ret", 63), "_sign": F.signum("ret")},
        {"spread_5_21": F.col("ret_5") - F.col("ret_21"), "spread_21_63": F.col("ret_21") - F.col("ret_63"), "twelve_less_one": F.col("_y") - F.col("ret_21"), "acceleration": w.diff("ret_21", 21), "tsmom": clip(ratio("ret_63", F.col("_v63") * F.sqrt(F.lit(63.0))), -3, 3),
         "quality": ratio("ret_21", w.rsum("_abs", 21)), "info_ratio": ratio("_m63", "_v63"), "_turned": turned},
        {"_began": F.max("_turned").over(w.so_far())},
        {"streak": F.col("_sign") * (F.col("rn") - F.col("_began") + 1)},
    ]


VOLATILITY = "rv_5 rv_10 rv_21 rv_63 rv_5_21 rv_21_63 rv_change rv_rank_252 rv_z_252 vol_of_vol surprise atr_5 atr_14 atr_21"


def research_volatility() -> fe.Stages:
    before = w.lag("close")
    year = F.sqrt(F.lit(252.0))
    return [
        {f"rv_{n}": w.std("ret", n) * year for n in (5, 10, 21, 63)} | {"_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))},
        {"rv_5_21": ratio("rv_5", "rv_21"), "rv_21_63": ratio("rv_21", "rv_63"), "rv_change": w.diff("rv_21", 5), "rv_rank_252": ShareBelow("rv_21", 252), "rv_z_252": w.zscore("rv_21", 252), "vol_of_vol": w.std("rv_21", 21), "surprise": ratio(F.abs("ret") * year, w.lag("rv_21")) - 1}
        | {f"atr_{n}": ratio(w.mean("_tr", n), "close") for n in (5, 14, 21)},
    ]


REVERSION = "z_10 z_21 z_42 z_63 rsi_7 rsi_14 rsi_21 band_place band_width reversal_1 reversal_5 reversal_10 from_high_21 from_high_63 at_high ret_deviation stoch_k stoch_d"


def research_reversion() -> fe.Stages:
    return [
        {f"z_{n}": w.zscore("close", n) for n in (10, 21, 42, 63)} | {f"rsi_{n}": 2 * w.up_ratio("ret", n) - 1 for n in (7, 14, 21)}
        | {"band_place": band(20), "band_width": ratio(4 * w.std("close", 20), w.mean("close", 20)), "reversal_1": -F.col("ret"), "reversal_5": -w.rsum("ret", 5), "reversal_10": -w.rsum("ret", 10), "from_high_21": ratio("close", w.rmax("close", 21)) - 1, "from_high_63": ratio("close", w.rmax("close", 63)) - 1,
           "_top": w.rmax("close", 21), "ret_deviation": w.zscore("ret", 252), "stoch_k": 100 * channel(14)},
        {"_at": F.when(F.col("_top").isNotNull(), flag(F.col("close") >= F.col("_top"))), "stoch_d": w.mean("stoch_k", 3)},
        {"at_high": w.mean("_at", 63)},
    ]


TECHNICAL = "cross_5_21 cross_10_50 cross_50_200 volume_ratio volume_trend obv_flow spike donchian_20 donchian_55 gap gap_mean mfi_14"


def research_technical() -> fe.Stages:
    cross = lambda a, b: ratio(w.mean("close", a), w.mean("close", b)) - 1
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    return [
        {"cross_5_21": cross(5, 21), "cross_10_50": cross(10, 50), "cross_50_200": cross(50, 200), "volume_ratio": ratio("volume", w.mean("volume", 20)), "volume_trend": ratio(w.mean("volume", 5), w.mean("volume", 20)), "_obv": F.coalesce(F.signum(w.diff("close")), F.lit(0.0)) * F.col("volume"),
         "_mv": w.mean("volume", 20), "_sv": w.std("volume", 20), "donchian_20": channel(20), "donchian_55": channel(55), "gap": ratio("open", w.lag("close")) - 1, "_tp": typical},
        {"obv_flow": ratio(w.rsum("_obv", 20), w.rsum("volume", 20)), "spike": F.when(F.col("_sv").isNotNull(), flag(F.col("volume") > F.col("_mv") + 2 * F.col("_sv"))), "gap_mean": w.mean("gap", 20), "_flow": F.col("_tp") * F.col("volume"), "_dtp": w.diff("_tp")},
        {"_pos": F.when(F.col("_dtp") > 0, F.col("_flow")).otherwise(0.0), "_neg": F.when(F.col("_dtp") < 0, F.col("_flow")).otherwise(0.0)},
        {"mfi_14": 100 * ratio(w.rsum("_pos", 14), w.rsum("_pos", 14) + w.rsum("_neg", 14))},
    ]


ARBITRAGE = "ret_rank sum_rank beta_63 beta_21 idio idio_21 to_median dispersion_z market_corr extremes"


def research_arbitrage(p: DataFrame) -> DataFrame:
    """Ranks, betas, what the market leaves unexplained, dispersion against its past, correlation and shares of extreme moves."""
    over = Window.partitionBy(F.lit(1)).orderBy("date")  # one row a date
    day = p.groupBy("date").agg(F.avg("ret").alias("mkt"), F.stddev_samp("ret").alias("_disp")).withColumn("dispersion_z", w.zscore("_disp", 63, w=over))
    q = p.withColumn("_s21", w.rsum("ret", 21)).join(day, "date", "left").withColumn("_far", F.when(F.col("ret").isNotNull() & F.col("_disp").isNotNull(), flag(F.abs(F.col("ret") - F.col("mkt")) > 2 * F.col("_disp"))))
    return fe.add(q, [
        {"ret_rank": w.pct_rank("ret"), "sum_rank": w.pct_rank("_s21"), "beta_63": w.beta("ret", "mkt", 63), "beta_21": w.beta("ret", "mkt", 21), "market_corr": w.corr("ret", "mkt", 63), "to_median": F.col("ret") - F.percentile("ret", 0.5).over(w.section()), "extremes": F.avg("_far").over(w.section())},
        {"idio": F.col("ret") - F.col("beta_63") * F.col("mkt")},
        {"idio_21": w.rsum("idio", 21)},
    ])


CUMULATIVE = "rsi_14 stoch z_20 band_20 from_high_60 from_low_60 reversal_5 speed gap_reversal adjusted_z contraction rv_ratio"


def cumulative_reversion() -> fe.Stages:
    """Mean reversion measured on the cumulated log return."""
    return [
        {"_c": F.sum(F.coalesce("lr", F.lit(0.0))).over(w.so_far()), "rsi_14": w.up_ratio("ret", 14), "reversal_5": -w.rsum("ret", 5), "_before": w.lag("ret"), "gap_reversal": 1 - ratio("open", w.lag("close")), "_range": ratio(F.col("high") - F.col("low"), "close"), "rv_ratio": ratio(w.std("ret", 5), w.std("ret", 20)), "_v20": w.std("ret", 20)},
        {"stoch": ratio(F.col("_c") - w.rmin("_c", 14), w.rmax("_c", 14) - w.rmin("_c", 14)), "z_20": w.zscore("_c", 20), "band_20": ratio(F.col("_c") - w.mean("_c", 20), 2 * w.std("_c", 20)), "from_high_60": F.col("_c") - w.rmax("_c", 60), "from_low_60": F.col("_c") - w.rmin("_c", 60),
         "speed": -w.corr("ret", "_before", 20), "contraction": ratio(w.mean("_range", 5), w.mean("_range", 20))},
        {"adjusted_z": ratio("z_20", 1 + F.col("_v20"))},
    ]


CLEAN = "mom_5 mom_10 mom_20 mom_60 rsi_14 volume_ratio atr_ratio dev_20 dev_50 trend"


def clean_features() -> fe.Stages:
    before = w.lag("close")
    return [
        {f"mom_{n}": w.pct_change("close", n) for n in (5, 10, 20, 60)} | {"rsi_14": 100 * w.up_ratio("ret", 14), "volume_ratio": ratio("volume", w.mean("volume", 20)), "_tr": F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before)), "dev_20": distance(20), "dev_50": distance(50), "trend": ratio(w.rsum("ret", 20), w.std("ret", 20) * F.sqrt(F.lit(20.0)))},
        {"atr_ratio": ratio(w.mean("_tr", 14), "close")},
    ]


def interactions() -> fe.Stages:
    """Products of momentum, volatility, volume and trend."""
    return [
        {"_m": w.rsum("ret", 21), "_r": -w.rsum("ret", 5), "_v": w.std("ret", 21), "_vr": ratio("volume", w.mean("volume", 20)), "_t": ratio(w.rsum("ret", 20), w.std("ret", 20) * F.sqrt(F.lit(20.0))), "_up": w.positive_share("ret", 20)},
        {"_vk": w.pct_rank("_v")},
        {"mom_x_calm": F.col("_m") * (1 - F.col("_vk")), "reversal_x_vol": F.col("_r") * F.col("_vk"), "mom_x_volume": F.col("_m") * F.col("_vr"), "trend_x_consistency": F.col("_t") * F.col("_up")},
    ]


def rolling_factors(df: DataFrame, x: str = "ret", components: int = 5, window: int = 252, every: int = 21) -> DataFrame:
    """(fit, date, component, explained, score) of principal factors fitted on the last ``window`` dates every ``every`` dates.

    Each fit's rows are one group on the executors: a date lies in window / every of them. A missing value counts as its ticker's mean;
    a component is signed so that its largest loading is positive. The score is of the fit's last date.
    """
    ship(df.sparkSession)
    days = df.where(F.col(x).isNotNull()).select("date").distinct().withColumn("_day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")))
    count = days.agg(F.max("_day").alias("_n"))
    # Fit f ends on day window + f * every.
    first, last = F.greatest(F.ceil((F.col("_day") - window) / every), F.lit(0)), F.least(F.floor((F.col("_day") - 1) / every), F.floor((F.col("_n") - window) / every))
    placed = days.join(F.broadcast(count)).where(F.col("_n") >= window).withColumn("_a", first.cast("int")).withColumn("_b", last.cast("int")).where("_a <= _b").select("date", F.explode(F.sequence("_a", "_b")).alias("fit"))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = g.pivot(index="date", columns="ticker", values="x").sort_index()
        z = m.to_numpy(float)
        dev = np.nanstd(z, 0)
        z = np.nan_to_num((z - np.nanmean(z, 0)) / np.where(dev > 0, dev, 1.0))
        _, s, v = np.linalg.svd(z, full_matrices=False)
        v = v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]
        k = min(components, len(v))
        return pd.DataFrame({"fit": int(g["fit"].iloc[0]), "date": m.index[-1], "component": range(k), "explained": (s**2 / (s**2).sum())[:k], "score": (v @ z[-1])[:k]})

    rows = df.where(F.col(x).isNotNull()).select("ticker", "date", F.col(x).alias("x")).join(placed, "date")
    return rows.groupBy("fit").applyInPandas(run, "fit int, date date, component int, explained double, score double")
