"""Feature blocks: dictionaries of named columns over a panel with ret, lr and OHLCV.

Blocks that need an earlier column (a z-score of a moving sum, say) list their columns in stages; ``add``
puts each stage into one projection, so a block costs one exchange and one sort by ticker.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clip, flag, ratio
from strandline.operators import windows as w
from strandline.operators.order_stats import Quantile, ShareBelow, with_order_stats

Stages = Sequence[Mapping[str, Column | Quantile | ShareBelow]]


def add(df: DataFrame, *blocks: Stages) -> DataFrame:
    """Add the columns of blocks, stage by stage; blocks of one stage share a projection.

    Order statistics wait until a column asks for them, so that all share one index, after the window expressions and on their exchange.
    """
    waiting: dict[str, Quantile | ShareBelow] = {}
    for i in range(max(map(len, blocks), default=0)):
        stage = {k: c for b in blocks if i < len(b) for k, c in b[i].items()}
        columns = {k: c for k, c in stage.items() if isinstance(c, Column)}
        asking = {k for k, c in columns.items() if waiting and set(re.findall(r"\w+", str(c))) & set(waiting)}
        if first := {k: c for k, c in columns.items() if k not in asking}:
            df = df.withColumns(first)
        if asking:
            df, waiting = with_order_stats(df.drop(*waiting), waiting), {}
            df = df.withColumns({k: columns[k] for k in asking})
        waiting |= {k: c for k, c in stage.items() if k not in columns}
    return with_order_stats(df.drop(*waiting), waiting) if waiting else df


def momentum(r: str = "ret") -> Stages:
    sums = {f"mom_{n}d": w.rsum(r, n) for n in (5, 10, 21, 63)}
    return [
        sums | {"mom_consistency": w.positive_share(r, 21)},
        {"mom_acceleration": F.col("mom_5d") - F.col("mom_21d"), "mom_reversal": -F.col("mom_5d"), "mom_zscore": ratio(F.col("mom_21d") - w.mean("mom_21d", 63), w.std("mom_21d", 63), 1e-10)},
    ]


def volatility(r: str = "ret") -> Stages:
    return [
        {f"vol_{n}d": w.std(r, n) for n in (5, 10, 21)},
        {"vol_ratio": ratio("vol_5d", "vol_21d", 1e-10), "vol_zscore": ratio(F.col("vol_21d") - w.mean("vol_21d", 63), w.std("vol_21d", 63), 1e-10), "_vol_q80": Quantile("vol_21d", 126, 0.8)},
        {"vol_regime": flag(F.col("vol_21d") > F.col("_vol_q80"))},
    ]


def mean_reversion(price: str = "close", r: str = "ret") -> Stages:
    p = F.ln(F.col(price))
    return [
        {"_lp": p, "rsi_21": w.up_ratio(r, 21)},
        {"ma_20_dev": F.col("_lp") - w.mean("_lp", 20), "ma_50_dev": F.col("_lp") - w.mean("_lp", 50), "bb_position": ratio(F.col("_lp") - w.mean("_lp", 20), 2 * w.std("_lp", 20), 1e-10)},
    ]


def regime(r: str = "ret", lookback: int = 63, history: int = 252) -> Stages:
    """Softmax over three volatility regimes placed at the rolling terciles; the largest exponent is taken off first, so that the
    sum is never 0 however narrow the terciles lie."""
    lo, hi, v = F.col("_q33"), F.col("_q67"), F.col("_vol")
    spread = hi - lo + 1e-10
    centre = (0.5 * lo, (lo + hi) / 2, 1.5 * hi)
    power = [-F.pow((v - c) / spread, 2.0) for c in centre]
    score = [F.exp(e - F.greatest(*power)) for e in power]
    total = score[0] + score[1] + score[2]
    flat = hi <= lo
    p = [F.when(flat, F.lit(x)).otherwise(ratio(s, total)) for s, x in zip(score, (0.33, 0.34, 0.33))]
    return [
        {"_vol": w.std(r, lookback)},
        {"_q33": Quantile("_vol", history, 0.33), "_q67": Quantile("_vol", history, 0.67)},
        {"p_low": p[0], "p_mid": p[1], "p_high": p[2]},
        {
            "regime_state": F.when(v.isNull() | lo.isNull(), 0).when(v <= lo, 0).when(v >= hi, 2).otherwise(1),
            "regime_confidence": F.greatest("p_low", "p_mid", "p_high"),
            "regime_entropy": F.coalesce(-sum((F.col(c) * F.ln(F.col(c) + 1e-10) for c in ("p_low", "p_mid", "p_high")), F.lit(0.0)), F.lit(0.0)),
            "regime_shift": sum((F.abs(w.diff(c)) for c in ("p_low", "p_mid", "p_high")), F.lit(0.0)),
        },
    ]


def regime_interactions() -> Stages:
    duration = F.least(F.col("regime_duration"), F.lit(20)) / F.lit(20.0)
    return [
        {
            "mom_x_confidence": F.col("mom_21d") * F.col("regime_confidence"), "reversal_x_high": F.col("mom_reversal") * F.col("p_high"),
            "mom_x_duration": F.col("mom_21d") * duration, "vol_x_entropy": F.col("vol_21d") * F.col("regime_entropy"),
        }
    ]


def cross_section(columns: Sequence[str] = ("mom_5d", "mom_21d", "vol_21d", "mom_zscore")) -> Stages:
    return [{f"{c}_rank": w.pct_rank(c) for c in columns}]


def baseline(r: str = "ret") -> Stages:
    return [{"_v20": w.std(r, 20), "mom_20": w.rsum(r, 20), "vol_20": w.std(r, 20), "_m5": w.rsum(r, 5)}, {"mom5_over_vol20": ratio("_m5", "_v20")}]


def trend(r: str = "ret", n: int = 20, lag: int = 1) -> Stages:
    """Strength, acceleration and consistency of a trend, lagged."""
    strength = ratio(w.rsum(r, n), w.std(r, n) * math.sqrt(n))
    return [
        {"_strength": strength, "_consistency": w.positive_share(r, n)},
        {"_acceleration": w.diff("_strength", 5)},
        {"trend_strength": w.lag("_strength", lag), "trend_acceleration": w.lag("_acceleration", lag), "trend_consistency": w.lag("_consistency", lag)},
    ]


def range_volatility(annual: int = 252) -> Stages:
    """Parkinson and Garman-Klass estimators and average true range."""
    hl, co = F.ln(ratio("high", "low")), F.ln(ratio("close", "open"))
    before = w.lag("close")
    true_range = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    return [
        {"_hl2": F.pow(hl, 2.0), "_gk": 0.5 * F.pow(hl, 2.0) - (2 * math.log(2) - 1) * F.pow(co, 2.0), "true_range": true_range},
        {"parkinson_21": F.sqrt(w.mean("_hl2", 21) / (4 * math.log(2)) * annual), "garman_klass_21": F.sqrt(F.greatest(w.mean("_gk", 21), F.lit(0.0)) * annual), "atr_14": w.mean("true_range", 14)},
        {"atr_ratio": ratio("atr_14", "close")},
    ]


def volume_features() -> Stages:
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    clv = ratio(2 * F.col("close") - F.col("high") - F.col("low"), F.col("high") - F.col("low"))
    return [
        {"_tp": typical, "volume_ratio": ratio("volume", w.mean("volume", 20)), "_obv": F.signum(w.diff("close")) * F.col("volume"), "_clv": F.coalesce(clv, F.lit(0.0)) * F.col("volume"), "ret_volume_corr": w.corr("ret", "volume", 21)},
        {"obv": F.sum("_obv").over(w.so_far()), "ad_line": F.sum("_clv").over(w.so_far()), "_flow": F.col("_tp") * F.col("volume"), "_up": w.diff("_tp")},
        {"_pos": F.when(F.col("_up") > 0, F.col("_flow")).otherwise(0.0), "_neg": F.when(F.col("_up") < 0, F.col("_flow")).otherwise(0.0)},
        {"mfi_14": 100 * ratio(w.rsum("_pos", 14), w.rsum("_pos", 14) + w.rsum("_neg", 14))},
    ]


def technical() -> Stages:
    """Moving-average crosses, Donchian position, stochastic oscillator, gaps."""
    return [
        {
            "sma_cross_5_21": ratio(w.mean("close", 5), w.mean("close", 21)) - 1, "sma_cross_21_50": ratio(w.mean("close", 21), w.mean("close", 50)) - 1,
            "donchian_20": ratio(F.col("close") - w.rmin("low", 20), w.rmax("high", 20) - w.rmin("low", 20)), "stoch_k": 100 * ratio(F.col("close") - w.rmin("low", 14), w.rmax("high", 14) - w.rmin("low", 14)),
            "gap": ratio("open", w.lag("close")) - 1, "dist_from_high_55": ratio("close", w.rmax("high", 55)) - 1,
        },
        {"stoch_d": w.mean("stoch_k", 3)},
    ]


def rsi(kind: str = "sum", r: str = "ret", n: int = 14) -> Column:
    """``sum``: 0 to 1 by sums; ``simple``: 0 to 100 by averages; ``centred``: -1 to 1."""
    base = w.up_ratio(r, n)
    return {"sum": base, "simple": 100 * base, "centred": 2 * base - 1}[kind]


def shadows() -> Stages:
    """Range, shadows and body of a bar, as shares of its close or range."""
    span = F.col("high") - F.col("low")
    return [
        {
            "bar_range": ratio(span, "close"), "upper_shadow": ratio(F.col("high") - F.greatest("open", "close"), span),
            "lower_shadow": ratio(F.least("open", "close") - F.col("low"), span), "body": ratio(F.abs(F.col("close") - F.col("open")), span),
        }
    ]


def downside(r: str = "ret", n: int = 60, least: int = 20) -> Stages:
    """Deviation of the falling and of the rising rows, and clustering of squared returns."""
    down, up = F.when(F.col(r) < 0, F.col(r)), F.when(F.col(r) > 0, F.col(r))
    frame = w.last_rows(n)
    return [
        {
            "downside_vol": F.when(F.count(down).over(frame) >= least, F.stddev_samp(down).over(frame)), "upside_vol": F.when(F.count(up).over(frame) >= least, F.stddev_samp(up).over(frame)),
            "_r2": F.col(r) * F.col(r),
        },
        {"_r2_lag": w.lag("_r2")},
        {"vol_clustering": w.corr("_r2", "_r2_lag", 20)},
    ]


def kinds_of_momentum(n: int = 21, skip: int = 5) -> Stages:
    """By sums, by compounding, by price ratio, and compounding that leaves the last rows out."""
    return [{"mom_sum": w.rsum("ret", n), "mom_product": w.rolling_product("ret", n), "mom_pct": w.pct_change("close", n)}, {"mom_skip": w.lag("mom_product", skip)}]


def market(df: DataFrame, r: str = "ret") -> DataFrame:
    """One row per date: mean return, breadth, dispersion; then its trend and risk over time."""
    daily = df.groupBy("date").agg(F.avg(r).alias("mkt"), F.avg((F.col(r) > 0).cast("double")).alias("breadth"), F.stddev_samp(r).alias("dispersion"), F.count(r).alias("assets"))
    over = Window.partitionBy(F.lit(1)).orderBy("date")
    return daily.withColumns({"mkt_vol_20": w.std("mkt", 20, w=over), "mkt_trend_20": w.rsum("mkt", 20, w=over)})


def with_market(df: DataFrame, r: str = "ret") -> DataFrame:
    """Adds the market's columns to every ticker's rows."""
    return df.join(market(df, r), "date", "left")


def relative(r: str = "ret") -> Stages:
    """Beta to the market, idiosyncratic return, and correlation with the market (needs ``with_market``)."""
    return [{"beta_63": w.beta(r, "mkt", 63), "beta_21": w.beta(r, "mkt", 21), "corr_mkt_63": w.corr(r, "mkt", 63)}, {"idio_ret": F.col(r) - F.col("beta_63") * F.col("mkt"), "rel_to_median": F.col(r) - F.percentile(r, 0.5).over(w.section())}]


def volatility_class(n: int = 252, k: float = 0.5) -> Stages:
    """0, 1 or 2 as volatility lies below, within or above its rolling median by k deviations."""
    v = F.col("vol_21d")
    return [
        {"_med": Quantile("vol_21d", n, 0.5, 60), "_dev": w.std("vol_21d", n, 60)},
        {"vol_class": F.when(F.col("_med").isNull() | v.isNull(), 1).when(v < F.col("_med") - k * F.col("_dev"), 0).when(v > F.col("_med") + k * F.col("_dev"), 2).otherwise(1)},
    ]


def standardise(columns: Sequence[str], how: str = "zscore", limit: float | None = 3.0, suffix: str = "_zscore") -> Stages:
    """Per date: z-score, centred rank, or robust score; cut at ``limit``."""
    if how == "zscore":
        return [{c + suffix: w.cs_zscore(c, limit=limit) for c in columns}]
    if how == "rank":
        return [{c + suffix: w.pct_rank(c) - 0.5 for c in columns}]
    first = {}
    for c in columns:
        m, d = w.robust_zscore(c)
        first |= {f"_{c}_dev": d}
    score = {c + suffix: ratio(f"_{c}_dev", 1.4826 * F.percentile(F.abs(F.col(f"_{c}_dev")), 0.5).over(w.section())) for c in columns}
    return [first, {k: clip(v, -limit, limit) if limit else v for k, v in score.items()}]


def composite(columns: Sequence[str], signs: Sequence[float] | None = None) -> Column:
    """Mean of the columns that aren't null."""
    parts = F.filter(F.array(*(F.col(c) * s for c, s in zip(columns, signs or [1.0] * len(columns)))), lambda x: x.isNotNull())
    return F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) / F.size(parts))


def market_regime(df: DataFrame, least: int = 60) -> DataFrame:
    """Per date: high volatility against its expanding median, uptrend, and both as one state of four."""
    m = with_order_stats(market(df), {"_median": Quantile("mkt_vol_20", None, 0.5, least)}, key=None)
    m = m.withColumns({"high_vol": flag(F.col("mkt_vol_20") > F.col("_median")), "uptrend": flag(F.col("mkt_trend_20") > 0)})
    return m.withColumn("state", 2 * F.col("uptrend") + F.col("high_vol")).drop("_median")
