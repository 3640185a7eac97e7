"""Targets, signals, positions, set-based backtests and performance metrics.

Strategies are rows: a book is a table (strategy, ticker, date, position), so any number of strategies is
backtested by one plan. Conventions that differ between users (lag, turnover, deviation) are parameters.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clip, col, flag, normal_cdf, ratio
from strandline.operators import windows as w

DAYS = 252


# -- targets -----------------------------------------------------------------------------------------------


def forward_return(h: int, kind: str = "sum", r: str = "ret", price: str = "close") -> Column:
    if kind == "price":
        return ratio(w.lag(price, -h), price) - 1
    total = w.forward_sum(r, h)
    return total if kind == "sum" else total / h


def rank_target(x: str | Column, how: str = "pct") -> Column:
    if how == "pct":
        return w.pct_rank(x)
    return w.cs_zscore(x) if how == "zscore" else 2 * w.pct_rank(x) - 1


def sign_target(x: str | Column, threshold: float | None = None) -> Column:
    """Binary: 1.0 if positive, null as 0.0; with a threshold -1, 0 or 1."""
    x = col(x)
    return flag(x > 0) if threshold is None else F.when(x > threshold, 1.0).when(x < -threshold, -1.0).otherwise(0.0)


def ternary_by_rank(rank: str | Column, high: float = 0.6, low: float = 0.4) -> Column:
    rank = col(rank)
    return F.when(rank >= high, 1).when(rank <= low, -1).otherwise(0)


def three_classes(x: str | Column, threshold: float = 0.01) -> Column:
    """0 down, 1 hold (null too), 2 up."""
    x = col(x)
    return F.when(x > threshold, 2).when(x < -threshold, 0).otherwise(1)


def probability_target(z: str | Column) -> Column:
    return normal_cdf(z)


# -- signals -------------------------------------------------------------------------------------------------


def concentration(x: str = "signal", by: str = "date") -> list[Column]:
    """Aggregates per date: Herfindahl index of |x|; top shares need ``top_share``."""
    total = F.sum(F.abs(x))
    return [F.coalesce(F.try_divide(F.sum(F.pow(F.abs(x), 2.0)), total * total), F.lit(0.0)).alias("hhi")]


def top_share(df: DataFrame, x: str, ks: Sequence[int] = (5, 10), by: str = "date") -> DataFrame:
    """Per date the share of |x| that the largest k hold (0 where all are 0)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.abs(x).desc_nulls_last(), "ticker"))
    ranked = df.withColumn("_k", rank)
    return ranked.groupBy(by).agg(*concentration(x), *(F.coalesce(F.try_divide(F.sum(F.when(F.col("_k") <= k, F.abs(x))), F.sum(F.abs(x))), F.lit(0.0)).alias(f"top{k}") for k in ks))


def safe_corr(x: str | Column, y: str | Column) -> Column:
    """Aggregate: Pearson correlation of the rows that have both; null where either is constant."""
    both = col(x).isNotNull() & col(y).isNotNull()
    a, b = F.when(both, col(x)), F.when(both, col(y))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def information_coefficient(df: DataFrame, x: str, y: str, rank: bool = True, least: int = 5, by: Sequence[str] = ("date",)) -> DataFrame:
    """Per date (or other keys) the correlation of x and y over rows that have both; ``rank`` for Spearman's."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    if rank:
        both = both.withColumns({"_x": w.pct_rank(x, list(by)), "_y": w.pct_rank(y, list(by))})
    a, b = ("_x", "_y") if rank else (x, y)
    return both.groupBy(*by).agg(F.when(F.count(F.lit(1)) > least, safe_corr(a, b)).alias("ic"), F.count(F.lit(1)).alias("n"))


def information_ratio(ic: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean, deviation, their ratio, t and share of hits; a correlation of 0 but for rounding is no hit."""
    s = F.stddev_samp("ic")
    return ic.groupBy(*by).agg(
        F.avg("ic").alias("mean_ic"), s.alias("std_ic"), F.try_divide(F.avg("ic"), s).alias("ir"), F.avg((F.round("ic", 9) > 0).cast("double")).alias("hit_rate"), F.try_divide(F.avg("ic"), s / F.sqrt(F.count("ic"))).alias("t_stat"), F.count("ic").alias("n")
    )


def lagged_ic(df: DataFrame, x: str, r: str, lags: Sequence[int]) -> DataFrame:
    """Mean daily Spearman correlation of x with the return k rows ahead, for each k."""
    ahead = df.select("ticker", "date", x, *(F.lead(r, k).over(w.series()).alias(f"l{k}") for k in lags))
    tall = ahead.select("ticker", "date", x, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"l{k}").alias("y")) for k in lags))).alias("e")).select("ticker", "date", x, "e.lag", "e.y")
    return information_ratio(information_coefficient(tall, x, "y", by=("lag", "date")), ("lag",))


def hit_ratio(hit: str | Column, n: int = 63, least: int = 20, default: float = 1 / 3) -> Column:
    """Mean of earlier hits, the row itself left out; ``default`` with too few."""
    past = w.series().rowsBetween(-n, -1)
    return F.when(F.count(col(hit)).over(past) >= least, F.avg(col(hit)).over(past)).otherwise(F.lit(default))


def decay_weight(date: str | Column, newest: str | Column, halflife: float) -> Column:
    return F.exp(-F.ln(F.lit(2.0)) * F.datediff(col(newest), col(date)) / F.lit(float(halflife)))


# -- positions -----------------------------------------------------------------------------------------------


def l1(x: str | Column, leverage: float = 1.0, cap: float | None = None, by: str | list[str] = "date") -> Column:
    """Weights that sum to ``leverage`` in absolute value, cut at ``cap`` without scaling again."""
    x = col(x)
    out = F.coalesce(F.try_divide(x * leverage, F.sum(F.abs(x)).over(w.section(by))), F.lit(0.0))
    return clip(out, -cap, cap) if cap is not None else out


def equal_weight(signal: str, leverage: float = 1.0, cap: float | None = None) -> list[Mapping[str, Column]]:
    side = F.when(F.col("_rank") > 0.5, 1.0).when(F.col("_rank").isNotNull(), -1.0)
    return [{"_rank": w.pct_rank(signal)}, {"_side": side}, {"position": l1("_side", leverage, cap)}]


def proportional(signal: str, threshold: float = 0.0, leverage: float = 1.0, cap: float | None = None) -> list[Mapping[str, Column]]:
    return [{"_s": F.when(F.abs(signal) >= threshold, F.col(signal)).otherwise(0.0)}, {"_n": w.demean("_s")}, {"position": l1("_n", leverage, cap)}]


def inverse_vol(signal: str, vol: str, leverage: float = 1.0) -> list[Mapping[str, Column]]:
    v = F.coalesce(F.col(vol), F.percentile(vol, 0.5).over(w.section()))
    return [{"_v": v}, {"_p": F.signum(signal) * ratio(F.lit(1.0), "_v")}, {"position": l1("_p", leverage)}]


def top_bottom(signal: str, share: float = 0.2, long_only: bool = False) -> list[Mapping[str, Column]]:
    """Equal weights in the top (and minus in the bottom) share by rank."""
    long = flag(F.col("_rank") > 1 - share)
    short = flag(F.col("_rank") <= share)
    n_long, n_short = F.sum("_long").over(w.section()), F.sum("_short").over(w.section())
    up, down = F.coalesce(ratio("_long", n_long), F.lit(0.0)), F.coalesce(ratio("_short", n_short), F.lit(0.0))
    return [{"_rank": w.pct_rank(signal)}, {"_long": long, "_short": short}, {"position": up if long_only else 0.5 * up - 0.5 * down}]


def quantile_books(signal: str, high: float = 0.8, low: float = 0.2) -> list[Mapping[str, Column]]:
    """0.5 over the names at or above the high quantile, -0.5 over those at or below the low one."""
    s = F.col(signal)
    return [
        {"_hi": F.percentile(signal, high).over(w.section()), "_lo": F.percentile(signal, low).over(w.section())},
        {"_l": flag(s >= F.col("_hi")), "_s": flag(s <= F.col("_lo"))},
        {"position": 0.5 * F.coalesce(ratio("_l", F.sum("_l").over(w.section())), F.lit(0.0)) - 0.5 * F.coalesce(ratio("_s", F.sum("_s").over(w.section())), F.lit(0.0))},
    ]


def softmax(signal: str, temperature: float = 1.0) -> list[Mapping[str, Column]]:
    s = F.col(signal) / F.lit(float(temperature))
    return [{"_e": F.exp(s - F.max(s).over(w.section()))}, {"position": F.coalesce(ratio("_e", F.sum("_e").over(w.section())), F.lit(0.0))}]


def hold(df: DataFrame, f: int, position: str = "position", time: str = "day") -> DataFrame:
    """Positions of every f-th trading day, held until the next (rebalance days are numbered over all dates)."""
    days = df.select("date").distinct().withColumn("_day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)
    placed = df.join(days, "date").withColumns({"_bucket": F.floor(F.col("_day") / f), "_first": F.col("_day") % f == 0})
    picked = placed.where("_first").select("ticker", "_bucket", F.col(position).alias("_held"))
    return placed.join(picked, ["ticker", "_bucket"], "left").withColumn(position, F.coalesce("_held", F.lit(0.0))).drop("_held", "_bucket", "_first", "_day")


# -- backtests -----------------------------------------------------------------------------------------------


def backtest(book: DataFrame, position: str = "position", r: str = "ret", lag: int = 1, turnover: str = "full", cost_bps: float = 10.0, by: Sequence[str] = ()) -> DataFrame:
    """Per date (and strategy): gross, cost, net, turnover, longs, shorts and exposures.

    ``lag`` rows lie between a position and the return it earns (0: the same row). ``turnover`` is the sum of
    |change| (``full``) or half of it (``half``); a ticker's first position doesn't count.
    """
    series = Window.partitionBy(*by, "ticker").orderBy("date")
    held = F.lag(position, lag).over(series) if lag else F.col(position)
    rows = book.withColumn("_p", F.coalesce(held, F.lit(0.0))).withColumn("_d", F.abs(F.col("_p") - F.lag("_p").over(series)))
    factor = 1.0 if turnover == "full" else 0.5
    daily = rows.groupBy(*by, "date").agg(
        F.sum(F.col("_p") * F.coalesce(F.col(r), F.lit(0.0))).alias("gross"),
        (factor * F.coalesce(F.sum("_d"), F.lit(0.0))).alias("turnover"),
        F.count_if(F.col("_p") > 0).alias("longs"),
        F.count_if(F.col("_p") < 0).alias("shorts"),
        F.sum("_p").alias("net_exposure"),
        F.sum(F.abs("_p")).alias("gross_exposure"),
    )
    daily = daily.withColumn("cost", F.col("turnover") * F.lit(cost_bps / 1e4))
    return daily.withColumn("net", F.col("gross") - F.col("cost"))


def rebalanced(df: DataFrame, signal: str, fwd: str, f: int = 5, share: float = 0.2, side: str = "long", halve: bool = True, cost_bps: float = 10.0) -> DataFrame:
    """Top (or bottom, or both) names of every f-th date, equal weights, held until the next choice.

    Per date: n names, gross (mean of ``fwd`` over the names present), turnover (names changed over names
    held, halved unless told otherwise) on rebalance dates, net. Buckets of dates take the place of a loop.
    """
    dates = df.select("date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)
    rows = df.where(F.col(signal).isNotNull()).join(dates, "date").withColumn("bucket", F.floor(F.col("day") / f))
    first = rows.where(F.col("day") % f == 0)
    count = F.count(F.lit(1)).over(w.section())
    k = F.greatest(F.floor(count * F.lit(share)), F.lit(1))
    up = F.row_number().over(Window.partitionBy("date").orderBy(F.desc(signal), "ticker")) <= k
    down = F.row_number().over(Window.partitionBy("date").orderBy(F.asc(signal), "ticker")) <= k
    weight = {"long": flag(up), "short": -flag(down), "both": 0.5 * flag(up) - 0.5 * flag(down)}[side]
    chosen = first.withColumn("w", weight).where("w != 0").select("bucket", "ticker", "w")
    legs = chosen.select("bucket", "ticker", F.signum("w").alias("leg"))
    before = legs.select((F.col("bucket") + 1).alias("bucket"), "ticker", "leg", F.lit(1).alias("was"))
    kept = legs.join(before, ["bucket", "ticker", "leg"], "left").groupBy("bucket").agg(F.count(F.lit(1)).alias("held"), F.count("was").alias("stayed"))
    gone = legs.groupBy((F.col("bucket") + 1).alias("bucket")).agg(F.count(F.lit(1)).alias("had"))
    changed = kept.join(gone, "bucket", "left").select("bucket", "held", ((F.col("held") - F.col("stayed")) + F.coalesce(F.col("had") - F.col("stayed"), F.lit(0))).alias("changed"))
    daily = rows.join(chosen, ["bucket", "ticker"]).where(F.col(fwd).isNotNull()).groupBy("bucket", "day", "date").agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("w") > 0, F.col(fwd))).alias("l"), F.avg(F.when(F.col("w") < 0, F.col(fwd))).alias("s"))
    gross = {"long": F.col("l"), "short": -F.col("s"), "both": 0.5 * F.coalesce("l", F.lit(0.0)) - 0.5 * F.coalesce("s", F.lit(0.0))}[side]
    share_changed = F.when(F.col("day") % f == 0, F.col("changed") / F.col("held") * (0.5 if halve else 1.0)).otherwise(0.0)
    out = daily.join(changed, "bucket").select("date", "n", gross.alias("gross"), share_changed.alias("turnover"))
    return out.withColumn("net", F.col("gross") - F.col("turnover") * F.lit(cost_bps / 1e4))


def vol_target(daily: DataFrame, r: str = "net", target: float = 0.15, n: int = 63, low: float = 0.2, high: float = 2.0, include_current: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Adds leverage and levered returns; by default only past returns decide."""
    over = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    frame = over.rowsBetween(-(n - 1), 0) if include_current else over.rowsBetween(-n, -1)
    realised = F.when(F.count(r).over(frame) >= n, F.stddev_pop(r).over(frame) * F.sqrt(F.lit(float(DAYS))))
    lever = F.coalesce(clip(ratio(F.lit(target), realised), low, high), F.lit(1.0))
    return daily.withColumn("leverage", lever).withColumn("levered", F.col("leverage") * F.col(r))


def stop_out(daily: DataFrame, r: str = "net", stop: float = 0.1, by: Sequence[str] = ()) -> DataFrame:
    """Returns until the first fall of ``stop`` below the peak, then 0 for good (from the next row)."""
    over = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    value = F.product(1 + F.col(r)).over(w.so_far(over))
    out = daily.withColumn("_v", value).withColumn("_dd", F.try_divide(F.col("_v"), F.greatest(F.lit(1.0), F.max("_v").over(w.so_far(over)))) - 1)
    breached = F.max((F.col("_dd") <= -stop).cast("int")).over(over.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("stopped", F.when(F.coalesce(breached, F.lit(0)) == 1, 0.0).otherwise(F.col(r))).drop("_v", "_dd")


# -- metrics -------------------------------------------------------------------------------------------------


def equity(daily: DataFrame, r: str = "net", by: Sequence[str] = ()) -> DataFrame:
    """Adds value (of one unit) and drawdown."""
    over = Window.partitionBy(*(by or [F.lit(1)])).orderBy("date")
    out = daily.withColumn("value", F.product(1 + F.coalesce(F.col(r), F.lit(0.0))).over(w.so_far(over)))
    return out.withColumn("drawdown", F.col("value") / F.greatest(F.lit(1.0), F.max("value").over(w.so_far(over))) - 1)


def performance(daily: DataFrame, r: str = "net", by: Sequence[str] = ()) -> DataFrame:
    """Sharpe (arithmetic and geometric), Sortino, Calmar, CAGR, drawdowns, win rate, profit factor."""
    curve = equity(daily, r, by)
    n = F.count(r)
    mean, dev = F.avg(r), F.stddev_samp(r)
    growth = F.max_by("value", "date")
    base = curve.groupBy(*by).agg(
        n.alias("n"), growth.alias("value"), (F.pow(growth, F.lit(float(DAYS)) / n) - 1).alias("cagr"), (dev * F.sqrt(F.lit(float(DAYS)))).alias("ann_vol"), (F.try_divide(mean, dev) * F.sqrt(F.lit(float(DAYS)))).alias("sharpe"),
        (F.try_divide(mean, F.stddev_samp(F.when(F.col(r) < 0, F.col(r)))) * F.sqrt(F.lit(float(DAYS)))).alias("sortino"), F.min("drawdown").alias("max_drawdown"), F.avg(F.when(F.col("drawdown") < 0, F.col("drawdown"))).alias("avg_drawdown"),
        F.avg((F.col(r) > 0).cast("double")).alias("win_rate"), F.try_divide(F.sum(F.greatest(F.col(r), F.lit(0.0))), -F.sum(F.least(F.col(r), F.lit(0.0)))).alias("profit_factor"),
    )
    return base.withColumns({"geo_sharpe": ratio("cagr", "ann_vol", 1e-10), "calmar": ratio("cagr", F.abs("max_drawdown"))})


def compounded(daily: DataFrame, r: str = "net", unit: str = "month", by: Sequence[str] = ()) -> DataFrame:
    """Compounded return per month or year."""
    return daily.groupBy(*by, F.trunc("date", unit).alias("period")).agg((F.product(1 + F.col(r)) - 1).alias("ret"), F.count(r).alias("n"))


def underwater(daily: DataFrame, r: str = "net") -> DataFrame:
    """One row per spell below an earlier peak: first and last date, rows, depth."""
    over = Window.partitionBy(F.lit(1)).orderBy("date")
    curve = equity(daily, r).withColumn("_under", F.col("drawdown") < 0)
    spell = curve.withColumn("_spell", F.sum((~F.col("_under")).cast("int")).over(w.so_far(over))).where("_under")
    return spell.groupBy("_spell").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("days"), F.min("drawdown").alias("depth")).drop("_spell")


def longest_runs(daily: DataFrame, r: str = "net") -> DataFrame:
    """Longest runs of gains and of losses, mean win and mean loss."""
    over = Window.partitionBy(F.lit(1)).orderBy("date")
    rows = daily.where(F.col(r).isNotNull()).withColumn("_up", F.col(r) > 0)
    rows = rows.withColumn("_i", F.row_number().over(over) - F.row_number().over(Window.partitionBy("_up").orderBy("date")))
    runs = rows.groupBy("_up", "_i").agg(F.count(F.lit(1)).alias("n"), F.sum(r).alias("s"))
    return runs.agg(
        F.max(F.when(F.col("_up"), F.col("n"))).alias("max_wins"), F.max(F.when(~F.col("_up"), F.col("n"))).alias("max_losses"),
        F.try_divide(F.sum(F.when(F.col("_up"), F.col("s"))), F.sum(F.when(F.col("_up"), F.col("n")))).alias("avg_win"), F.try_divide(F.sum(F.when(~F.col("_up"), F.col("s"))), F.sum(F.when(~F.col("_up"), F.col("n")))).alias("avg_loss"),
    )
