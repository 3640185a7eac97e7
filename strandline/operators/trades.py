"""Books whose names leave by stops on the summed return since entry, and the profits of their trades."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.scalars import ratio
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import windows as w

#: A weight above this counts as held; a trailing stop is armed once a trade's peak lies above the second number.
HELD, ARMED = 0.001, 0.02


def trade_states(ret: str, wanted: str, deviation: str, stop: float | None, take: float | None, trail: float | None, arm: float = ARMED) -> Callable[[pd.DataFrame], np.ndarray]:
    """(weight held after the row, profit of a trade that a stop closes on it) along one series.

    Each row's return is added to the trade's profit first; the trade is closed where that lies below -``stop``, above ``take``, or below its peak less ``trail`` times the deviation of a day times the root of 20,
    if the peak lies above ``arm``. Then a weight that is wanted takes effect, and begins a trade where none was held.
    """

    def f(g: pd.DataFrame) -> np.ndarray:
        out, held, gained, peak = np.full((len(g), 2), np.nan), 0.0, 0.0, 0.0
        for i, (r, x, d) in enumerate(zip(kn.values(g, ret), kn.values(g, wanted), kn.values(g, deviation))):
            if held > HELD:
                gained += 0.0 if np.isnan(r) else r
                peak = max(peak, gained)
                fell = trail is not None and not np.isnan(d) and peak > arm and gained < peak - trail * d * math.sqrt(20)
                if stop is not None and gained < -stop or take is not None and gained > take or fell:
                    out[i, 1] = gained
                    held = gained = peak = 0.0
            if not np.isnan(x):
                if x > HELD > held:
                    gained = peak = 0.0
                held = x
            out[i, 0] = held
        return out

    return f


def stopped_book(df: DataFrame, signal: str, ret: str = "ret", top: int = 5, rebalance: int = 21, stop: float | None = None, take: float | None = None, trail: float | None = None) -> DataFrame:
    """ticker, date, the return, held and closed: the ``top`` names by ``signal``, equally weighted, chosen anew every ``rebalance`` dates.

    Between those dates a name keeps its weight until a stop (see ``trade_states``; the deviation is that of the last 20 rows) closes it. Ties go to the smaller ticker. A name without a row on the date of a choice isn't held
    from its next row on.
    """
    q = ml.with_day(df).withColumn("_dev", w.std(ret, 20))
    q = w.top_k(q, signal, "_in", top)
    chosen = F.count_if("_in").over(w.section())
    period = F.floor(F.col("day") / rebalance)
    missed = period != F.lag(period).over(w.series())
    wanted = F.when(F.col("day") % rebalance == 0, F.when(F.col("_in"), 1.0 / chosen).otherwise(0.0)).when(missed, 0.0)
    q = q.withColumn("_wanted", wanted).select("ticker", "date", ret, "_wanted", "_dev")
    return kn.along(q, {("held", "closed"): trade_states(ret, "_wanted", "_dev", stop, take, trail)}).select("ticker", "date", ret, "held", "closed")


def book_returns(book: DataFrame, ret: str = "ret", lag: int = 0, cost_bps: float = 10.0) -> DataFrame:
    """(date, gross, turnover, net) of the weights held: with those of the row itself, as engines do that decide on a day's close and book its return, or of ``lag`` rows before."""
    q = book.withColumn("_w", F.coalesce(F.lag("held", lag).over(w.series()), F.lit(0.0)) if lag else F.col("held"))
    q = q.withColumn("_d", F.abs(F.col("_w") - F.coalesce(F.lag("_w").over(w.series()), F.lit(0.0))))
    daily = q.groupBy("date").agg(F.sum(F.col("_w") * F.coalesce(F.col(ret), F.lit(0.0))).alias("gross"), F.sum("_d").alias("turnover"))
    return daily.withColumn("net", F.col("gross") - F.col("turnover") * (cost_bps / 10_000))


def trade_summary(book: DataFrame, largest: int = 10) -> DataFrame:
    """One row: closed trades, their mean profit, the share that won, and how much of all profit the ``largest`` made (0 where all profit is 0). Ties go to any."""
    trades = book.where("closed is not null").select("closed")
    top = trades.orderBy(F.desc("closed")).limit(largest).agg(F.sum("closed").alias("top"))
    every = trades.agg(F.count(F.lit(1)).alias("trades"), F.avg("closed").alias("mean_profit"), F.avg((F.col("closed") > 0).cast("double")).alias("won"), F.sum("closed").alias("sum"))
    return every.join(F.broadcast(top)).select("trades", "mean_profit", "won", F.coalesce(ratio("top", "sum"), F.lit(0.0)).alias("concentration"))
