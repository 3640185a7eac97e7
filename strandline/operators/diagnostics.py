"""Rank tests, diagnostics of targets, predictions and fits, ablation, smoothers, and books with conviction or full parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clip, ratio
from strandline.functions.shipping import ship
from strandline.operators import kernels as kn
from strandline.operators import learning as ml
from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.operators.stats import shuffled_correlations

YEAR = 252.0


# -- tests ---------------------------------------------------------------------------------------------------


def wilcoxon(df: DataFrame, x: str, key: str = "ticker") -> DataFrame:
    """(key, n, w_plus, z): signed ranks of |x| with mean ranks for ties; zeros are left out, z is the normal form without correction for ties."""
    some = df.where(F.col(x).isNotNull() & (F.col(x) != 0)).select(key, F.col(x).alias("_x"), F.abs(x).alias("_a"))
    ranked = some.withColumn("_k", w.pct_rank("_a", key) * F.count(F.lit(1)).over(w.section(key)))
    n = F.count(F.lit(1)).cast("double")
    plus = F.coalesce(F.sum(F.when(F.col("_x") > 0, F.col("_k"))), F.lit(0.0))
    return ranked.groupBy(key).agg(F.count(F.lit(1)).alias("n"), plus.alias("w_plus"), F.try_divide(plus - n * (n + 1) / 4, F.sqrt(n * (n + 1) * (2 * n + 1) / 24)).alias("z"))


def noise_floor(df: DataFrame, x: str, y: str, sims: int = 100, share: float = 0.95, seed: int = 42) -> DataFrame:
    """One row: the ``share`` quantile of |correlation| of x with y shuffled over all rows, and the true one."""
    c = shuffled_correlations(df, x, y, sims, seed)
    return c.agg(F.percentile(F.abs("c"), share).alias("floor"), F.max("real").alias("real"))


# -- diagnostics ----------------------------------------------------------------------------------------------


def lookahead(df: DataFrame, features: Sequence[str], target: str, limit: float = 0.5) -> DataFrame:
    """(feature, corr, suspicious) of each feature with the target on one date."""
    one = df.agg(*(tr.safe_corr(c, target).alias(c) for c in features))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("corr"), F.coalesce(F.abs(c) > limit, F.lit(False)).alias("suspicious")) for c in features))).alias("e")
    return one.select(rows).select("e.*")


def target_diagnostics(df: DataFrame, y: str) -> DataFrame:
    """One row: n, missing share, mean, deviation, signal to noise (mean by deviation), and the pooled correlation with the row before."""
    q = df.select(y, w.lag(y).alias("_b"))
    n = F.count(F.lit(1))
    return q.agg(F.count(y).alias("n"), F.try_divide((n - F.count(y)).cast("double"), n).alias("missing"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"), F.try_divide(F.avg(y), F.stddev_samp(y)).alias("snr"), tr.safe_corr(y, "_b").alias("ac1"))


def prediction_diagnostics(df: DataFrame, prediction: str, y: str) -> DataFrame:
    """One row: correlation, ratio of variances, autocorrelation of the residual, and mean by deviation of the daily rank correlation."""
    both = df.where(F.col(prediction).isNotNull() & F.col(y).isNotNull()).withColumn("_e", F.col(y) - F.col(prediction))
    pooled = both.withColumn("_b", w.lag("_e")).agg(F.count(F.lit(1)).alias("n"), tr.safe_corr(prediction, y).alias("corr"), F.try_divide(F.var_samp(prediction), F.var_samp(y)).alias("variance_ratio"), tr.safe_corr("_e", "_b").alias("residual_ac"))
    return pooled.join(F.broadcast(tr.information_ratio(tr.information_coefficient(both, prediction, y)).select("mean_ic", F.col("ir").alias("icir"))))


def overfit(df: DataFrame, x: str, y: str, boundary: str, warn: float = 0.05, fail: float = 0.10) -> DataFrame:
    """One row: mean daily rank correlation before and from ``boundary``, the gap, and its verdict."""
    ic = tr.information_coefficient(df, x, y)
    before = F.col("date") < F.lit(boundary).cast("date")
    one = ic.agg(F.avg(F.when(before, F.col("ic"))).alias("inside"), F.avg(F.when(~before, F.col("ic"))).alias("outside")).withColumn("gap", F.col("inside") - F.col("outside"))
    return one.withColumn("verdict", F.when(F.col("gap") > fail, "FAIL").when(F.col("gap") > warn, "WARN").otherwise("PASS"))


def halves(df: DataFrame, x: str = "ret") -> DataFrame:
    """(t1, t2, first, second, change) of each pair's correlation in the earlier and the later half of all dates."""
    days = ml.with_day(df.where(F.col(x).isNotNull()).select("ticker", "date", x))
    middle = days.agg((F.max("day") / 2).alias("middle"))
    z = days.join(F.broadcast(middle)).select("ticker", "date", F.col(x).alias("x"), (F.col("day") <= F.col("middle")).alias("early"))
    a, b = z.toDF("t1", "date", "x1", "early"), z.select(F.col("ticker").alias("t2"), "date", F.col("x").alias("x2"))
    early = lambda c, e: F.when(F.col("early") == e, F.col(c))
    both = a.join(b, "date").where("t1 < t2").groupBy("t1", "t2")
    return both.agg(tr.safe_corr(early("x1", True), early("x2", True)).alias("first"), tr.safe_corr(early("x1", False), early("x2", False)).alias("second")).withColumn("change", F.abs(F.col("second") - F.col("first")))


def cluster_correlation(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean correlation of pairs within one cluster and between two. ``pairs``: t1, t2, corr; ``labels``: ticker, cluster (one row a ticker)."""
    one, two = (labels.select(F.col("ticker").alias(f"t{i}"), F.col("cluster").alias(f"c{i}")) for i in (1, 2))
    same = F.col("c1") == F.col("c2")
    return pairs.join(one, "t1").join(two, "t2").agg(F.count_if(same).alias("n_within"), F.avg(F.when(same, F.col("corr"))).alias("within"), F.avg(F.when(~same, F.col("corr"))).alias("between"))


# -- learning -------------------------------------------------------------------------------------------------


def ablation(df: DataFrame, x: Sequence[str], y: str, folds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """(dropped, mean_ic, n): the daily rank correlation of walk-forward predictions with all features, and without each one."""
    out = None
    for gone in (None, *x):
        left = [c for c in x if c != gone]
        ic = tr.information_coefficient(ml.walk_forward_ridge(df, left, y, folds, alpha), "prediction", "target")
        part = ic.agg(F.avg("ic").alias("mean_ic"), F.count("ic").alias("n")).select(F.lit(gone or "none").alias("dropped"), "mean_ic", "n")
        out = part if out is None else out.unionByName(part)
    return out


def with_noise(df: DataFrame, columns: Sequence[str], size: float, seed: int = 42) -> DataFrame:
    """``columns`` with normal noise of ``size`` deviations of each column added, drawn from a hash of ticker and date."""
    dev = df.agg(*(F.stddev_samp(c).alias(f"_d_{c}") for c in columns))

    def normal(c: str) -> Column:
        u, v = (F.pmod(F.xxhash64("ticker", "date", F.lit(f"{seed}{c}{i}")), F.lit(1 << 52)) / F.lit(float(1 << 52)) for i in "ab")
        return F.sqrt(-2 * F.ln(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * np.pi * v)

    return df.join(F.broadcast(dev)).withColumns({c: F.col(c) + size * F.col(f"_d_{c}") * normal(c) for c in columns}).drop(*(f"_d_{c}" for c in columns))


def one_against_rest(df: DataFrame, x: Sequence[str], label: str, classes: Sequence[int], folds: DataFrame, alpha: float = 1.0) -> DataFrame:
    """ticker, date, fold, label, score_<class> and predicted: walk-forward least-squares scores of each class, and the class of the highest (the smaller one of equals)."""
    out = None
    for c in classes:
        part = ml.walk_forward_ridge(df.withColumn("_is", F.when(F.col(label).isNotNull(), (F.col(label) == c).cast("double"))), x, "_is", folds, alpha).select("ticker", "date", "fold", F.col("prediction").alias(f"score_{c}"))
        out = part if out is None else out.join(part, ["ticker", "date", "fold"])
    scores = [F.round(f"score_{c}", 9) for c in classes]
    best = F.lit(None).cast("int")
    for c, s in reversed(list(zip(classes, scores))):
        best = F.when(s >= F.greatest(*scores), c).otherwise(best)
    return out.withColumn("predicted", best).join(df.select("ticker", "date", label), ["ticker", "date"])


def cumulative_importance(names: Sequence[str], importances: Sequence[float], share: float = 0.8) -> list[tuple[str, float, float, bool]]:
    """(feature, importance, running sum, kept) from the largest on; kept up to the first whose running sum reaches ``share``."""
    out, total = [], 0.0
    for v, n in sorted(((v, n) for n, v in zip(names, importances)), key=lambda p: (-p[0], p[1])):
        kept, total = total < share, total + v
        out.append((n, float(v), float(total), kept))
    return out


def simplex_weights(daily: DataFrame, columns: Sequence[str], rounds: int = 2000, rate: float = 0.05) -> list[float]:
    """Weights of at least 0 and sum 1 that maximise mean by deviation of the weighted sum of ``columns`` (one row a date): the moments are
    counted in Spark, projected gradient ascent runs on them (columns squared numbers)."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = daily.dropna(subset=list(columns)).agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_samp(columns[i], columns[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    mean, cov = np.array([row[f"m{i}"] or 0.0 for i in range(k)]), np.zeros((k, k))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    x = np.full(k, 1 / k)
    for _ in range(rounds):
        dev = np.sqrt(max(x @ cov @ x, 1e-18))
        grad = mean / dev - (mean @ x) * (cov @ x) / dev**3
        y = x + rate * grad / max(np.abs(grad).max(), 1e-12)
        top = np.sort(y)[::-1]
        over = (np.cumsum(top) - 1) / np.arange(1, k + 1)
        x = np.maximum(y - over[np.flatnonzero(top > over)[-1]], 0)
        rate *= 0.998
    return x.tolist()


# -- smoothers ------------------------------------------------------------------------------------------------


def rts_level(x: str, q: float = 1e-5, r: float = 1e-2, p0: float = 1.0) -> Callable[[pd.DataFrame], np.ndarray]:
    """Local level given all observations of the series (forward filter, then backward pass); looks ahead, so for study alone."""

    def f(g: pd.DataFrame) -> np.ndarray:
        v = kn.values(g, x)
        level, prior, post = np.full(len(v), np.nan), np.full(len(v), np.nan), np.full(len(v), np.nan)
        s, p = np.nan, p0
        for i, y in enumerate(v):
            if np.isnan(s):
                s, before = y, p0
            else:
                before = p = p + q
                if not np.isnan(y):
                    k = p / (p + r)
                    s, p = s + k * (y - s), p * (1 - k)
            level[i], prior[i], post[i] = s, before, p
        out = level.copy()
        for i in range(len(v) - 2, -1, -1):
            if not np.isnan(level[i]):
                out[i] = level[i] + post[i] / prior[i + 1] * (out[i + 1] - level[i])
        return out

    return f


def em_noise(df: DataFrame, x: str, rounds: int = 20, q: float = 1e-5, r: float = 1e-2, key: str = "ticker") -> DataFrame:
    """(key, q, r, loglik): variances of the level's steps and of the observations by expectation and maximisation, per series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("date")[x].dropna().to_numpy(float)
        a, b, like = q, r, np.nan
        n = len(v)
        for _ in range(rounds if n > 2 else 0):
            s, p, prior, level = np.empty(n), np.empty(n), np.empty(n), v[0]
            prior[0], s[0], p[0], like = 1.0, v[0], b / (1 + b), 0.0
            for i in range(1, n):
                prior[i] = p[i - 1] + a
                e, var = v[i] - level, prior[i] + b
                like -= 0.5 * (np.log(2 * np.pi * var) + e * e / var)
                k = prior[i] / var
                level, p[i] = level + k * e, prior[i] * (1 - k)
                s[i] = level
            sm, vr, cross = s.copy(), p.copy(), np.zeros(n)
            for i in range(n - 2, -1, -1):
                c = p[i] / prior[i + 1]
                sm[i] = s[i] + c * (sm[i + 1] - s[i])
                vr[i] = p[i] + c * c * (vr[i + 1] - prior[i + 1])
                cross[i + 1] = c * vr[i + 1]
            b = max(float(np.mean((v - sm) ** 2 + vr)), 1e-12)
            a = max(float(np.mean(np.diff(sm) ** 2 + vr[1:] + vr[:-1] - 2 * cross[1:])), 1e-12)
        return pd.DataFrame({key: [g[key].iloc[0]], "q": [a], "r": [b], "loglik": [like]})

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, q double, r double, loglik double")


def filter_features(diagnosed: DataFrame, x: str, level: str = "level") -> DataFrame:
    """Columns of the forward filter: |innovation|, its deviation, likelihood ratio to the row before, gap of x to the level, return of the level."""
    return diagnosed.withColumns({
        "innovation_abs": F.abs("innovation"), "innovation_std": F.sqrt("innovation_var"), "surprise": ratio("innovation", F.sqrt("innovation_var")), "loglik_change": w.diff("loglik"), "gap": F.col(x) - F.col(level), "level_return": w.diff(level),
    })


# -- books ----------------------------------------------------------------------------------------------------


def conviction(signal: str, least: float = 0.3) -> list[dict[str, Column]]:
    """Only ranks at least ``least`` off the middle; each side sums to one half."""
    off = F.col("_k") - 0.5
    side = lambda c: F.coalesce(ratio(c, F.sum(c).over(w.section())), F.lit(0.0))
    return [
        {"_k": F.round(w.pct_rank(signal), 9)},
        {"_up": F.when(off >= least, off).otherwise(0.0), "_down": F.when(off <= -least, -off).otherwise(0.0)},
        {"position": 0.5 * side("_up") - 0.5 * side("_down")},
    ]


def per_side(x: str, by: str = "date") -> Column:
    """Weights whose long and short sides sum to one half each."""
    up, down = F.greatest(F.col(x), F.lit(0.0)), F.greatest(-F.col(x), F.lit(0.0))
    side = lambda c: F.coalesce(ratio(c, F.sum(c).over(w.section(by))), F.lit(0.0))
    return 0.5 * side(up) - 0.5 * side(down)


def full_engine(df: DataFrame, signal: str, r: str = "ret", top: int = 10, temperature: float | None = None, target: float = 0.15, n: int = 60, low: float = 0.5, high: float = 2.0, cost_bps: float = 10.0) -> DataFrame:
    """Per date gross, turnover, net, scale and scaled: the ``top`` names by the signal of the row before, equally or by softmax, and the book's
    return scaled by the deviation of its last ``n`` rows before (``low`` to ``high``; 1 before there are ``n``)."""
    ranked = w.top_k(df, signal, "_in", top)
    weight = F.when(F.col("_in"), 1.0).otherwise(0.0) if temperature is None else F.when(F.col("_in"), F.exp((F.col(signal) - F.max(F.when(F.col("_in"), F.col(signal))).over(w.section())) / temperature)).otherwise(0.0)
    daily = tr.backtest(ranked.withColumn("_w", weight).withColumn("position", tr.l1("_w")), r=r, cost_bps=cost_bps)
    past = Window.partitionBy(F.lit(1)).orderBy("date").rowsBetween(-n, -1)
    dev = F.when(F.count("net").over(past) >= n, F.stddev_samp("net").over(past) * F.sqrt(F.lit(YEAR)))
    return daily.withColumn("scale", F.coalesce(clip(ratio(F.lit(target), dev), low, high), F.lit(1.0))).withColumn("scaled", F.col("scale") * F.col("net"))


def regime_sized(book: DataFrame, regimes: DataFrame, sizes: dict[str, float], position: str = "position") -> DataFrame:
    """Positions times the size of the regime of the date before (1 where there is none). ``regimes``: date, regime (one row a date)."""
    size = F.coalesce(F.create_map(*(F.lit(v) for kv in sizes.items() for v in kv))[F.lag("regime").over(Window.partitionBy(F.lit(1)).orderBy("date"))], F.lit(1.0))
    return book.join(regimes.select("date", size.alias("_size")), "date", "left").withColumn(position, F.col(position) * F.coalesce("_size", F.lit(1.0))).drop("_size")


def alpha_beta(daily: DataFrame, r: str, market: str) -> DataFrame:
    """One row: beta to the market, alpha a year, correlation, deviation of the difference a year, and mean by it."""
    b = F.try_divide(F.covar_samp(r, market), F.var_samp(market))
    gap = F.col(r) - F.col(market)
    return daily.dropna(subset=[r, market]).agg(F.count(F.lit(1)).alias("n"), b.alias("beta"), ((F.avg(r) - b * F.avg(market)) * YEAR).alias("alpha"), tr.safe_corr(r, market).alias("corr"), (F.stddev_samp(gap) * F.sqrt(F.lit(YEAR))).alias("tracking"), (F.try_divide(F.avg(gap), F.stddev_samp(gap)) * F.sqrt(F.lit(YEAR))).alias("info_ratio"))


def blended(books: DataFrame, regimes: DataFrame, mix: dict[str, dict[str, float]], fallback: dict[str, float]) -> DataFrame:
    """``books`` (ticker, date and a column of weights per book) with ``position``: the books mixed as the regime of the date before tells
    (``fallback`` where there is none), scaled to a sum of |weights| of 1. ``regimes``: date, regime (one row a date)."""

    def total(parts: dict[str, float]) -> Column:
        return sum((v * F.coalesce(F.col(b), F.lit(0.0)) for b, v in parts.items()), F.lit(0.0))

    before = regimes.select("date", F.lag("regime").over(Window.partitionBy(F.lit(1)).orderBy("date")).alias("_regime"))
    position = total(fallback)
    for name, parts in mix.items():
        position = F.when(F.col("_regime") == name, total(parts)).otherwise(position)
    return books.join(before, "date", "left").withColumn("_mixed", position).withColumn("position", tr.l1("_mixed")).drop("_mixed", "_regime")
