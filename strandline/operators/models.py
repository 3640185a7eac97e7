"""Latent-state and pair models: hidden Markov regimes, cointegration, principal factors, clusters."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.shared import scratch
from strandline.functions.shipping import ship
from strandline.operators import kernels as kn
from strandline.operators import windows as w


def fit_hmm(x: np.ndarray, states: int = 3, rounds: int = 30, floor: float = 1e-6) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Means, variances, transitions and log-likelihood of a Gaussian HMM: one window of ``fit_hmms``."""
    mean, var, step, like = fit_hmms(x[None], states, rounds, floor)
    return mean[0], var[0], step[0], float(like[0])


def fit_hmms(x: np.ndarray, states: int = 3, rounds: int = 30, floor: float = 1e-6, spread: float | np.ndarray = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """As many Gaussian HMMs as ``x`` [fit, row] has rows, by scaled Baum-Welch over all fits in step.

    States are placed at the quantiles of |x - mean| first (to the power ``spread``, one or one a fit, for other starts) and ordered by variance at the end; a fit
    that has converged is left as it is.
    """
    fits = len(x)
    far = np.abs(x - x.mean(1, keepdims=True))
    at = np.linspace(0, 1, states + 1) ** np.broadcast_to(spread, fits)[:, None]
    edges = np.stack([np.quantile(f, q) for f, q in zip(far, at)])
    part = np.clip((far[:, :, None] >= edges[:, None, :]).sum(2) - 1, 0, states - 1)
    own = part[:, :, None] == np.arange(states)
    count = own.sum(1)
    mean = np.where(count > 0, (own * x[:, :, None]).sum(1) / np.maximum(count, 1), x.mean(1)[:, None])
    var = np.where(count > 1, (own * (x[:, :, None] - mean[:, None]) ** 2).sum(1) / np.maximum(count, 1), x.var(1)[:, None])
    var = np.maximum(var, floor)
    step = np.full((fits, states, states), 0.1 / max(states - 1, 1))
    step[:, np.arange(states), np.arange(states)] = 0.9 if states > 1 else 1.0
    begin, like, on = np.full((fits, states), 1 / states), np.full(fits, -np.inf), np.arange(fits)
    for _ in range(rounds):
        v = x[on]
        alpha, beta, scale, dens = _passes(v, mean[on], var[on], step[on], begin[on])
        post = alpha * beta
        post /= post.sum(2, keepdims=True)
        joint = np.einsum("bti,bij,btj->bij", alpha[:, :-1], step[on], dens[:, 1:] * beta[:, 1:] / scale[:, 1:, None])
        moved = np.maximum(joint / np.maximum(joint.sum(2, keepdims=True), 1e-300), floor)
        step[on] = moved / moved.sum(2, keepdims=True)
        begin[on], mass = post[:, 0], np.maximum(post.sum(1), 1e-300)
        mean[on] = np.einsum("btk,bt->bk", post, v) / mass
        var[on] = np.maximum((post * (v[:, :, None] - mean[on][:, None]) ** 2).sum(1) / mass, floor)
        new = np.log(scale).sum(1)
        still = ~(np.abs(new - like[on]) < 1e-6 * np.abs(new))
        like[on] = new
        on = on[still]
        if not len(on):
            break
    order = np.argsort(var, 1, kind="stable")
    row = np.arange(fits)[:, None]
    return mean[row, order], var[row, order], step[row[:, :, None], order[:, :, None], order[:, None, :]], like


def _passes(x, mean, var, step, begin):
    dens = np.maximum(np.exp(-0.5 * (x[:, :, None] - mean[:, None]) ** 2 / var[:, None]) / np.sqrt(2 * np.pi * var)[:, None], 1e-300)
    fits, n, k = dens.shape
    alpha, beta, scale = np.empty((fits, n, k)), np.ones((fits, n, k)), np.empty((fits, n))
    row = begin * dens[:, 0]
    for t in range(n):
        if t:
            row = (alpha[:, t - 1, None] @ step)[:, 0] * dens[:, t]
        scale[:, t] = row.sum(1)
        alpha[:, t] = row / scale[:, t, None]
    for t in range(n - 2, -1, -1):
        beta[:, t] = (step @ (dens[:, t + 1] * beta[:, t + 1])[:, :, None])[:, :, 0] / scale[:, t + 1, None]
    return alpha, beta, scale, dens


def hmm_regimes(df: DataFrame, x: str = "ret", states: int = 3, window: int = 252, every: int = 21, key: str = "ticker") -> DataFrame:
    """key, date, regime and probabilities: the model is refitted on the last ``window`` rows every ``every`` rows,
    and filtered forward (no later row is seen). One grouped map per series."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date").dropna(subset=[x]).reset_index(drop=True)
        v, out = g[x].to_numpy(float), np.full((len(g), states), np.nan)
        cuts = range(window, len(g), every)
        models = fit_hmms(np.stack([v[t - window : t] for t in cuts]), states) if len(cuts) else None
        row = None
        for t in range(window, len(g)):
            fit = (t - window) // every
            if (t - window) % every == 0:
                row = np.full(states, 1 / states)
            if models is not None:
                mean, var, step = (m[fit] for m in models[:3])
                row = (row @ step) * np.maximum(np.exp(-0.5 * (v[t] - mean) ** 2 / var) / np.sqrt(2 * np.pi * var), 1e-300)
                row = row / row.sum()
                out[t] = row
        known = ~np.isnan(out[:, 0])
        got = g.loc[known, [key, "date"]]
        return got.assign(regime=out[known].argmax(1) if known.any() else [], probabilities=list(out[known].round(8).tolist()))

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, date date, regime int, probabilities array<double>")


def forward_states(v: np.ndarray, fit: np.ndarray, mean: np.ndarray, var: np.ndarray, step: np.ndarray, recent: int) -> np.ndarray:
    """Probabilities [row, state] of each row's state by a forward pass over its last ``recent`` values from equal ones on, with the model numbered by ``fit``; all rows in step."""
    rows = np.arange(len(v))
    p = None
    for back in range(recent - 1, -1, -1):
        at = rows - back
        seen = np.maximum(at, 0)
        dens = np.maximum(np.exp(-0.5 * (v[seen, None] - mean[fit]) ** 2 / var[fit]) / np.sqrt(2 * np.pi * var[fit]), 1e-300)
        first = dens / dens.sum(1, keepdims=True)
        if p is None:
            p = np.where((at >= 0)[:, None], first, np.nan)
            continue
        on = (p[:, None] @ step[fit])[:, 0] * dens
        moved = np.where(np.isnan(p[:, :1]), first, on / on.sum(1, keepdims=True))
        p = np.where((at >= 0)[:, None], moved, np.nan)
    return p


def hmm_features(df: DataFrame, x: str = "ret", states: int = 3, window: int = 252, every: int = 21, recent: int = 11, key: str = "ticker") -> DataFrame:
    """key, date, state, confidence, entropy, p_high (of the state of the largest variance), shift (sum of changes of the probabilities from the row before) and duration (expected
    rows in the state) at each row from ``window`` on: the model is refitted on the ``window`` rows before every ``every`` rows, and a row's state follows from its last ``recent`` values. Missing values are left out first."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("date").dropna(subset=[x]).reset_index(drop=True)
        v = g[x].to_numpy(float)
        cuts = range(window, len(g), every)
        if not len(cuts):
            return pd.DataFrame(columns=[key, "date", "state", "confidence", "entropy", "p_high", "shift", "duration"])
        mean, var, step, _ = fit_hmms(np.stack([v[t - window : t] for t in cuts]), states)
        fit = np.maximum(np.arange(len(v)) - window, 0) // every
        p = forward_states(v, fit, mean, var, step, recent)[window:]
        fit, best, at = fit[window:], p.argmax(1), np.arange(len(p))
        shift = np.append(np.nan, np.abs(np.diff(p, axis=0)).sum(1))
        return g.loc[window:, [key, "date"]].assign(
            state=best, confidence=p.max(1), entropy=-(p * np.log(p + 1e-10)).sum(1), p_high=p[at, var[fit].argmax(1)], shift=shift, duration=1 / (1 - step[fit, best, best] + 1e-6)
        )

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, date date, state int, confidence double, entropy double, p_high double, shift double, duration double")


def hmm_parameters(df: DataFrame, x: str = "ret", states: int = 3, least: int = 100, key: str = "ticker") -> DataFrame:
    """(key, state, mean, std, stay, share, loglik) of the model of each whole series of at least ``least`` values, states by variance; share: of rows that the state is the likeliest in."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("date")[x].dropna().to_numpy(float)
        if len(v) < least:
            return pd.DataFrame(columns=[key, "state", "mean", "std", "stay", "share", "loglik"])
        mean, var, step, like = fit_hmm(v, states)
        alpha, beta, _, _ = _passes(v[None], mean[None], var[None], step[None], np.full((1, states), 1 / states))
        share = np.bincount((alpha * beta)[0].argmax(1), minlength=states) / len(v)
        return pd.DataFrame({key: g[key].iloc[0], "state": range(states), "mean": mean, "std": np.sqrt(var), "stay": np.diag(step), "share": share, "loglik": like})

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, state int, mean double, std double, stay double, share double, loglik double")


def select_hmm(df: DataFrame, x: str = "ret", states: tuple[int, ...] = (2, 3, 4), starts: tuple[float, ...] = (1.0, 0.5, 2.0), least: int = 100, key: str = "ticker") -> DataFrame:
    """(key, states, loglik, aic, bic, least_share, mean_days, chosen): models of several sizes, each the best of several starts.

    ``least_share`` is the smallest share of rows that a state is the likeliest in, ``mean_days`` the mean length of its spells; the size of the
    smallest BIC is chosen, of those whose states all hold a twentieth of the rows if there are any. Series of fewer than ``least`` rows give none.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("date")[x].dropna().to_numpy(float)
        rows = []
        for k in states if len(v) >= least else ():
            fits = fit_hmms(np.tile(v, (len(starts), 1)), k, spread=np.array(starts))
            best = [int(fits[3].argmax())]
            mean, var, step, like = (f[best] for f in fits)
            alpha, beta, _, _ = _passes(v[None], mean, var, step, np.full((1, k), 1 / k))
            path = (alpha * beta)[0].argmax(1)
            free = k * k + 2 * k - 1
            spells = 1 + int((path[1:] != path[:-1]).sum())
            rows.append((g[key].iloc[0], k, like[0], 2 * free - 2 * like[0], free * math.log(len(v)) - 2 * like[0], np.bincount(path, minlength=k).min() / len(v), len(v) / spells))
        if rows:
            sound = [r for r in rows if r[5] >= 0.05] or rows
            best = min(sound, key=lambda r: r[4])[1]
            rows = [(*r, r[1] == best) for r in rows]
        return pd.DataFrame(rows, columns=[key, "states", "loglik", "aic", "bic", "least_share", "mean_days", "chosen"])

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, states int, loglik double, aic double, bic double, least_share double, mean_days double, chosen boolean")


def regime_stability(df: DataFrame, state: str, key: str = "ticker") -> DataFrame:
    """(key, n, changes, mean_days, stay): rows, changes of state, mean length of a spell, and the share of rows that keep the state of the row before."""
    over = w.series(key)
    q = df.where(F.col(state).isNotNull()).select(key, "date", F.col(state).alias("s")).withColumn("b", F.lag("s").over(over))
    changed = F.count_if(F.col("b").isNotNull() & (F.col("b") != F.col("s")))
    return q.groupBy(key).agg(F.count(F.lit(1)).alias("n"), changed.alias("changes"), (F.count(F.lit(1)) / (changed + 1)).alias("mean_days"), F.try_divide((F.count("b") - changed).cast("double"), F.count("b").cast("double")).alias("stay"))


def pair_spreads(df: DataFrame, price: str = "close", least: int = 100) -> DataFrame:
    """Per pair of tickers and date both log prices, the hedge ratio and intercept of the whole sample, and the
    spread. Pairs are of tickers (few), formed within a date, never of rows of one ticker."""
    rows = df.select("ticker", "date", F.ln(price).alias("lp"))
    a, b = (rows.toDF(f"asset{i}", "date", f"lp{i}") for i in (1, 2))
    both = a.join(b, "date").where("asset1 < asset2")
    fit = both.groupBy("asset1", "asset2").agg(F.regr_slope("lp1", "lp2").alias("hedge_ratio"), F.regr_intercept("lp1", "lp2").alias("intercept"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return both.join(fit, ["asset1", "asset2"]).withColumn("spread", F.col("lp1") - F.col("hedge_ratio") * F.col("lp2") - F.col("intercept"))


def engle_granger(spreads: DataFrame, critical: float = -3.34) -> DataFrame:
    """asset1, asset2, stat, n, cointegrated: the unit-root statistic of each pair's spread against the 5 % value of two series."""
    from strandline.operators.stats import dickey_fuller

    named = spreads.select(F.concat_ws("|", "asset1", "asset2").alias("pair"), "date", "spread")
    got = dickey_fuller(named, "spread", "pair").where("stat is not null")
    return got.select(F.split("pair", "[|]")[0].alias("asset1"), F.split("pair", "[|]")[1].alias("asset2"), "stat", "n", (F.col("stat") < critical).alias("cointegrated"))


def half_lives(spreads: DataFrame) -> DataFrame:
    """Per pair: speed of reversion (slope of the change on the level), half-life in rows, deviation of the spread."""
    over = Window.partitionBy("asset1", "asset2").orderBy("date")
    d = spreads.withColumn("before", F.lag("spread").over(over)).withColumn("change", F.col("spread") - F.col("before"))
    slope = F.regr_slope("change", "before")
    out = d.groupBy("asset1", "asset2").agg(F.max("hedge_ratio").alias("hedge_ratio"), slope.alias("speed"), F.stddev_samp("spread").alias("spread_std"), F.count("change").alias("n"))
    return out.withColumn("half_life", F.when(F.col("speed") < 0, -F.ln(F.lit(2.0)) / F.col("speed")))


def pair_positions(spreads: DataFrame, n: int = 63, enter: float = 2.0, leave: float = 0.5, stop: float = 4.0) -> DataFrame:
    """asset1, asset2, date, z, position: the state machine of each pair on its rolling z-score."""
    over = Window.partitionBy("asset1", "asset2").orderBy("date")
    z = spreads.select("asset1", "asset2", "date", w.zscore("spread", n, w=over).alias("z"))
    return kn.along(z, {"position": kn.pair_trades("z", enter, leave, stop)}, ["asset1", "asset2"])


def kalman_pair(df: DataFrame, y: str = "lp1", x: str = "lp2", q: float = 1e-5, r: float = 1e-3) -> DataFrame:
    """Adds alpha and beta of a random-walk regression of y on x along each pair, and its forecast error."""

    def run(g: pd.DataFrame) -> np.ndarray:
        state, cov, out = np.zeros(2), np.eye(2), np.empty((len(g), 3))
        for i, (a, b) in enumerate(zip(kn.values(g, y), kn.values(g, x))):
            cov = cov + q * np.eye(2)
            h = np.array([1.0, b])
            e, s = a - h @ state, h @ cov @ h + r
            k = cov @ h / s
            state, cov = state + k * e, cov - np.outer(k, h @ cov)
            out[i] = *state, e
        return out

    return kn.along(df, {("alpha", "beta", "error"): run}, ["asset1", "asset2"])


def lead_lag(df: DataFrame, reach: int = 5, x: str = "ret") -> DataFrame:
    """(asset1, asset2, lag, corr): correlation of asset1 with asset2's value ``lag`` rows earlier."""
    from strandline.operators.trading import safe_corr

    later = df.select("ticker", "date", x, *(F.lag(x, k).over(w.series()).alias(f"_{k}") for k in range(reach + 1)))
    tall = later.select(F.col("ticker").alias("asset2"), "date", F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("y")) for k in range(reach + 1)))).alias("e")).select("asset2", "date", "e.lag", "e.y")
    both = df.select(F.col("ticker").alias("asset1"), "date", x).join(tall, "date").where("asset1 != asset2")
    return both.groupBy("asset1", "asset2", "lag").agg(safe_corr(x, "y").alias("corr"))


def correlation_table(df: DataFrame, x: str = "ret") -> DataFrame:
    """(a, b, c): correlations of all pairs of tickers over their common dates, both ways round and each with itself; 0 where there is none. Written in the shared folder."""
    from strandline.operators.trading import safe_corr

    z = df.where(F.col(x).isNotNull()).select("ticker", "date", x)
    one, other = (z.toDF(f"t{i}", "date", f"x{i}") for i in (1, 2))
    half = one.join(other, "date").where("t1 <= t2").groupBy("t1", "t2").agg(safe_corr("x1", "x2").alias("c")).select(F.col("t1").alias("a"), F.col("t2").alias("b"), F.coalesce("c", F.lit(0.0)).alias("c"))
    folder = scratch(df.sparkSession, "correlations")
    half.unionByName(half.where("a != b").select(F.col("b").alias("a"), F.col("a").alias("b"), "c")).write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _matrix(column: pa.Array, k: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, k)


def _products(of: DataFrame, left: str, right: str, k: int) -> np.ndarray:
    """left' right of two columns of arrays of ``k``: a task gives one small matrix, Spark adds them up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            total += _matrix(b.column("l"), k).T @ _matrix(b.column("r"), k)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k), pa.int32()), pa.array(total.reshape(-1))], ["i", "p"])

    rows = of.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(run, "i int, p double").groupBy("i").agg(F.sum("p").alias("p"))
    return np.array([r.p for r in rows.orderBy("i").collect()]).reshape(k, k)


def _turned(of: DataFrame, v: str, m: np.ndarray) -> DataFrame:
    """(t, v): the arrays times a small matrix."""
    k = len(m)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("t"), pa.array(list(_matrix(b.column("v"), k) @ m), pa.list_(pa.float64()))], ["t", "v"])

    return of.select("t", F.col(v).alias("v")).mapInArrow(run, "t string, v array<double>")


def _orthonormal(gram: np.ndarray) -> np.ndarray:
    """What makes columns of these products orthonormal."""
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    return vectors / np.sqrt(np.maximum(values, values.max() * 1e-24))


def factors(df: DataFrame, x: str = "ret", components: int = 3, spare: int = 24, rounds: int = 100, tolerance: float = 1e-10, seed: int = 5) -> DataFrame:
    """(component, ticker, loading, explained): leading eigenvectors of the tickers' correlation matrix, each signed so that its largest loading is positive (ties: the first ticker's).

    Subspace iteration from seeded random columns, ``spare`` more than are wanted: the matrix and the columns stay tables, a round is a join and a sum by ticker, and only the products of
    the columns with each other (their number squared) reach the driver. It ends when the eigenvalues stand to ``tolerance``, at once where there are as many columns as tickers.
    """
    ship(df.sparkSession)
    table, spark = correlation_table(df, x), df.sparkSession
    tickers = table.select(F.col("a").alias("t")).distinct()
    n = tickers.count()
    k, values = min(components + spare, n), np.zeros(components)
    if n == 0:
        return spark.createDataFrame([], "component int, ticker string, loading double, explained double")

    def written(of: DataFrame) -> DataFrame:
        folder = scratch(spark, "columns")
        of.write.parquet(folder)
        return spark.read.parquet(folder)

    columns = written(tickers.select("t", F.array(*((F.pmod(F.xxhash64("t", F.lit(seed), F.lit(i)), F.lit(1 << 40)) / F.lit(float(1 << 40)) - 0.5) for i in range(k))).alias("v")))
    for _ in range(2):  # twice, as one pass leaves rounding of the condition's square
        columns = written(_turned(columns, "v", _orthonormal(_products(columns, "v", "v", k))))
    for _ in range(rounds):
        moved = table.join(columns.withColumnRenamed("t", "b"), "b").groupBy(F.col("a").alias("t")).agg(F.array(*(F.sum(F.col("c") * F.col("v")[i]) for i in range(k))).alias("m"))
        both = written(columns.join(moved, "t"))
        inner = _products(both, "v", "m", k)
        found, q = np.linalg.eigh((inner + inner.T) / 2)
        found, before = found[::-1], values
        values, vectors = found, _turned(both, "v", q[:, ::-1])
        if k == n or np.abs(found[:components] - before[:components]).max() <= tolerance * n:
            break
        columns = both.select("t", F.col("m").alias("v"))
        for _ in range(2):
            columns = written(_turned(columns, "v", _orthonormal(_products(columns, "v", "v", k))))
    wanted = min(components, n)
    shown = written(vectors).select("t", F.posexplode(F.slice("v", 1, wanted)).alias("component", "loading"))
    sign = shown.groupBy("component").agg(F.signum(F.min_by("loading", F.struct(-F.round(F.abs("loading"), 9), "t"))).alias("s"))
    shares = F.array(*(F.lit(float(v / n)) for v in values[:wanted]))
    return shown.join(F.broadcast(sign), "component").select(F.col("component").cast("int").alias("component"), F.col("t").alias("ticker"), (F.col("loading") * F.col("s")).alias("loading"), F.get(shares, F.col("component")).alias("explained"))


def ward_clusters(df: DataFrame, clusters: int = 4, x: str = "ret") -> DataFrame:
    """(ticker, cluster) by Ward linkage on sqrt(2 (1 - correlation)), clusters numbered by their first ticker.

    All pairs of clusters that are each other's nearest are merged at once, which gives the tree of merging one pair at a time. Distances between clusters follow from sums of squared distances
    between and within them, so a round is a relabelling and a sum over the pairs, which stay a table; the driver sees one row a merge.
    """
    spark = df.sparkSession
    corr = correlation_table(df, x)
    tickers = corr.select(F.col("a").alias("t")).distinct()
    names = tickers.withColumnRenamed("t", "a").join(tickers.withColumnRenamed("t", "b"))
    pairs = names.join(corr, ["a", "b"], "left").where("a != b").select("a", "b", (2 * (1 - F.coalesce("c", F.lit(0.0)))).alias("s"))

    def written(of: DataFrame, name: str) -> DataFrame:
        folder = scratch(spark, name)
        of.write.parquet(folder)
        return spark.read.parquet(folder)

    # Clusters by their first ticker: how many they hold, and the sum of squared distances within; sums between them, both ways.
    sizes, between, merges = written(tickers.select("t", F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("within")), "sizes"), written(pairs, "between"), []
    left = sizes.count()
    while left > 1:
        one, other = sizes.toDF("a", "na", "wa"), sizes.toDF("b", "nb", "wb")
        apart = F.col("s") / (F.col("na") * F.col("nb")) - F.col("wa") / (F.col("na") * F.col("na")) - F.col("wb") / (F.col("nb") * F.col("nb"))
        height = F.round(2 * F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")) * apart, 12)
        # Equal distances go to the pair that comes first, so that the choice is the same from both sides.
        nearest = between.join(one, "a").join(other, "b").groupBy("a").agg(F.min(F.struct(height.alias("h"), F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))).alias("best"))
        nearest = written(nearest.select("best.*"), "nearest")
        found = [(r.h, r.x, r.y) for r in nearest.groupBy("x", "y").agg(F.count(F.lit(1)).alias("k"), F.min("h").alias("h")).where("k = 2").collect()]
        if not found:  # rounding has hidden the nearest pair of all
            found = [tuple(nearest.orderBy("h", "x", "y").first())]
        merges += found
        left -= len(found)
        label = spark.createDataFrame([(y, x) for _, x, y in found], "old string, new string")
        renamed = lambda of, c: of.join(F.broadcast(label.toDF(c, f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
        joint = renamed(renamed(between, "a"), "b").groupBy("a", "b").agg(F.sum("s").alias("s"))
        inside = joint.where("a = b").select(F.col("a").alias("t"), (F.col("s") / 2).alias("more"))
        total = renamed(sizes, "t").groupBy("t").agg(F.sum("n").alias("n"), F.sum("within").alias("within"))
        sizes = written(total.join(inside, "t", "left").select("t", "n", (F.col("within") + F.coalesce("more", F.lit(0.0))).alias("within")), "sizes")
        between = written(joint.where("a != b"), "between")
    merges.sort()
    head = {t.t: t.t for t in tickers.collect()}

    def top(t: str) -> str:
        while head[t] != t:
            t = head[t]
        return t

    for _, a, b in merges[: max(len(head) - clusters, 0)]:
        a, b = sorted((top(a), top(b)))
        head[b] = a
    heads = sorted({top(t) for t in head})
    return spark.createDataFrame([(t, heads.index(top(t))) for t in sorted(head)], "ticker string, cluster int")


def average_correlation(df: DataFrame, n: int = 63, x: str = "ret") -> DataFrame:
    """(date, avg_corr): mean over ticker pairs of their rolling correlation."""
    z = df.where(F.col(x).isNotNull()).select("ticker", "date", x)
    a, b = (z.toDF(f"t{i}", "date", f"x{i}") for i in (1, 2))
    over = Window.partitionBy("t1", "t2").orderBy("date")
    return a.join(b, "date").where("t1 < t2").select("date", w.corr("x1", "x2", n, w=over).alias("c")).groupBy("date").agg(F.avg("c").alias("avg_corr"), F.count("c").alias("pairs"))

