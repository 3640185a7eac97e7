"""Statistical tests, diagnostics and simulations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.shipping import ship
from strandline.operators import windows as w
from strandline.operators.trading import safe_corr


def sample_skew(x: str) -> Column:
    """Aggregate: bias-corrected skewness."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(x: str) -> Column:
    """Aggregate: bias-corrected excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def jarque_bera(x: str) -> Column:
    """Aggregate, of population moments."""
    return F.count(x) / 6.0 * (F.pow(F.skewness(x), 2.0) + F.pow(F.kurtosis(x), 2.0) / 4)


def autocorrelation(df: DataFrame, x: str, lags: Sequence[int], key: str = "ticker") -> DataFrame:
    """(key, lag, n, ac): Pearson correlation of x with its value k rows before, per series."""
    q = df.select(key, x, *(F.lag(x, k).over(w.series(key)).alias(f"_{k}") for k in lags))
    tall = q.select(key, x, F.explode(F.array(*(F.struct(F.lit(k).alias("lag"), F.col(f"_{k}").alias("y")) for k in lags))).alias("e")).select(key, x, "e.lag", "e.y")
    both = tall.where(F.col(x).isNotNull() & F.col("y").isNotNull())
    return both.groupBy(key, "lag").agg(F.count(F.lit(1)).alias("n"), safe_corr(x, "y").alias("ac"))


def ljung_box(ac: DataFrame, n: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, q): the statistic over the lags of ``ac``; ``n`` holds the length of each series."""
    q = ac.drop("n").join(n, key).groupBy(key).agg((F.max("n") * (F.max("n") + 2) * F.sum(F.pow("ac", F.lit(2.0)) / (F.col("n") - F.col("lag")))).alias("q"))
    return q


def t_test(x: str, mean: float = 0.0) -> list[Column]:
    """Aggregates: n, mean and t of a one-sample test."""
    return [F.count(x).alias("n"), F.avg(x).alias("mean"), F.try_divide(F.avg(x) - mean, F.stddev_samp(x) / F.sqrt(F.count(x))).alias("t")]


def welch_t(df: DataFrame, x: str, group: Column) -> DataFrame:
    """One row: Welch's t of the rows where ``group`` holds against the others."""
    a, b = F.when(group, F.col(x)), F.when(~group, F.col(x))
    var = F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b)
    return df.agg(F.count(a).alias("n1"), F.count(b).alias("n0"), F.try_divide(F.avg(a) - F.avg(b), F.sqrt(var)).alias("t"))


def quality_checks(df: DataFrame) -> DataFrame:
    """(check, value, status) of one pass over a panel with ret."""
    n, k = F.count(F.lit(1)), F.count("ret")
    one = df.agg(
        F.try_divide(F.count_if(F.col("close").isNull()).cast("double"), n).alias("missing"), F.try_divide(F.count_if(F.abs("ret") > 0.5).cast("double"), k).alias("extreme"), F.try_divide(F.count_if(F.col("ret") == 0).cast("double"), k).alias("zero"),
        F.try_divide(F.count_if((F.col("high") < F.col("low")) | (F.col("high") < F.col("close")) | (F.col("low") > F.col("close")) | (F.col("high") < F.col("open")) | (F.col("low") > F.col("open"))).cast("double"), n).alias("inconsistent"),
    )
    # Shares from which a check warns and fails.
    limits = {"missing": (0.01, 0.05), "extreme": (0.0005, 0.001), "zero": (0.1, 0.2), "inconsistent": (0.0, 0.0)}
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("check"), F.col(c).alias("value"), F.when(F.col(c) > f, "FAIL").when(F.col(c) > a, "WARN").otherwise("PASS").alias("status")) for c, (a, f) in limits.items()))).alias("e")
    return one.select(rows).select("e.*")


def suite_passes(checks: DataFrame) -> DataFrame:
    return checks.agg(F.bool_and(F.col("status") != "FAIL").alias("passed"), F.count_if(F.col("status") == "WARN").alias("warnings"))


def outliers(df: DataFrame, x: str, z: float = 5.0, iqr: float = 3.0, by: str = "ticker") -> DataFrame:
    """Per series the rows beyond z deviations, and beyond iqr interquartile ranges of the quartiles."""
    over = Window.partitionBy(by)
    q1, q3 = F.percentile(x, 0.25).over(over), F.percentile(x, 0.75).over(over)
    far = F.abs(F.col(x) - F.avg(x).over(over)) > z * F.stddev_samp(x).over(over)
    out = (F.col(x) < q1 - iqr * (q3 - q1)) | (F.col(x) > q3 + iqr * (q3 - q1))
    return df.withColumns({"_z": far, "_i": out}).groupBy(by).agg(F.count_if("_z").alias("by_z"), F.count_if("_i").alias("by_iqr"))


#: Rows that are shuffled among themselves: larger groups are dealt into blocks of about so many by a hash of the row.
BLOCK = 65_536


def shuffled_sums(df: DataFrame, x: str, y: str, sims: int, seed: int, by: str | None = None, block: int | None = None) -> DataFrame:
    """(sim, sxy): sum of x times shuffled y, for ``sims`` shuffles of y within ``by`` (or over all rows), in blocks of rows chosen by a hash.

    Each block is one group that evaluates all shuffles and gives one number a shuffle; rows are neither copied nor joined. Shuffles within fixed random
    blocks are a group of permutations, so a test by them is exact as one by all shuffles is.
    """
    base = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    keyed = base.select((F.col(by).cast("string") if by else F.lit("all")).alias("group"), F.xxhash64("ticker", "date").alias("h"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    sizes = keyed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / (block or BLOCK)).alias("blocks"))
    dealt = keyed.join(sizes, "group").withColumn("block", F.pmod("h", F.col("blocks")))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by([("h", "ascending"), ("x", "ascending"), ("y", "ascending")])
        a, b = (t.column(c).to_numpy() for c in "xy")
        name = f"{seed}|{t.column('group')[0].as_py()}|{t.column('block')[0].as_py()}"
        rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "little"))
        return pa.table({"sums": pa.array([[float(a @ rng.permutation(b)) for _ in range(sims)]], pa.list_(pa.float64()))})

    ship(df.sparkSession)
    sums = dealt.groupBy("group", "block").applyInArrow(run, "sums array<double>")
    return sums.select(F.posexplode("sums").alias("sim", "s")).groupBy("sim").agg(F.sum("s").alias("sxy"))


def shuffled_correlations(df: DataFrame, x: str, y: str, sims: int, seed: int, by: str | None = None, block: int | None = None) -> DataFrame:
    """(real, c): the true correlation beside that of each shuffle; shuffles leave all other moments as they are."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    n = F.count(F.lit(1)).cast("double")
    one = both.agg(n.alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"), (F.stddev_pop(x) * F.stddev_pop(y)).alias("d"), safe_corr(x, y).alias("real"))
    return shuffled_sums(df, x, y, sims, seed, by, block).join(F.broadcast(one)).select("real", F.try_divide(F.col("sxy") / F.col("n") - F.col("mx") * F.col("my"), F.col("d")).alias("c"))


def permutation_test(df: DataFrame, x: str, y: str, sims: int = 200, seed: int = 42, by: str | None = "date", block: int | None = None) -> DataFrame:
    """One row: the correlation, and the share of shuffles of y (within ``by``, or over all) that reach it."""
    c = shuffled_correlations(df, x, y, sims, seed, by, block)
    return c.agg(F.max("real").alias("real"), (F.count_if(F.col("c") >= F.col("real")) / F.lit(float(sims))).alias("p_value"))


def _weights(h: np.ndarray, sim: int, seed: int) -> np.ndarray:
    """Poisson weights of mean 1 of rows by their hashes, the same wherever a row lies."""
    with np.errstate(over="ignore"):
        z = h ^ np.uint64((sim * 0x9E3779B97F4A7C15 + seed * 0xD1B54A32D192ED03) % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
        z ^= z >> np.uint64(31)
    cdf = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
    return np.searchsorted(cdf, (z >> np.uint64(11)).astype(np.float64) / (1 << 53), "right")


def bootstrap_moments(df: DataFrame, x: str, sims: int, seed: int) -> DataFrame:
    """(sim, n, m, s): weighted count, mean and deviation of x in each Poisson bootstrap; a task gives three sums a simulation, rows are not copied."""
    rows = df.where(F.col(x).isNotNull()).select(F.col(x).cast("double").alias("x"), F.xxhash64(*df.columns).alias("h"))
    centre = rows.agg(F.avg("x")).first()[0] or 0.0  # sums of squares about it keep their digits

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, sims))
        for b in batches:
            v, h = b.column("x").to_numpy() - centre, b.column("h").to_numpy().view(np.uint64)
            for s in range(sims):
                k = _weights(h, s + 1, seed)
                total[:, s] += k.sum(), k @ v, k @ (v * v)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sims), pa.int32()), *(pa.array(t) for t in total)], ["sim", "n", "a", "b"])

    ship(df.sparkSession)
    sums = rows.mapInArrow(run, "sim int, n double, a double, b double").groupBy("sim").agg(*(F.sum(c).alias(c) for c in "nab"))
    mean = F.try_divide(F.col("a"), F.col("n"))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("b") - F.col("n") * mean * mean, F.col("n") - 1), F.lit(0.0)))
    return sums.select("sim", "n", (mean + centre).alias("m"), spread.alias("s"))


def _interval(values: DataFrame, c: Column, level: float) -> DataFrame:
    tail = (1 - level) / 2
    return values.agg(F.percentile(c, F.array(F.lit(tail), F.lit(1 - tail))).alias("q")).select(F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def bootstrap_mean(df: DataFrame, x: str, sims: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: mean of x and its Poisson-bootstrap interval."""
    return df.agg(F.avg(x).alias("mean")).join(F.broadcast(_interval(bootstrap_moments(df, x, sims, seed), F.col("m"), level)))


def bootstrap_sharpe(df: DataFrame, x: str, sims: int = 1000, seed: int = 42, level: float = 0.95, annual: int = 252) -> DataFrame:
    """One row: the annualised mean by deviation of x, its interval, and the share of simulations at or below 0."""
    ratio_of = F.try_divide(F.col("m"), F.nullif("s", F.lit(0.0))) * math.sqrt(annual)
    drawn = bootstrap_moments(df, x, sims, seed).select(ratio_of.alias("r"))
    real = df.agg((F.try_divide(F.avg(x), F.nullif(F.stddev_samp(x), F.lit(0.0))) * math.sqrt(annual)).alias("sharpe"))
    below = drawn.agg((F.count_if(F.col("r") <= 0) / F.lit(float(sims))).alias("share_below"))
    return real.join(F.broadcast(_interval(drawn, F.col("r"), level))).join(F.broadcast(below))


def dickey_fuller(df: DataFrame, x: str, key: str = "ticker", lags: int = 1) -> DataFrame:
    """(key, stat, n): t of the lagged level in the augmented regression with a constant."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        v = g.sort_values("date")[x].dropna().to_numpy(float)
        if len(v) < 20 + lags:
            return pd.DataFrame({key: [g[key].iloc[0]], "stat": [None], "n": [len(v)]})
        d = np.diff(v)
        design = np.column_stack([np.ones(len(d) - lags), v[lags:-1], *(d[lags - i - 1 : len(d) - i - 1] for i in range(lags))])
        y = d[lags:]
        beta, *_ = np.linalg.lstsq(design, y, rcond=None)
        res = y - design @ beta
        var = res @ res / max(len(y) - design.shape[1], 1) * np.linalg.pinv(design.T @ design)
        return pd.DataFrame({key: [g[key].iloc[0]], "stat": [beta[1] / math.sqrt(var[1, 1])], "n": [len(v)]})

    ship(df.sparkSession)
    return df.select(key, "date", x).groupBy(key).applyInPandas(run, f"{key} string, stat double, n long")
