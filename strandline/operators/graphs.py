"""Visibility graphs of series, as edge tables.

Whole series: in a horizontal graph the partners of a row are the next row at least as high and the last one before that is, so
its edges are two look-ups a row. They are found in chunks of rows; what sees beyond a chunk are its records (rows higher than all
before, or after, them in the chunk), few as a rule, and the graph of the records alone gives the edges between chunks. In a natural
graph a row sees, to its right, rows below it up to the next one as high, and then rows of the chain of ever higher ones.

Windows: an edge of a window's graph depends only on the points between its ends, so the graph of every window is
the induced part of one edge table per series: edges of at most ``span`` rows apart are found once, and a
window's statistics are joins and counts over them. Within a series each point looks ahead at most ``span``
rows, so the work per point is bounded and no pair of distant points is formed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.shipping import ship
from strandline.operators import windows as w


#: Rows of a chunk of a series whose horizontal edges one task finds.
CHUNK = 65_536


def _numbered(df: DataFrame, x: str, key: str, time: str) -> DataFrame:
    rows = df.where(F.col(x).isNotNull()).select(F.col(key).alias("key"), F.col(time).alias("t"), F.col(x).cast("double").alias("x"))
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("t")) - 1)


def next_as_high(x: np.ndarray) -> np.ndarray:
    """For each value the place of the next one that is at least as high, or the length: by maxima of spans of 2 ** k values."""
    n = len(x)
    spans = [np.append(x, np.inf)]
    while 1 << len(spans) <= n:
        half = 1 << (len(spans) - 1)
        last = spans[-1]
        spans.append(np.maximum(last, np.append(last[half:], np.full(half, np.inf))))
    at = np.arange(1, n + 1)
    for k in range(len(spans) - 1, -1, -1):
        lower = spans[k][np.minimum(at, n)] < x
        at[lower] += 1 << k
    return np.minimum(at, n)


def _horizontal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (i, j) of the edges of a whole series, i < j."""
    n, at = len(x), np.arange(len(x))
    after, before = next_as_high(x), n - 1 - next_as_high(x[::-1])[::-1]
    one, two = after < n, before >= 0
    both = np.unique(np.concatenate([at[one] * n + after[one], before[two] * n + at[two]]))
    return both // max(n, 1), both % max(n, 1)


def _natural(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the natural graph's edges: from all rows at once, a step further in each round."""
    n = len(x)
    high = next_as_high(x)
    left, right = [], []

    def seen(i: np.ndarray, j: np.ndarray, top: np.ndarray) -> np.ndarray:
        slope = (x[j] - x[i]) / (j - i)
        sees = slope > top[i]
        left.append(i[sees])
        right.append(j[sees])
        top[i[sees]] = slope[sees]
        return i

    top, i, d = np.full(n, -np.inf), np.arange(n), 1
    while len(i := i[i + d < high[i]]):  # rows below i
        seen(i, i + d, top)
        d += 1
    i, j = np.arange(n), high
    while len(i):
        i, j = i[j < n], j[j < n]
        seen(i, j, top)
        j = high[j]
    return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


def _edge_table(rows: DataFrame, by: tuple[str, ...], find, across: str | None = None) -> DataFrame:
    """The edges that ``find`` sees among the values of each group; with ``across``, those alone whose ends differ in that column."""
    ship(rows.sparkSession)
    types = dict(rows.dtypes)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        i, j = find(t.column("x").to_numpy())
        if across:
            of = t.column(across).to_numpy()
            apart = of[i] != of[j]
            i, j = i[apart], j[apart]
        at = t.column("i").to_numpy().astype(np.int32)
        i, j = pa.array(i, pa.int64()), pa.array(j, pa.int64())
        return pa.table({"key": t.column("key").take(i), "i": pa.array(at).take(i), "j": pa.array(at).take(j), "ti": t.column("t").take(i), "tj": t.column("t").take(j)})

    return rows.groupBy(*by).applyInArrow(run, f"key {types['key']}, i int, j int, ti {types['t']}, tj {types['t']}")


def horizontal_edges(df: DataFrame, x: str, key: str = "ticker", time: str = "date", chunk: int | None = None) -> DataFrame:
    """(key, i, j, ti, tj) of the whole series: every value between the ends lies below both. Nulls are left out before rows are numbered.

    Only records of the chunks meet in one task per series: few, but for a trend without a pause, all of whose rows are records.
    """
    rows = _numbered(df, x, key, time).withColumn("chunk", F.floor(F.col("i") / (chunk or CHUNK)))
    order = Window.partitionBy("key", "chunk").orderBy("i")
    higher = [F.coalesce(F.col("x") > F.max("x").over(order.rowsBetween(*frame)), F.lit(True)) for frame in ((Window.unboundedPreceding, -1), (1, Window.unboundedFollowing))]
    records = rows.withColumn("chunks", F.max("chunk").over(Window.partitionBy("key"))).where("chunks > 0").withColumns({"first": higher[0], "last": higher[1]}).where("first or last")
    edges = _edge_table(rows, ("key", "chunk"), _horizontal).unionAll(_edge_table(records.select("key", "t", "x", "i", "chunk"), ("key",), _horizontal, "chunk"))
    return edges.withColumnRenamed("key", key)


def natural_edges(df: DataFrame, x: str, key: str = "ticker", time: str = "date") -> DataFrame:
    """(key, i, j, ti, tj) of the whole series: every point between the ends lies below their line. A series is one task, with memory for it and its edges."""
    return _edge_table(_numbered(df, x, key, time), ("key",), _natural).withColumnRenamed("key", key)


def visibility_edges(df: DataFrame, x: str, span: int, horizontal: bool = True, key: str = "ticker", time: str = "date") -> DataFrame:
    """(key, i, j, ti, tj): ends of an edge see each other, i < j, at most ``span`` - 1 rows apart.

    Horizontal: every value between lies below both ends. Natural: every point between lies below the line.
    Neighbours always see each other; nulls are left out before rows are numbered.
    """
    series = Window.partitionBy(key).orderBy(time)
    rows = df.where(F.col(x).isNotNull()).select(key, time, F.col(x).cast("double").alias("x")).withColumn("i", F.row_number().over(series) - 1)
    ahead = series.rowsBetween(1, span - 1)
    seen = rows.withColumn("next", F.collect_list(F.struct(F.col("x").alias("y"), F.col(time).alias("tj"))).over(ahead))
    start = F.struct(F.lit(float("-inf")).alias("top"), F.expr(f"cast(array() as array<struct<d:int,tj:{dict(df.dtypes)[time]}>>)").alias("edges"))

    def step(acc, e):
        d = e["d"].cast("double")
        if horizontal:
            sees, top = (acc["top"] < F.col("x")) & (acc["top"] < e["y"]), F.greatest(acc["top"], e["y"])
        else:
            slope = (e["y"] - F.col("x")) / d
            sees, top = acc["top"] < slope, F.greatest(acc["top"], slope)
        edge = F.struct(e["d"].alias("d"), e["tj"].alias("tj"))
        return F.struct(top.alias("top"), F.when(sees | (e["d"] == 1), F.concat(acc["edges"], F.array(edge))).otherwise(acc["edges"]).alias("edges"))

    numbered = F.transform("next", lambda e, k: F.struct((k + 1).alias("d"), e["y"].alias("y"), e["tj"].alias("tj")))
    edges = F.aggregate(numbered, start, step, lambda acc: acc["edges"])
    return seen.select(key, F.col(time).alias("ti"), F.col("i").cast("int").alias("i"), F.explode(edges).alias("e")).select(key, "i", (F.col("i") + F.col("e.d")).cast("int").alias("j"), "ti", "e.tj")


def degrees(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, node, degree)."""
    both = edges.select(key, F.col("i").alias("node")).unionAll(edges.select(key, "j"))
    return both.groupBy(key, "node").agg(F.count(F.lit(1)).alias("degree"))


def degree_statistics(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """Per series: nodes, edges, density, moments of the degree, entropy of its distribution, power-law exponent."""
    deg = degrees(edges, key)
    p = deg.groupBy(key, "degree").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(w.section(key)))
    entropy = p.groupBy(key).agg((-F.sum(F.col("p") * F.log2(F.col("p") + 1e-10))).alias("degree_entropy"))
    n = F.count(F.lit(1))
    stats = deg.groupBy(key).agg(
        n.alias("num_nodes"), (F.sum("degree") / 2).cast("long").alias("num_edges"), F.avg("degree").alias("degree_mean"), F.stddev_pop("degree").alias("degree_std"), F.max("degree").alias("degree_max"),
        F.skewness("degree").alias("degree_skew"), (1 + F.try_divide(n.cast("double"), F.sum(F.ln(F.col("degree") / (F.lit(1.0) - 0.5))))).alias("gamma"),
    )
    density = 2.0 * F.col("num_edges") / (F.col("num_nodes") * (F.col("num_nodes") - 1))
    return stats.withColumn("density", density).join(entropy, key)


def clustering(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, triangles, clustering): mean local coefficient; triangles by joining edges that share an end."""
    a, b, c = (edges.select(key, F.col("i").alias(x), F.col("j").alias(y)) for x, y in (("p", "q"), ("q", "r"), ("p", "r")))
    tri = a.join(b, [key, "q"]).join(c, [key, "p", "r"])
    corners = tri.select(key, F.explode(F.array("p", "q", "r")).alias("node")).groupBy(key, "node").agg(F.count(F.lit(1)).alias("t"))
    local = degrees(edges, key).join(corners, [key, "node"], "left").withColumn("t", F.coalesce("t", F.lit(0)))
    value = F.when(F.col("degree") > 1, 2.0 * F.col("t") / (F.col("degree") * (F.col("degree") - 1))).otherwise(0.0)
    return local.groupBy(key).agg((F.sum("t") / 3).cast("long").alias("triangles"), F.avg(value).alias("clustering"))


def assortativity(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, assortativity): correlation of the degrees at the ends of edges, i before j."""
    deg = degrees(edges, key)
    ends = edges.join(deg.select(key, F.col("node").alias("i"), F.col("degree").alias("di")), [key, "i"]).join(deg.select(key, F.col("node").alias("j"), F.col("degree").alias("dj")), [key, "j"])
    from strandline.operators.trading import safe_corr

    return ends.groupBy(key).agg(safe_corr("di", "dj").alias("assortativity"))


def rolling_features(df: DataFrame, x: str, window: int, key: str = "ticker", time: str = "date") -> DataFrame:
    """(key, time, edges, degree_mean, density) of the horizontal graph of the last ``window`` rows at every row."""
    edges = visibility_edges(df, x, window, True, key, time)
    # An edge (i, j) belongs to the windows that end at j .. i + window - 1.
    ends = edges.withColumn("end", F.explode(F.sequence(F.col("j"), F.col("i") + window - 1)))
    counts = ends.groupBy(key, "end").agg(F.count(F.lit(1)).alias("edges"))
    rows = df.where(F.col(x).isNotNull()).select(key, time).withColumn("end", (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).cast("int"))
    return rows.where(F.col("end") >= window - 1).join(counts, [key, "end"]).select(key, time, "edges", (2.0 * F.col("edges") / window).alias("degree_mean"), (2.0 * F.col("edges") / (window * (window - 1))).alias("density"))


def rolling_statistics(df: DataFrame, x: str, window: int = 20, key: str = "ticker", time: str = "date") -> DataFrame:
    """(key, time, edges, density, degree_std, degree_max, gamma, entropy, clustering, assortativity) of the horizontal graph of the last ``window`` rows.

    An edge, a triangle and a node's degree are counted in the windows that hold them, so the work is the window's length a row. gamma is the exponent of the degrees from 1 on (null with fewer
    than five nodes); clustering is three times the triangles at all corners by the paths of two edges, so it may exceed 1; assortativity is 0 where the degrees are constant.
    """
    edges = visibility_edges(df, x, window, True, key, time).select(key, "i", "j")
    over = lambda first, last: F.explode(F.sequence(F.greatest(F.col(last), F.lit(window - 1)), F.greatest(F.col(first) + window - 1, F.lit(window - 1))))
    held = edges.withColumn("end", over("i", "j"))
    deg = held.select(key, "end", F.explode(F.array("i", "j")).alias("node")).groupBy(key, "end", "node").agg(F.count(F.lit(1)).alias("d"))
    shares = deg.groupBy(key, "end", "d").agg(F.count(F.lit(1)).alias("c"))
    p, d, c = F.col("c") / window, F.col("d"), F.col("c")
    mean, square = F.sum(c * d) / window, F.sum(c * d * d) / window
    stats = shares.groupBy(key, "end").agg(
        (F.sum(c * d) / 2).cast("long").alias("edges"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("degree_std"), F.max("d").alias("degree_max"),
        F.when(F.sum(c) >= 5, 1 + F.sum(c) / F.sum(c * F.ln(d / 0.5))).alias("gamma"), (-F.sum(p * F.log2(p + 1e-10))).alias("entropy"), F.sum(c * d * (d - 1) / 2).alias("paths"),
    )
    one, two, three = (edges.select(key, F.col("i").alias(a), F.col("j").alias(b)) for a, b in (("p", "q"), ("q", "r"), ("p", "r")))
    triangles = one.join(two, [key, "q"]).join(three, [key, "p", "r"]).where(F.col("r") - F.col("p") < window).withColumn("end", over("p", "r")).groupBy(key, "end").agg(F.count(F.lit(1)).alias("t"))
    ends = held.join(deg.toDF(key, "end", "i", "di"), [key, "end", "i"]).join(deg.toDF(key, "end", "j", "dj"), [key, "end", "j"])
    from strandline.operators.trading import safe_corr

    mixing = ends.groupBy(key, "end").agg(safe_corr("di", "dj").alias("assortativity"))
    rows = df.where(F.col(x).isNotNull()).select(key, time).withColumn("end", (F.row_number().over(Window.partitionBy(key).orderBy(time)) - 1).cast("int"))
    every = rows.join(stats, [key, "end"]).join(triangles, [key, "end"], "left").join(mixing, [key, "end"])
    return every.select(
        key, time, "edges", (2.0 * F.col("edges") / (window * (window - 1))).alias("density"), "degree_std", "degree_max", "gamma", "entropy",
        F.coalesce(9.0 * F.col("t") / F.col("paths"), F.lit(0.0)).alias("clustering"), F.coalesce("assortativity", F.lit(0.0)).alias("assortativity"),
    )


def composite_signal(df: DataFrame, x: str, window: int = 20, smooth: int = 5, limits: tuple[float, float, float] = (2.5, 0.3, 2.0), key: str = "ticker", time: str = "date") -> DataFrame:
    """(key, time, raw, signal): structure of the last ``window`` rows' graph in the direction of their mean return, and its mean over ``smooth`` rows, for series of at least ``window`` + 10 rows.

    The structure weighs the exponent of the degrees by one half, their entropy by 0.3 and the clustering by 0.4, each against its limit of ``limits`` (exponent, clustering, entropy).
    """
    cut = lambda c: F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))
    exponent, clustered, disorder = limits
    tilt = F.coalesce(cut((exponent - F.col("gamma")) / exponent), F.lit(0.0)) * 0.5 + cut((disorder - F.col("entropy")) / disorder) * 0.3 + (F.col("clustering") / (F.col("clustering") + clustered) - 0.5) * 0.4
    order = Window.partitionBy(key).orderBy(time)
    rows = df.where(F.col(x).isNotNull()).select(key, time, (F.try_divide(F.col(x), F.lag(x).over(order)) - 1).alias("_r"))
    rows = rows.withColumns({"_m": w.mean("_r", window, w=order), "_n": F.count(F.lit(1)).over(Window.partitionBy(key))}).where(F.col("_n") >= window + 10)
    raw = rolling_statistics(df, x, window, key, time).join(rows, [key, time]).select(key, time, cut(tilt * F.signum("_m")).alias("raw"))
    return raw.withColumn("signal", cut(F.avg("raw").over(order.rowsBetween(1 - smooth, 0))))


def signal_quality(signals: DataFrame, returns: DataFrame, ret: str, cost_bps: float = 10.0, key: str = "ticker", time: str = "date") -> DataFrame:
    """Per key: n, correlation of the signal with the return beside it, share of equal signs, mean change of the signal, what that costs a year, correlation with the row before, mean and deviation."""
    from strandline.operators.trading import safe_corr

    order = Window.partitionBy(key).orderBy(time)
    both = signals.select(key, time, "signal").join(returns.select(key, time, F.col(ret).alias("_r")), [key, time]).withColumn("_b", F.lag("signal").over(order))
    turned = F.avg(F.abs(F.col("signal") - F.col("_b")))
    return both.groupBy(key).agg(
        F.count("signal").alias("n"), safe_corr("signal", "_r").alias("ic"), F.avg(F.coalesce(F.signum("signal") == F.signum("_r"), F.lit(False)).cast("double")).alias("hit_rate"), turned.alias("turnover"),
        (turned * cost_bps / 10_000 * 252).alias("cost"), safe_corr("signal", "_b").alias("stay"), F.avg("signal").alias("mean"), F.stddev_samp("signal").alias("std"),
    )


#: Sources of a breadth-first search at a time, a multiple of 64.
SOURCES = 1_024


def path_lengths(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, mean_path, diameter) of each series' whole graph, by breadth-first search from all nodes at once:
    per node a bit set of the sources that reach it, so a level is one pass over the edges."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        i, j = g.i.to_numpy(), g.j.to_numpy()
        nodes, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = ends[: len(i)], ends[len(i) :]
        to, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.argsort(to, kind="stable")
        to, other = to[order], other[order]
        turn = np.arange(len(to)) - np.searchsorted(to, to)
        sides = [(to[turn == k], other[turn == k]) for k in range(turn.max() + 1)]  # every node's k-th neighbour
        total = far = pairs = 0
        for begin in range(0, len(nodes), SOURCES):  # sources at a time
            at = np.arange(begin, min(begin + SOURCES, len(nodes)))
            reach = np.zeros((len(nodes), SOURCES // 64), np.uint64)
            reach[at, (at - begin) // 64] = np.uint64(1) << ((at - begin) % 64).astype(np.uint64)
            known, level = len(at), 0
            while True:
                before = reach.copy()
                for x, y in sides:
                    reach[x] |= before[y]
                now = int(np.bitwise_count(reach).sum(dtype=np.int64))
                if now == known:
                    break
                level += 1
                total, known = total + level * (now - known), now
            far, pairs = max(far, level), pairs + known - len(at)
        return pd.DataFrame({key: [g[key].iloc[0]], "mean_path": [total / max(pairs, 1)], "diameter": [far]})

    ship(edges.sparkSession)
    return edges.select(key, "i", "j").groupBy(key).applyInPandas(run, f"{key} string, mean_path double, diameter long")


def weighted(edges: DataFrame, df: DataFrame, x: str, key: str = "ticker", time: str = "date") -> DataFrame:
    """Edges with the angle of their line as weight; i to j is the direction of time."""
    v = df.select(key, F.col(time).alias("t"), F.col(x).alias("v"))
    ends = edges.join(v.select(key, F.col("t").alias("ti"), F.col("v").alias("vi")), [key, "ti"]).join(v.select(key, F.col("t").alias("tj"), F.col("v").alias("vj")), [key, "tj"])
    return ends.withColumn("weight", F.atan2(F.col("vj") - F.col("vi"), (F.col("j") - F.col("i")).cast("double"))).drop("vi", "vj")


def market_state(density: str, low: float, high: float):
    """Trending, mixed or noisy by the density of the graph."""
    return F.when(F.col(density) < low, "trending").when(F.col(density) > high, "noisy").otherwise("mixed")


#: Nodes up to which a spectrum is solved densely.
DENSE = 400


def largest_eigenvalues(i: np.ndarray, j: np.ndarray, n: int, top: int) -> np.ndarray:
    """Of the adjacency of a graph by its edges, largest first: beyond ``DENSE`` nodes by Lanczos steps, each orthogonal to all before, until the wanted ones stand."""
    if n <= DENSE:
        a = np.zeros((n, n))
        a[i, j] = a[j, i] = 1
        return np.linalg.eigvalsh(a)[::-1][:top]
    q = np.random.default_rng(11).normal(size=n)
    basis, diagonal, beside = [q / np.linalg.norm(q)], [], []
    while True:
        v = np.bincount(i, basis[-1][j], n) + np.bincount(j, basis[-1][i], n)
        diagonal.append(float(v @ basis[-1]))
        whole = np.array(basis)
        for _ in range(2):
            v -= whole.T @ (whole @ v)
        beside.append(float(np.linalg.norm(v)))
        if len(basis) % 20 == 0 or len(basis) == n or beside[-1] < 1e-12:
            values, vectors = np.linalg.eigh(np.diag(diagonal) + np.diag(beside[:-1], 1) + np.diag(beside[:-1], -1))
            if len(basis) == n or beside[-1] < 1e-12 or len(basis) > 2 * top and (np.abs(vectors[-1, -top:]) * beside[-1]).max() < 1e-9:
                return values[::-1][:top]
        basis.append(v / beside[-1])


def spectrum(edges: DataFrame, top: int = 5, key: str = "ticker") -> DataFrame:
    """(key, eigenvalues) of the adjacency of each series' whole graph, largest first."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [g[key].iloc[0]], "eigenvalues": [largest_eigenvalues(g.i.to_numpy(), g.j.to_numpy(), int(g.j.max()) + 1, top).round(6).tolist()]})

    ship(edges.sparkSession)
    return edges.select(key, "i", "j").groupBy(key).applyInPandas(run, f"{key} string, eigenvalues array<double>")


def centralisation(edges: DataFrame, key: str = "ticker") -> DataFrame:
    """(key, centralisation): how far the degrees lie below the largest, as a share of a star's."""
    deg, n = degrees(edges, key), F.count(F.lit(1))
    return deg.groupBy(key).agg(F.try_divide((n * F.max("degree") - F.sum("degree")).cast("double"), ((n - 1) * (n - 2)).cast("double")).alias("centralisation"))


def power_law_fit(edges: DataFrame, key: str = "ticker", least: float = 2.0) -> DataFrame:
    """(key, gamma, ks, slope): exponent of the degrees from ``least`` on by likelihood, the largest gap between their distribution and
    the fitted one, and the exponent by regression of log shares on log degrees (2.5 with fewer than three degrees)."""
    deg = degrees(edges, key).where(F.col("degree") >= least)
    gamma = deg.groupBy(key).agg((1 + F.try_divide(F.count(F.lit(1)).cast("double"), F.sum(F.ln(F.col("degree") / (least - 0.5))))).alias("gamma"))
    share = deg.groupBy(key, "degree").agg(F.count(F.lit(1)).alias("n")).withColumn("p", F.col("n") / F.sum("n").over(w.section(key)))
    share = share.withColumn("cdf", F.sum("p").over(Window.partitionBy(key).orderBy("degree").rowsBetween(Window.unboundedPreceding, 0)))
    gap = F.abs(F.col("cdf") - (1 - F.pow((F.col("degree") + 0.5) / (least - 0.5), 1 - F.col("gamma"))))
    slope = F.when(F.count(F.lit(1)) >= 3, -F.regr_slope(F.ln("p"), F.ln("degree"))).otherwise(2.5)
    return share.join(gamma, key).groupBy(key).agg(F.max("gamma").alias("gamma"), F.max(gap).alias("ks"), slope.alias("slope"))
