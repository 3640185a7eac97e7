"""Walk-forward learning: fold tables, scalers, and ridge regression by additive Gram sums.

A fold's normal equations are sums over its rows, so all folds are fitted from one aggregate of the panel per
day; Gram matrices (features squared per fold) are solved on the executors.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.shipping import ship


def folds(df: DataFrame, start: int = 252, step: int = 21, embargo: int = 5, history: int | None = None) -> DataFrame:
    """(fold, train_from, train_to, test_from, test_to): day numbers, ends included, over the panel's dates.

    The first cut lies after ``start`` days; each fold tests the ``step`` days that begin ``embargo`` days after
    its cut; training takes all earlier days or the last ``history``.
    """
    n = df.agg(F.countDistinct("date").alias("n"))
    cuts = n.select(F.explode(F.when(F.col("n") > start + embargo, F.sequence(F.lit(start), F.greatest(F.col("n") - embargo - 1, F.lit(start)).cast("int"), F.lit(step)))).alias("cut"))
    low = F.greatest(F.col("cut") - history, F.lit(0)) if history else F.lit(0)
    return cuts.select(
        F.floor((F.col("cut") - start) / step).cast("int").alias("fold"), low.cast("int").alias("train_from"), (F.col("cut") - 1).cast("int").alias("train_to"),
        (F.col("cut") + embargo).cast("int").alias("test_from"), (F.col("cut") + embargo + step - 1).cast("int").alias("test_to"),
    )


def with_day(df: DataFrame) -> DataFrame:
    """Adds day, the number of the date among all dates, from 0."""
    days = df.select("date").distinct().withColumn("day", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("date")) - 1)
    return df.join(days, "date")


def gram(df: DataFrame, x: Sequence[str], y: str, by: Sequence[str], weight: str | None = None) -> DataFrame:
    """Per group: n, sums of w, w x, w y, w x x' (upper part) and w x y over rows that have all of them."""
    wt = F.col(weight) if weight else F.lit(1.0)
    full = df.dropna(subset=[*x, y])
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    return full.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(wt).alias("sw"), F.sum(wt * F.col(y)).alias("sy"), F.array(*(F.sum(wt * F.col(c)) for c in x)).alias("sx"),
        F.array(*(F.sum(wt * F.col(c) * F.col(y)) for c in x)).alias("sxy"), F.array(*(F.sum(wt * F.col(x[i]) * F.col(x[j])) for i, j in pairs)).alias("sxx"),
    )


def solve_ridge(row, k: int, alpha: float, standardise: bool = True) -> tuple[list[float], float]:
    """Coefficients and intercept from one Gram row; features are scaled by their population deviation
    (0 counts as 1) before the penalty, as are the returned coefficients scaled back."""
    xx = np.zeros((k, k))
    xx[np.triu_indices(k)] = row.sxx
    xx = xx + np.triu(xx, 1).T
    mx, my = np.array(row.sx) / row.sw, row.sy / row.sw
    centred, cross = xx - row.sw * np.outer(mx, mx), np.array(row.sxy) - row.sw * mx * my
    dev = np.sqrt(np.maximum(np.diag(centred) / row.sw, 0)) if standardise else np.ones(k)
    dev[dev < 1e-12] = 1.0
    beta = np.linalg.solve(centred / np.outer(dev, dev) + alpha * np.eye(k), cross / dev) / dev
    return beta.tolist(), float(my - beta @ mx)


def fold_grams(rows: DataFrame, x: Sequence[str], y: str, fold_table: DataFrame, weight: str | None = None) -> DataFrame:
    """Gram sums per fold. ``rows`` have day numbers; sums are taken per day first, so that days, not rows, meet the folds that hold them."""
    daily = gram(rows, x, y, ("day",), weight)
    placed = daily.join(F.broadcast(fold_table.select("fold", "train_from", "train_to")), F.col("day").between(F.col("train_from"), F.col("train_to")))
    sums = {"sx": len(x), "sxy": len(x), "sxx": len(x) * (len(x) + 1) // 2}
    return placed.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("sw").alias("sw"), F.sum("sy").alias("sy"), *(F.array(*(F.sum(F.col(c)[i]) for i in range(k))).alias(c) for c, k in sums.items()))


def walk_forward_ridge(df: DataFrame, x: Sequence[str], y: str, fold_table: DataFrame, alpha: float = 1.0, least: int = 100, weight: str | None = None) -> DataFrame:
    """ticker, date, fold, target and prediction of every test row; folds of fewer than ``least`` rows are left out.

    The fold table and one model a fold are broadcast: they grow with the dates alone.
    """
    ship(df.sparkSession)
    rows = with_day(df)
    k = len(x)

    def solve(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            got = [(int(r.fold), *solve_ridge(r, k, alpha)) for r in g.itertuples(index=False)]
            yield pd.DataFrame(got, columns=["fold", "beta", "intercept"])

    models = fold_grams(rows, x, y, fold_table, weight).where(F.col("n") >= least).mapInPandas(solve, "fold int, beta array<double>, intercept double")
    test = rows.join(F.broadcast(fold_table.join(models, "fold")), F.col("day").between(F.col("test_from"), F.col("test_to"))).dropna(subset=list(x))
    dot = sum((F.col("beta")[i] * F.col(c) for i, c in enumerate(x)), F.col("intercept"))
    return test.select("ticker", "date", "fold", F.col(y).alias("target"), dot.alias("prediction"))


def standard_scale(df: DataFrame, columns: Sequence[str], train) -> DataFrame:
    """Columns less the training rows' mean, by their population deviation (0 counts as 1)."""
    stats = df.where(train).agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_d_{c}") for c in columns))
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}")) for c in columns}
    return df.join(F.broadcast(stats)).withColumns(scaled).drop(*(f"_{s}_{c}" for s in "md" for c in columns))


def boosted_trees(df: DataFrame, x: Sequence[str], y: str, train, depth: int = 3, rounds: int = 20, seed: int = 42) -> tuple[DataFrame, list[float]]:
    """Predictions of all rows that have the features, and feature importances, by Spark's gradient boosting."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = VectorAssembler(inputCols=list(x), outputCol="_x").transform(df.dropna(subset=list(x)))
    model = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol="prediction", maxDepth=depth, maxIter=rounds, seed=seed).fit(rows.where(train).dropna(subset=[y]))
    return model.transform(rows).drop("_x"), model.featureImportances.toArray().tolist()


def logistic(df: DataFrame, x: Sequence[str], label: str, train) -> DataFrame:
    """Class probabilities (array ``probability``) by multinomial logistic regression."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = VectorAssembler(inputCols=list(x), outputCol="_x").transform(df.dropna(subset=list(x)))
    model = LogisticRegression(featuresCol="_x", labelCol=label, probabilityCol="_p", family="multinomial").fit(rows.where(train).dropna(subset=[label]))
    return model.transform(rows).withColumn("probability", vector_to_array("_p")).drop("_x", "_p", "rawPrediction")


def random_forest(df: DataFrame, x: Sequence[str], y: str, train, trees: int = 20, depth: int = 5, seed: int = 42) -> DataFrame:
    """Predictions of all rows that have the features, by Spark's random forest."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=list(x), outputCol="_x").transform(df.dropna(subset=list(x)))
    model = RandomForestRegressor(featuresCol="_x", labelCol=y, predictionCol="prediction", numTrees=trees, maxDepth=depth, seed=seed).fit(rows.where(train).dropna(subset=[y]))
    return model.transform(rows).drop("_x")


def saved_and_loaded(df: DataFrame, x: Sequence[str], y: str, train, path: str, penalty: float = 0.01) -> DataFrame:
    """Predictions by a fitted pipeline (assembler, scaler, linear model) written to ``path`` and read back."""
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.dropna(subset=list(x))
    stages = [VectorAssembler(inputCols=list(x), outputCol="_x"), StandardScaler(inputCol="_x", outputCol="_z", withMean=True), LinearRegression(featuresCol="_z", labelCol=y, regParam=penalty)]
    Pipeline(stages=stages).fit(rows.where(train).dropna(subset=[y])).write().overwrite().save(path)
    return PipelineModel.load(path).transform(rows).drop("_x", "_z")


def ensemble_weights(scores: Sequence[float]) -> list[float]:
    """Weights in proportion to positive scores; equal ones if none is positive."""
    s = np.maximum(np.array(scores, float), 0)
    return (s / s.sum()).tolist() if s.sum() > 0 else [1 / len(s)] * len(s)
