"""Walk-forward classifiers, a linear support vector regression by sums, and stacking without leaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.operators import learning as ml


def _folds(fold_table: DataFrame) -> list:
    """The fold table's rows: it grows with the dates alone."""
    return fold_table.orderBy("fold").collect()


def walk_forward_perceptron(
    df: DataFrame, x: Sequence[str], label: str, classes: int, fold_table: DataFrame, hidden: Sequence[int] = (8,), seeds: Sequence[int] = (1, 2, 3), rounds: int = 40, least: int = 500
) -> DataFrame:
    """ticker, date, fold, label, probability (array), predicted: of each fold's test rows, by perceptrons fitted on its training rows.

    Features are scaled by the training rows' means and deviations. The ensemble's probabilities are the mean over ``seeds``; ties go to the smaller class. Rows without a
    feature are left out, those without a label are predicted but not learnt from. Folds of fewer than ``least`` labelled rows are left out; classes a fold
    never saw get small probabilities there. ``label`` holds 0 .. ``classes`` - 1.
    """
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = ml.with_day(df).select("ticker", "date", "day", *x, F.col(label).cast("double").alias("_label")).dropna(subset=list(x)).persist()
    assembler, out = VectorAssembler(inputCols=list(x), outputCol="_x"), []
    for f in _folds(fold_table):
        train = rows.where(F.col("day").between(f.train_from, f.train_to) & F.col("_label").isNotNull())
        if train.count() < least:
            continue
        here = rows.where(F.col("day").between(f.test_from, f.test_to))
        both = train.withColumn("_train", F.lit(True)).unionByName(here.withColumn("_train", F.lit(False)))
        scaled = assembler.transform(ml.standard_scale(both, x, F.col("_train")))
        test, parts = scaled.where("not _train"), []
        learnt = scaled.where("_train").persist()
        for i, seed in enumerate(seeds):
            net = MultilayerPerceptronClassifier(featuresCol="_x", labelCol="_label", probabilityCol=f"_p{i}", predictionCol=f"_c{i}", rawPredictionCol=f"_r{i}", layers=[len(x), *hidden, classes], maxIter=rounds, seed=seed)
            test = net.fit(learnt).transform(test)
            parts.append(vector_to_array(f"_p{i}"))
        learnt.unpersist()
        mean = F.array(*(reduce(lambda a, b: a + b, (p[k] for p in parts)) / len(parts) for k in range(classes)))
        out.append(test.select("ticker", "date", F.lit(f.fold).alias("fold"), F.col("_label").cast("int").alias("label"), mean.alias("probability")))
    if not out:
        return df.sparkSession.createDataFrame([], f"ticker {dict(df.dtypes)['ticker']}, date {dict(df.dtypes)['date']}, fold int, label int, probability array<double>, predicted int")
    return reduce(DataFrame.unionByName, out).withColumn("predicted", (F.array_position("probability", F.array_max("probability")) - 1).cast("int"))


def accuracy_by_fold(predicted: DataFrame) -> DataFrame:
    """(fold, n, accuracy, majority): the share of labelled rows told right, and that of the commonest label."""
    labelled = predicted.where("label is not null")
    most = labelled.groupBy("fold", "label").agg(F.count(F.lit(1)).alias("k")).groupBy("fold").agg(F.max("k").alias("k"))
    got = labelled.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))
    return got.join(most, "fold").select("fold", "n", "accuracy", (F.col("k") / F.col("n")).alias("majority"))


# -- support vector regression -----------------------------------------------------------------------------


def _residual(x: Sequence[str], y: str, beta: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, (F.lit(float(b)) * c for b, c in zip(beta, [*(F.col(n) for n in x), F.lit(1.0)]))) - F.col(y)


def _slack(r: Column, epsilon: float, width: float) -> Column:
    """Loss of a residual: what it exceeds ``epsilon`` by, the corner rounded over ``width``."""
    over = F.abs(r) - epsilon
    return F.when(over <= 0, 0.0).when(over < width, over * over / (2 * width)).otherwise(over - width / 2)


def _slack_sums(rows: DataFrame, x: Sequence[str], y: str, beta: np.ndarray, epsilon: float, width: float) -> tuple[float, np.ndarray, np.ndarray]:
    """(loss, gradient, curvature) summed over all rows; one aggregate."""
    z, r = [F.col(c) for c in x] + [F.lit(1.0)], _residual(x, y, beta)
    over = F.abs(r) - epsilon
    pull = F.signum(r) * F.when(over <= 0, 0.0).when(over < width, over / width).otherwise(1.0)
    bend = F.when((over > 0) & (over < width), 1.0 / width).otherwise(0.0)
    k = len(z)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    one = rows.agg(F.sum(_slack(r, epsilon, width)).alias("loss"), *(F.sum(pull * c).alias(f"g{i}") for i, c in enumerate(z)), *(F.sum(bend * z[i] * z[j]).alias(f"h{i}_{j}") for i, j in pairs)).first()
    curve = np.zeros((k, k))
    for i, j in pairs:
        curve[i, j] = curve[j, i] = one[f"h{i}_{j}"] or 0.0
    return one.loss or 0.0, np.array([one[f"g{i}"] or 0.0 for i in range(k)]), curve


def fit_support_vectors(rows: DataFrame, x: Sequence[str], y: str, c: float = 0.1, epsilon: float = 0.1, tolerance: float = 1e-5, steps: int = 40) -> np.ndarray:
    """Coefficients and intercept (last) that minimise |beta|^2 / 2 + ``c`` times the summed slack of the residuals beyond ``epsilon``.

    Newton steps on losses of ever sharper corners, at most ``steps``. A step is two aggregates over the rows: sums for the direction (features squared), and the losses
    of several lengths at once; nothing else reaches the driver. As in the usual library the intercept is penalised like a coefficient.
    """
    k, sizes = len(x) + 1, 4.0 ** -np.arange(7)
    beta, width = np.zeros(k), 1.0
    for _ in range(steps):
        loss, g, h = _slack_sums(rows, x, y, beta, epsilon, width)
        value, grad = beta @ beta / 2 + c * loss, beta + c * g
        step = np.linalg.solve(np.eye(k) + c * h, grad)
        tried = [beta - s * step for s in sizes]
        losses = rows.agg(*(F.sum(_slack(_residual(x, y, b), epsilon, width)).alias(f"l{i}") for i, b in enumerate(tried))).first()
        values = [b @ b / 2 + c * (v or 0.0) for b, v in zip(tried, losses)]
        best = int(np.argmin(values))
        gained = value - values[best]
        if gained > 0:
            beta = tried[best]
        if gained <= tolerance * max(value, 1e-12):
            if width <= 1e-4:
                break
            width /= 10
    return beta


def support_vector_regression(df: DataFrame, x: Sequence[str], y: str, train: Column, c: float = 0.1, epsilon: float = 0.1) -> DataFrame:
    """``df``'s rows that have the features, with prediction; features are scaled by the training rows first."""
    scaled = ml.standard_scale(df.dropna(subset=list(x)), x, train)
    learnt = scaled.where(train).dropna(subset=[y]).select(*x, y).persist()
    beta = fit_support_vectors(learnt, x, y, c, epsilon)
    learnt.unpersist()
    return scaled.withColumn("prediction", reduce(lambda a, b: a + b, (F.lit(float(b)) * F.col(n) for b, n in zip(beta, x))) + float(beta[-1]))


# -- stacking -------------------------------------------------------------------------------------------------


def stacked(df: DataFrame, bases: Mapping[str, Sequence[str]], y: str, base_folds: DataFrame, meta_folds: DataFrame, penalties: Sequence[float], base_penalty: float = 1.0) -> DataFrame:
    """ticker, date, fold, target, penalty, prediction: a grid of ridge models over the base models' predictions.

    Base models (name -> features) walk forward over ``base_folds``, so each of their predictions is of a row that the model never saw; the meta models walk forward over ``meta_folds`` on
    those predictions alone. A row's target thus never reaches its own prediction, and rows before the first base fold's test have none.
    """
    parts = [ml.walk_forward_ridge(df, list(x), y, base_folds, base_penalty).select("ticker", "date", F.col("prediction").alias(name)) for name, x in bases.items()]
    features = reduce(lambda a, b: a.join(b, ["ticker", "date"]), parts)
    dated = df.select("ticker", "date", y).join(features, ["ticker", "date"], "left")  # all dates stay, so folds count the same days
    grid = [ml.walk_forward_ridge(dated, list(bases), y, meta_folds, alpha).withColumn("penalty", F.lit(float(alpha))) for alpha in penalties]
    return reduce(DataFrame.unionByName, grid)


def pipeline_results(panel: DataFrame, signals: DataFrame, mask: DataFrame | None = None, share: float = 0.2) -> DataFrame:
    """One row: n, mean_net, sharpe and turnover of the lagged long-short book of the top and bottom ``share`` of the names by signal (ticker, date, signal).

    ``mask`` (date, on): weights count times ``on`` of their date, 0 where there is none."""
    from strandline.operators import features as fe
    from strandline.operators import trading as tr

    book = fe.add(panel.join(signals, ["ticker", "date"]), tr.top_bottom("signal", share))
    if mask is not None:
        book = book.join(mask.select("date", "on"), "date", "left").withColumn("position", F.col("position") * F.coalesce("on", F.lit(0.0)))
    daily = tr.backtest(book)
    return daily.agg(F.count("net").alias("n"), F.avg("net").alias("mean_net"), (F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg("turnover").alias("turnover"))


def grid_scores(predictions: DataFrame) -> DataFrame:
    """(penalty, n, ic, best): mean over dates of the daily correlation of prediction and target, and whether it is the largest (ties: the smaller penalty)."""
    from pyspark.sql import Window

    from strandline.operators.trading import safe_corr

    daily = predictions.dropna(subset=["prediction", "target"]).groupBy("penalty", "date").agg(F.count(F.lit(1)).alias("k"), safe_corr("prediction", "target").alias("c"))
    scores = daily.groupBy("penalty").agg(F.sum("k").alias("n"), F.avg("c").alias("ic"))
    place = F.row_number().over(Window.partitionBy(F.lit("all")).orderBy(F.round("ic", 9).desc_nulls_last(), "penalty"))
    return scores.withColumn("best", place == 1)
