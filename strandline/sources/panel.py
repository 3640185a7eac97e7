"""Sources and sinks of long panels: one row per (ticker, date)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import clean

OHLCV = "Date string, Open double, High double, Low double, Close double, Volume double"
#: Split of in-sample and out-of-sample dates, and the three named periods.
BOUNDARY = "2024-01-01"
PERIODS = {"train": ("2016-01-01", "2021-12-31"), "validation": ("2022-01-01", "2023-12-31"), "test": ("2024-01-01", "2026-12-31")}


def read_assets(spark: SparkSession, path: str, pattern: str = r"(Asset_\d+)\.csv", schema: str = OHLCV) -> DataFrame:
    """A folder of CSV files, one per asset, as a long panel.

    The ticker is taken from the file's name; column names are lower-cased; dates that can't be read and
    repeated dates (all but the first by value) are dropped; NaN and infinities become null.
    """
    rows = spark.read.csv(path, header=True, schema=schema, enforceSchema=False, mode="PERMISSIVE")
    rows = rows.toDF(*(c.lower() for c in rows.columns)).withColumns(
        {"ticker": F.regexp_extract(F.input_file_name(), pattern, 1), "date": F.to_date(F.try_to_timestamp(F.col("date")))}
    )
    rows = rows.withColumns({c: clean(c) for c in ("open", "high", "low", "close", "volume")}).where("date is not null")
    first = F.row_number().over(Window.partitionBy("ticker", "date").orderBy("close", "volume", "open", "high", "low"))
    return rows.withColumn("_n", first).where("_n = 1").drop("_n").select("ticker", "date", "open", "high", "low", "close", "volume")


def read_panel(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    return spark.read.format(kind).load(path)


def trades_panel(spark: SparkSession, sf_dir: str, ticker: str = "p_brand") -> DataFrame:
    """Daily bars per part brand (or type) from line items: close is the mean price, open the first line's."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", F.col(ticker).alias("ticker"))
    return (
        items.join(parts, items.l_partkey == parts.p_partkey)
        .groupBy("ticker", F.col("l_shipdate").cast("date").alias("date"))
        .agg(
            F.min_by("l_extendedprice", F.struct("l_orderkey", "l_linenumber", "l_extendedprice")).alias("open"),
            F.max("l_extendedprice").alias("high"),
            F.min("l_extendedprice").alias("low"),
            F.avg("l_extendedprice").alias("close"),
            F.sum("l_quantity").alias("volume"),
        )
    )


def write_panel(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = ()) -> None:
    """Overwrite ``path``; CSV gets a header; ``by`` are folder columns for partition pruning."""
    writer = df.write.mode("overwrite").format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_store(df: DataFrame, path: str, features: Sequence[str], metadata: dict | None = None, keys: Sequence[str] = ("ticker", "date")) -> None:
    """A folder of one Parquet table per feature, and their metadata as one JSON row."""
    for f in features:
        df.select(*keys, f).where(F.col(f).isNotNull()).write.mode("overwrite").parquet(f"{path}/features/{f}")
    row = json.dumps({"features": list(features), "metadata": metadata or {}})
    df.sparkSession.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def read_store(spark: SparkSession, path: str, features: Sequence[str] | None = None, keys: Sequence[str] = ("ticker", "date")) -> DataFrame:
    """The stored features (all, unless named) side by side: one union and one pivoting aggregate."""
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    wanted = list(features or meta["features"])
    tall = None
    for f in wanted:
        part = spark.read.parquet(f"{path}/features/{f}").select(*keys, F.lit(f).alias("_f"), F.col(f).cast("double").alias("_v"))
        tall = part if tall is None else tall.unionByName(part)
    return tall.groupBy(*keys).agg(*(F.max(F.when(F.col("_f") == f, F.col("_v"))).alias(f) for f in wanted))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("multiLine", True).json(path)


def append_experiment(spark: SparkSession, path: str, name: str, metrics: dict[str, float], params: dict | None = None) -> None:
    """One row of an experiment log kept as Parquet."""
    spark.createDataFrame([(name, metrics, json.dumps(params or {}))], "name string, metrics map<string,double>, params string").coalesce(1).write.mode("append").parquet(path)


def leaderboard(log: DataFrame, metric: str, n: int = 10) -> DataFrame:
    """The ``n`` best experiments by a metric."""
    return log.withColumn("value", F.col("metrics")[metric]).where("value is not null").orderBy(F.desc("value"), "name").limit(n)


def content_hash(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the number of rows and an order-free hash of their values, the sum of the first 15 hexadecimal digits of each row's SHA-256.

    A row is its values as text, joined by a bar; nulls are empty."""
    row = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    h = F.conv(F.substring(F.sha2(row, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n"), F.sum(h).cast("string").alias("hash"))


def in_sample(df: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    return df.where(F.col("date") < F.lit(boundary).cast("date"))


def out_of_sample(df: DataFrame, boundary: str = BOUNDARY) -> DataFrame:
    return df.where(F.col("date") >= F.lit(boundary).cast("date"))


def period(df: DataFrame, name: str) -> DataFrame:
    low, high = PERIODS[name]
    return df.where(F.col("date").between(F.lit(low).cast("date"), F.lit(high).cast("date")))


def complete_dates(df: DataFrame, value: str = "close") -> DataFrame:
    """Rows of the dates on which every ticker has a value."""
    tickers = df.agg(F.countDistinct("ticker").alias("tickers"))
    full = df.groupBy("date").agg(F.count(value).alias("n")).join(F.broadcast(tickers), F.col("n") == F.col("tickers")).select("date")
    return df.join(full, "date", "left_semi")


def returns(df: DataFrame, price: str = "close") -> DataFrame:
    """Adds ret (simple), lr (log) and rn (row of the ticker, from 1)."""
    w = Window.partitionBy("ticker").orderBy("date")
    before = F.lag(price).over(w)
    growth = F.try_divide(F.col(price), before)
    return df.withColumns({"ret": growth - 1, "lr": F.ln(growth), "rn": F.row_number().over(w)})
