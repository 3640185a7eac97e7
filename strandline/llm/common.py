"""Helpers shared by the training-data operators: table access, lineage cuts, session probes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions.shipping import ship  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; one is set here only where none is.

    A temporary folder is acceptable in local mode alone: on a cluster executors could not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named or sc._jsc.sc().getCheckpointDir().isDefined():
        return named or sc._jsc.sc().getCheckpointDir().get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="strandline-checkpoint-")
    sc.setCheckpointDir(made)
    return made


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts the lineage and is read by column."""
    folder = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


#: A key with more than this share of all rows is hot; so at most as many keys are hot, whatever the input.
HOT_KEYS = 10_000


def joined_back(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """``rows`` with the columns of ``groups``: one row per value of ``key`` (null a value like another), ``n`` its number of rows.

    Groups of more than one ``HOT_KEYS``th of all rows are sent to every task, at most ``HOT_KEYS`` of them; all others are joined by
    exchange, where no key holds more than that share. Both inputs should be materialised, as they are read twice.
    """
    total = groups.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_KEYS > total
    other = groups.withColumnRenamed(key, "_of")
    same = F.col(key).eqNullSafe(F.col("_of"))
    large = F.broadcast(other.where(hot))
    apart = rows.join(large.select("_of"), same, "left_anti").join(other.where(~hot), same)
    return rows.join(large, same).unionByName(apart).drop("_of", "n")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` is named so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(col: str, modulus: int):
    """crc32 of the decimal text of an id, modulo ``modulus``."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % modulus


def placed(docs: DataFrame, extra: Sequence[str], text: str) -> tuple[DataFrame, list[str], str]:
    """(the columns ``extra`` under names by place, and the text as ``text``; those names; their types as a schema).

    So any names may stand in ``extra``: the text's own, repeated ones, and those of the results.
    """
    names = [f"c{i}" for i in range(len(extra))]
    fields = docs.select(*(F.col(c).alias(n) for c, n in zip(extra, names))).schema.fields
    kept = docs.select(*(F.col(c).alias(n) for c, n in zip(extra, names)), F.col(text).alias("text"))
    return kept, names, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)


def slices(batches: Iterable[pa.RecordBatch], column: str, max_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each slice holds about ``max_bytes`` of one text column (a row stays whole)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        offsets = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, n in enumerate(offsets):
            if total and total + n > max_bytes:
                yield batch.slice(start, i - start)
                total, start = 0, i
            total += int(n)
        yield batch.slice(start)
