"""A training corpus from documents: five stages, each written as Parquet and read by the next.

Toxic documents go; of every group of near-duplicates one document stays; documents that hold a benchmark
item go; personal data is pseudonymised; texts become SentencePiece ids. All stages but the last return the
columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, minhash, pieces, pii, toxicity
from strandline.llm.common import checkpoint_dir, crc_mod, table

#: Near-duplicates: five words a shingle, similarity 0.8 or more. 32 bands of 4 miss such a pair once in 20 million.
NEAR = minhash.Scheme(k=5, percent=80, bands=32, rows=4)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below one half; the lexicon is learnt from a bounded sample of labelled rows."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.keep_clean(docs, lexicon)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document of the smallest id stays; documents without words are in no group and stay."""
    return minhash.without_copies(docs, NEAR)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms in their texts."""
    done = pii.pseudonymise(docs, pii.key_of(spark), findings="_pii")
    return done.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of every document."""
    model = pieces.PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"))
    coded = pieces.encode_documents(docs, model, extra=("doc_id", "lang", "source"))
    return coded.select("doc_id", "lang", "source", F.size("ids").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", pseudonymise),
    ("sentencepiece", tokenise),
]

#: Lexicon learning, MinHash groups and Feistel digests have no SQL form; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
    return docs
