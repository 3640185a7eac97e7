"""Importance resampling towards a target distribution, by hashed features of one to three words.

Identical texts are collapsed by grouping the full text, so features and weight are computed once per distinct text; its
counts are multiplied by its multiplicity. Two narrow passes over the distinct texts count the features of the corpus per
bucket and sum the gains of each text; only the buckets' counts reach the driver. Weights are joined back to the documents
by the SHA-256 of the text before each document draws its own Gumbel noise, and the documents are ranked by one exchange
by range of (score, doc_id), each partition's rows being numbered after those of the partitions before it.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut, fresh, joined_back, ship, slices, written
from strandline.llm.crc import crc_of_spans, shifted, zero_byte
from strandline.llm.words import LOWER, text_bytes, word_spans

#: Bytes that part words: all but digits, letters and the bytes of other scripts.
_APART = np.ones(256, bool)
_APART[0x80:] = False
_APART[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = False
_SPACE = np.uint32(0xE96CCF45)  # CRC-32 of one blank


@dataclass(frozen=True)
class Scheme:
    """Features are runs of 1 to ``longest`` words, hashed into ``buckets``. Of the documents with at least ``least_words`` words
    ``percent`` in 100 are drawn; ``seed`` begins what a document's noise is a digest of."""

    longest: int = 3
    buckets: int = 10_000
    least_words: int = 20
    percent: int = 5
    seed: str = "42"


def features(column: pa.Array, scheme: Scheme) -> tuple[np.ndarray, list[np.ndarray]]:
    """(number of the first word of each text, one more at the end; for each length of run the bucket of the run that begins at each word, -1 where
    the text ends before the run does)."""
    raw, offsets = text_bytes(column)
    raw = LOWER[raw]
    starts, ends, first = word_spans(raw, offsets, _APART)
    length, crc = ends - starts, crc_of_spans(raw, starts, ends)
    last = np.repeat(first[1:], np.diff(first))  # the word after a word's text
    at, run, out = np.arange(len(starts)), crc, []
    for k in range(scheme.longest):
        if k:
            run = shifted(zero_byte(run[:-1]) ^ _SPACE, length[k:]) ^ crc[k:]
        bucket = np.full(len(starts), -1, np.int64)
        bucket[: len(run)] = run % np.uint32(scheme.buckets)
        bucket[at + k >= last] = -1
        out.append(bucket)
    return first, out


def collapsed(docs: DataFrame, text: str = "text") -> DataFrame:
    """digest, text and n of every distinct text; a null text is an empty one. Written in the shared folder, as it is read twice."""
    texts = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text")).groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return written(texts.select(_digest("text").alias("digest"), "text", "n"), "texts")


def _digest(text: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def bucket_counts(texts: DataFrame, scheme: Scheme) -> np.ndarray:
    """Features per bucket over all rows of (text, n), each text counted n times."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(scheme.buckets, np.int64)
        for b in slices(batches, "text"):
            first, buckets = features(b.column("text"), scheme)
            copies = np.repeat(b.column("n").to_numpy(), np.diff(first)).astype(np.float64)
            for x in buckets:
                total += np.bincount(x + 1, copies, scheme.buckets + 1)[1:].astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    counts = np.zeros(scheme.buckets, np.int64)
    for r in texts.select("text", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of the buckets' smoothed shares in the target over those in the corpus, rounded down."""
    s_all, t_all, k = int(corpus.sum()), int(target.sum()), len(corpus)
    ratio = lambda s, t: float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def text_weights(texts: DataFrame, gain: np.ndarray, scheme: Scheme) -> DataFrame:
    """digest, n, n_words, n_features and weight of each distinct text."""
    shared = texts.sparkSession.sparkContext.broadcast(np.append(gain, 0))  # bucket -1 gains nothing

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for b in slices(batches, "text"):
            first, buckets = features(b.column("text"), scheme)
            summed = np.concatenate([[0], np.cumsum(sum(gain[x] for x in buckets))])
            words = np.diff(first)
            n = sum(np.maximum(words - k, 0) for k in range(scheme.longest))
            arrays = [pa.array(x, pa.int64()) for x in (words, n, summed[first[1:]] - summed[first[:-1]])]
            yield pa.RecordBatch.from_arrays([b.column("digest"), b.column("n"), *arrays], ["digest", "n", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "digest binary, n long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, scheme: Scheme = Scheme(), text: str = "text", digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of ``docs``; with ``digest`` the text's SHA-256 too.

    A-Z are lower-cased; words are runs of digits, letters and non-ASCII signs. A feature's gain is that of its bucket (see ``gains``), over all
    rows of ``docs`` and all rows of ``target`` (repeated ones count each time). score is weight plus Gumbel noise in
    thousandths, drawn from the SHA-256 of the seed and the doc_id, so it doesn't depend on how rows are dealt. Of the N rows with enough words
    the floor(percent * N / 100) of the highest scores have ranks from 1; ties go to the smaller doc_id, rows equal in both are ranked in any order.
    Null and empty texts, and texts without words, have weight 0 and are never drawn. A null doc_id draws the noise of an empty id and comes last among
    ties. Repeated rows are ranked each. Without rows the result is empty; an empty ``target`` has the smoothed share in every bucket.
    """
    ship(docs.sparkSession)
    texts = collapsed(docs, text)
    gain = gains(bucket_counts(texts, scheme), bucket_counts(collapsed(target), scheme))
    per_text = cut(text_weights(texts, gain, scheme))
    keyed = docs.select("doc_id", _digest(text).alias("digest"))
    u = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{scheme.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = joined_back(keyed, per_text, "digest").withColumns({"score": F.col("weight") + F.floor(-1000 * F.log(-F.log(u))), "fit": F.col("n_words") >= scheme.least_words})
    ranked = _placed(cut(scored if digest else scored.drop("digest")), [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()], scheme.percent)
    return ranked.select("doc_id", "n_words", "n_features", "weight", "score", "rank", *(["digest"] if digest else []))


def _placed(scored: DataFrame, order: list, percent: int) -> DataFrame:
    """``scored`` with rank, the place of each of the first ``percent`` in 100 of the rows that ``fit``."""
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = cut(scored.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    # The id is the partition's number in the upper bits and the row's place in it below: one count per partition gives the offsets.
    part = F.shiftright("at", 33)
    counts = sorted((r.part, r.n, r.fit) for r in at.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count_if("fit").alias("fit")).collect())
    drawn, before, offsets = percent * sum(f for _, _, f in counts) // 100, 0, []
    for p, n, _ in counts:
        offsets.append((p, before))
        before += n
    starts = scored.sparkSession.createDataFrame(offsets, "part long, before long")
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    return at.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.when(F.col("fit") & (place <= drawn), place))


def drawn(docs: DataFrame, target: DataFrame, scheme: Scheme = Scheme(), text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are drawn, all columns, with no order. Rows equal in doc_id and text are drawn together."""
    one, other = fresh(docs, "_drawn_id"), fresh(docs, "_drawn_digest")
    chosen = resample(docs, target, scheme, text, digest=True).where("rank is not null").select(F.col("doc_id").alias(one), F.col("digest").alias(other))
    here = F.col("doc_id").eqNullSafe(F.col(one)) & (_digest(text) == F.col(other))
    return docs.join(chosen, here, "left_semi")
