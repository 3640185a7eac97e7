"""Queries of this subpackage and, where SQL can express one, its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, hamming_search, html, language, minhash, pieces, pii, resampling, secret_scan, shards, toxicity, urls, vector_codes
from strandline.llm.common import crc_mod, table

URL_RULES = [urls.Rule("block", "net"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded: n_tokens and digests of ids and decoded text; a null text counts as empty."""
    model = pieces.PieceTable.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digest_documents(table(spark, sf_dir, "documents"), model)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score per document, from a lexicon learnt on a bounded sample of labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 5) != 0)
    return toxicity.score_documents(docs, lexicon).select(
        "doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "hits"
    )


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page by the site style trees of all pages."""
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, and the findings; the key is read from ``spark.strandline.pii.key``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pii.pseudonymise(docs, pii.key_of(spark))
    return done.withColumns({"n_found": F.coalesce(F.size("pii"), F.lit(0)), "n_replaced": F.coalesce(F.size(F.filter("pii", lambda x: x["replaced"])), F.lit(0))})


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best window of each document for each benchmark item it holds, counted over all documents and items."""
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learnt on a bounded sample of labelled rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, crc_mod("doc_id", 4) != 2)
    return language.identify(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near-duplicates among all documents: 85 in 100 of the three-word shingles, confirmed on full sets."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op9_top_k_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest rows by Hamming distance of every vector whose id is divisible by 50, against all rows."""
    return hamming_search.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards near equal in bytes."""
    return shards.shard(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts, and the rank of the five in 100 that are drawn."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product code of every usable vector, its error and its label's, and the digest of the codebooks learnt on all of them."""
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of the patterns, counted and digested, and all spans, those that the trained field adds included, of every whole text."""
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.find_secrets(docs, secret_scan.fit(docs))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "field")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), count("field").alias("n_field"),
    )


def _vector_codes_sql(rounds: int) -> str:
    """Rounds of assignment and means as one chain of common table expressions."""
    steps = [
        """
        WITH kept AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), parts AS MATERIALIZED (
            SELECT row, vec_id, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS part FROM kept, range(8) AS t(p)
        ), book0 AS MATERIALIZED (
            SELECT p, e, part AS entry FROM parts JOIN (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept ORDER BY vec_id LIMIT 16) USING (row)
        )"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""near{i} AS MATERIALIZED (
            SELECT row, p, any_value(part) AS part, min(CAST(list_sum(list_transform(list_zip(part, entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 16 + e) AS best
            FROM parts JOIN book{i} USING (p) GROUP BY row, p
        )""")
        if i < rounds:
            steps.append(f"""mean{i} AS (
            SELECT p, e, list(CAST(floor(CAST(total AS DOUBLE) / n) AS BIGINT) ORDER BY place) AS entry FROM (
                SELECT p, best % 16 AS e, place, sum(part[place]) AS total, count(*) AS n FROM near{i}, range(1, (SELECT max(len(part)) + 1 FROM parts)) AS t(place) GROUP BY ALL
            ) GROUP BY p, e
        ), book{i + 1} AS MATERIALIZED (
            SELECT p, e, coalesce(m.entry, b.entry) AS entry FROM book{i} b LEFT JOIN mean{i} m USING (p, e)
        )""")
    return ",".join(steps) + f""", coded AS (
            SELECT row, string_agg(printf('%02x', best % 16), '' ORDER BY p) AS code, CAST(sum(best // 16) AS BIGINT) AS error FROM near{rounds} GROUP BY row
        )
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
        FROM kept JOIN coded USING (row)
    """


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_pii": op4_pii,
    "op5_decontamination": op5_decontamination,
    "op6_language_id": op6_language_id,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_url_filters": op8_url_filters,
    "op9_top_k_search": op9_top_k_search,
    "op10_sharding": op10_sharding,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_vector_codes": op12_vector_codes,
    "op13_secret_scans": op13_secret_scans,
}

ORACLES: dict[str, str] = {
    "op8_url_filters": r"""
        WITH rest AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
        ), parts AS (
            SELECT page_id,
                translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rest
        ), ruled AS (
            SELECT *, CASE
                WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/'
            END AS rule FROM parts
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM ruled
    """,
    "op9_top_k_search": """
        WITH codes AS (
            SELECT vec_id, CAST(list_sum(list_transform(range(64), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS HUGEINT) << i ELSE 0 END)) AS HUGEINT) AS code FROM embeddings
        ), pairs AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(bit_count(xor(q.code, c.code)) AS BIGINT) AS distance
            FROM codes q JOIN codes c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS INTEGER) AS rank, vec_id, distance FROM pairs
        )
        SELECT query_id, rank, vec_id, distance FROM ranked WHERE rank <= 10
    """,
    "op12_vector_codes": _vector_codes_sql(6),
}
