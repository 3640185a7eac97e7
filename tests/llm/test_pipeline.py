import random

import corpus_pipeline
import duckdb
import pytest

from strandline.llm import queries


@pytest.fixture()
def tables(spark, tmp_path):
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    item = text(30)
    rows = [(i, text(60)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(110 + i, rows[i][1] + " extra") for i in range(5)]
    rows += [(200 + i, text(20) + " awful creature " + text(20)) for i in range(12)] + [(300, text(10) + " " + item + " " + text(10)), (400, text(20) + " jane@x.org"), (500, None), (501, "")]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(200 <= i < 300)) for i, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), dict(rows)


def test_stages_in_order(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = set(texts)
    left = {"toxicity": set(range(200, 212)), "near_duplicates": {*range(100, 105), *range(110, 115)}, "decontamination": {300}}
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        want -= left.get(name, set())
        got = {r.doc_id: r.text for r in out.collect()}
        assert set(got) == want, name
        docs = out
    assert got[400] != texts[400] and got[400].endswith("@x.org") and all(got[i] == texts[i] for i in want - {400})
    final = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(final) == want and all(r.n_tokens == len(r.ids) for r in final.values())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    folder = "/root/testdata/sf0.01"
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    want = con.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, folder)
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(str, map(tuple, got.select(want.columns).collect()))) == sorted(map(str, want.fetchall()))


def test_empty_tables_and_repeated_rows(spark, tmp_path):
    """Without rows no stage gives any; repeated rows of one document stay or go together."""
    schemas = {"documents": "doc_id long, text string, lang string, source string, n_chars long", "labels": "doc_id long, quality int, toxic int", "benchmark": "item_id long, text string"}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/{name}.parquet")
        rows = [(i % 3, f"a text of its own number {i % 3} for the stages", "en", "s", 40) for i in range(6)] if name == "documents" else []
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/twice/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, f"{tmp_path}/twice").collect()) == [0, 0, 1, 1, 2, 2]
