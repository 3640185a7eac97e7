import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import graphs as gr
from strandline.sources import panel
from strandline.streaming import online


def test_reads_asset_files(spark, tmp_path):
    (tmp_path / "Asset_001.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,1,2,0.5,1.5,10\n2020-01-02,1,2,0.5,1.6,10\nbad,1,1,1,1,1\n2020-01-03,1,2,0.5,NaN,10\n")
    (tmp_path / "Asset_002.csv").write_text("Date,Open,High,Low,Close,Volume\n2020-01-02,5,6,4,5.5,\n")
    rows = panel.read_assets(spark, str(tmp_path)).orderBy("ticker", "date").collect()
    assert [(r.ticker, str(r.date), r.close, r.volume) for r in rows] == [("Asset_001", "2020-01-02", 1.5, 10.0), ("Asset_001", "2020-01-03", None, 10.0), ("Asset_002", "2020-01-02", 5.5, None)]


@pytest.mark.parametrize("kind", ["parquet", "csv", "json"])
def test_sinks(spark, tmp_path, kind):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, v int")
    panel.write_panel(df, f"{tmp_path}/out", kind)
    back = spark.read.option("header", True).format(kind).load(f"{tmp_path}/out")
    assert sorted((r.ticker, int(r.v)) for r in back.collect()) == [("a", 1), ("b", 2)]


def test_feature_store_and_log(spark, tmp_path):
    d = dt.date(2020, 1, 1)
    df = spark.createDataFrame([("a", d, 1.0, None), ("b", d, None, 2.0)], "ticker string, date date, x double, y double")
    panel.write_store(df, str(tmp_path), ["x", "y"], {"x": "first"})
    assert sorted(map(str, panel.read_store(spark, str(tmp_path)).collect())) == sorted(map(str, df.collect()))
    for name, v in (("one", 1.0), ("two", 3.0)):
        panel.append_experiment(spark, f"{tmp_path}/log", name, {"sharpe": v})
    assert [r.name for r in panel.leaderboard(spark.read.parquet(f"{tmp_path}/log"), "sharpe").collect()] == ["two", "one"]
    assert panel.content_hash(df, ["ticker", "x"]).first() == panel.content_hash(df.orderBy(F.desc("ticker")), ["ticker", "x"]).first()


def brute(x, horizontal):
    out = set()
    for i in range(len(x)):
        for j in range(i + 1, len(x)):
            if horizontal:
                ok = all(x[k] < min(x[i], x[j]) for k in range(i + 1, j))
            else:
                ok = all(x[k] < x[i] + (x[j] - x[i]) * (k - i) / (j - i) for k in range(i + 1, j))
            if ok:
                out.add((i, j))
    return out


@pytest.mark.parametrize("horizontal", [True, False])
def test_visibility(spark, horizontal):
    rng = random.Random(4)
    for x in ([3, 1, 2, 4, 1.5], [rng.choice([1.0, 2.0, 3.0, rng.random()]) for _ in range(40)]):
        df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(i), float(v)) for i, v in enumerate(x)], "ticker string, date date, x double")
        edges = gr.visibility_edges(df, "x", len(x), horizontal)
        assert {(r.i, r.j) for r in edges.collect()} == brute(x, horizontal)
        near = {(i, i + 1) for i in range(len(x) - 1)}
        assert near <= brute(x, horizontal)
    assert gr.path_lengths(edges).first().diameter >= 1


def test_online_smoothing_keeps_its_state(spark, tmp_path):
    rows = [("a", i, float(i)) for i in range(6)]
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, "ticker string, date long, x double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ticker string, date long, x double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = online.online_smoothing(stream, "x", 0.5).writeStream.format("memory").queryName("smooth").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    s, want = None, {}
    for _, d, v in rows:
        s = v if s is None else 0.5 * v + 0.5 * s
        want[d] = s
    assert {r.date: r.smoothed for r in spark.table("smooth").collect()} == want
