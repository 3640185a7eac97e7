"""Queries cover the whole panel: no prefix of dates, no subset of tickers, no cap on nodes."""

import datetime as dt
import random

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from strandline.operators import graphs as gr
from strandline.operators import models
from strandline.sources import panel

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
GRAPHS = ["gr1_horizontal_edges", "gr1_natural_edges", "gr2_weighted_edges", "gr3_degrees", "gr4_degree_statistics", "gr5_power_law", "gr6_clustering", "gr7_triads", "gr9_assortativity", "gr10_rolling_features"]


def equal(spark, name, sql):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = con.sql(sql)
    own = QUERIES[name](spark, FOLDER)
    assert sorted(own.columns) == sorted(want.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, own.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", GRAPHS)
def test_graphs_of_all_dates(spark, name):
    equal(spark, name, ORACLES[name])


def test_paths_and_spectrum_of_all_nodes(spark):
    rng = random.Random(7)
    x = [rng.random() for _ in range(260)]
    df = spark.createDataFrame([("a", dt.date(2020, 1, 1) + dt.timedelta(i), v) for i, v in enumerate(x)], "ticker string, date date, x double")
    edges = gr.visibility_edges(df, "x", 10)
    a = np.zeros((260, 260))
    for r in edges.collect():
        a[r.i, r.j] = a[r.j, r.i] = 1
    dist = np.where(a > 0, a, np.inf)
    np.fill_diagonal(dist, 0)
    for k in range(260):
        dist = np.minimum(dist, dist[:, k : k + 1] + dist[k])
    got = gr.path_lengths(edges).first()
    assert got.diameter == dist.max() and abs(got.mean_path - dist.sum() / (260 * 259)) < 1e-9
    assert np.allclose(gr.spectrum(edges).first().eigenvalues, np.linalg.eigvalsh(a)[::-1][:5], atol=1e-6)


@pytest.mark.parametrize("name", ["rsh7_align_target", "rsh9_reindex_fill", "jn6_semi_anti"])
def test_joins_of_all_rows(spark, name):
    assert "date <" not in ORACLES[name] and "ticker <" not in ORACLES[name]
    equal(spark, name, ORACLES[name])


def test_predictions_of_all_tickers_and_dates(spark):
    px = panel.trades_panel(spark, FOLDER)
    tickers, last = px.select("ticker").distinct().count(), px.agg({"date": "max"}).first()[0]
    for name in ("ml5_elastic_net", "ml6_boosted_trees", "ml7_logistic"):
        out = QUERIES[name](spark, FOLDER)
        assert out.select("ticker").distinct().count() == tickers and out.agg({"date": "max"}).first()[0] == last


def test_pairs_of_all_tickers(spark):
    folder = "/root/testdata/sf0.01"
    pairs = models.pair_spreads(panel.trades_panel(spark, folder)).select("asset1", "asset2").distinct().count()
    assert QUERIES["bt18_pair_positions"](spark, folder).select("asset1", "asset2").distinct().count() == pairs > 3
