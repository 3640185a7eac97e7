import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
SOME = ["q0_weekly_momentum", "w3_rolling_moments", "w14_pct_rank", "jn8_pairs", "ag6_daily_spearman", "fe1_momentum", "bt5_rebalanced_long", "gr6_clustering", "w11_ewm", "sg3_threshold_turnover", "ag20_information_ratio", "ss2_kalman_trend", "bt11_stop_loss", "ml9_walk_forward_ridge", "fe18_long_side", "fe23_macd", "bt24_top_softmax", "co1_engle_granger", "ss3_smoothed_level", "snk2_csv_round_trip"]


def test_names_and_flagship(spark):
    assert set(ORACLES) <= set(QUERIES) and len(QUERIES) > 200
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "part"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    want = con.sql(ORACLES[name])
    own = QUERIES[name](spark, FOLDER)
    assert sorted(own.columns) == sorted(want.columns)
    key = lambda row: tuple((x is None, str(x)) for x in row)
    assert sorted(map(tuple, own.select(want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_nothing_else_imports_the_training_data_subpackage():
    from pathlib import Path

    for p in Path(entry.__file__).parent.joinpath("strandline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "strandline.llm" not in p.read_text()
