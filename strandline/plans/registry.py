"""Registered queries: a Spark function and, where SQL can express it, the DuckDB SQL that must equal it."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources import panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The panel of daily bars per brand, and its returns, as common table expressions.
PX = """px AS (SELECT p.p_brand AS ticker, CAST(l.l_shipdate AS DATE) AS date,
    first(l.l_extendedprice ORDER BY l.l_orderkey, l.l_linenumber, l.l_extendedprice) AS open, max(l.l_extendedprice) AS high, min(l.l_extendedprice) AS low,
    avg(l.l_extendedprice) AS close, sum(l.l_quantity) AS volume
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY p.p_brand, CAST(l.l_shipdate AS DATE))"""
R = PX + """, r AS (SELECT *, close / lag(close) OVER t - 1 AS ret, ln(close / lag(close) OVER t) AS lr, row_number() OVER t AS rn
    FROM px WINDOW t AS (PARTITION BY ticker ORDER BY date))"""


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All floating-point columns rounded, so that results compare by value; -0.0 as 0.0."""
    return df.select(*(_round(f.name, digits) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name) for f in df.schema))


def _round(name: str, digits: int):
    return (F.round(F.col(name), digits) + F.lit(0.0)).alias(name)


def query(name: str, sql: str | None = None, digits: int = 6, ticker: str = "p_brand"):
    """Register a function of the panel with returns; its floating-point columns are rounded."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(panel.returns(panel.trades_panel(spark, sf_dir, ticker))), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def table_query(name: str, sql: str | None = None, digits: int = 6):
    """Register a function of (spark, sf_dir)."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


# -- pieces of SQL ----------------------------------------------------------------------------------------

TICKER = "PARTITION BY ticker ORDER BY date"


def win(n: int) -> str:
    return f"({TICKER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    """An aggregate over the last n rows; ``agg`` holds {x} or is a function's name."""
    call = agg.format(x=x) if "{x}" in agg else f"{agg}({x})"
    return f"CASE WHEN count({x}) OVER {win(n)} >= {n if least is None else least} THEN {call} OVER {win(n)} END"


def rank(x: str, by: str = "date") -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) + (count({x}) OVER (PARTITION BY {by}, {x}) - 1) / 2.0) / count({x}) OVER (PARTITION BY {by}) END"


def lagged(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({TICKER})" if k >= 0 else f"lead({x}, {-k}) OVER ({TICKER})"


def staged(*stages: Mapping[str, str], keep: str, base: str = "r", ctes: str = R, keys: str = "ticker, date", digits: int = 6, where: str = "", raw: str = "") -> str:
    """Stages of named expressions over ``base``; the columns of ``keep`` are rounded, those of ``raw`` not."""
    out, last = "WITH " + ctes, base
    for i, s in enumerate(stages):
        out += f", s{i} AS (SELECT *, " + ", ".join(f"{e} AS {k}" for k, e in s.items()) + f" FROM {last})"
        last = f"s{i}"
    columns = [keys] * bool(keys) + [f"round(CAST({c} AS DOUBLE), {digits}) + 0.0 AS {c}" for c in keep.split()] + raw.split()
    return f"{out} SELECT {', '.join(columns)} FROM {last} {where}"
