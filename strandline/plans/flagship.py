"""The flagship query: a weekly book of the strongest fifth by monthly momentum, with costs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.operators import trading as tr
from strandline.operators import windows as w
from strandline.plans.registry import rounded, table_query
from strandline.plans.research import _REB
from strandline.sources import panel


@table_query("q0_weekly_momentum", _REB + ", s AS (SELECT count(*) AS days, avg(gross - turnover * 0.001) AS m, stddev_samp(gross - turnover * 0.001) AS sd, avg(turnover) AS t FROM z) SELECT days, round(CAST(m AS DOUBLE), 6) + 0.0 AS mean_net, round(CAST(m / sd * sqrt(252) AS DOUBLE), 6) + 0.0 AS sharpe, round(CAST(t AS DOUBLE), 6) + 0.0 AS mean_turnover FROM s")
def weekly_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panel.returns(panel.trades_panel(spark, sf_dir)).withColumns({"signal": w.rsum("ret", 21), "fwd": w.lag("ret", -1)})
    d = tr.rebalanced(p, "signal", "fwd")
    return rounded(d.agg(F.count(F.lit(1)).alias("days"), F.avg("net").alias("mean_net"), (F.try_divide(F.avg("net"), F.stddev_samp("net")) * F.sqrt(F.lit(252.0))).alias("sharpe"), F.avg("turnover").alias("mean_turnover")))
