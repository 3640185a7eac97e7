"""Connected components of a link table, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import cut


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; component is the smallest node reachable.

    Each round a node takes the smallest label among its neighbours' and its own, then the label of that
    label. Labels only fall, so the rounds end when none has fallen; every round is checkpointed. Hubs do
    no harm: minima are partial aggregates, and joins on a hub's id are plain equi-joins that can be split.
    Nulls link nothing; self links make a node of its own.
    """
    edges = links.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna()
    both = cut(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")).select(F.col("u").alias("node"), "label"))
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        nearer = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        moved = cut(nearer.join(jump, "label", "left").select("node", "old", F.least("label", "further").alias("label")))
        labels = moved.select("node", "label")
        if moved.where("label < old").isEmpty():
            return labels.select("node", F.col("label").alias("component"))
