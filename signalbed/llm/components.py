"""Connected components of links between ids, as joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every id in ``links`` (``a b``, bigint), the smallest id reachable, itself included.

    Every round takes the smallest label among the neighbours and then the
    label's own label. Both sides of each join are written tables, so that
    adaptive execution can split a label or a node with very many rows.
    """
    ends = links.select("a", "b").unionByName(links.selectExpr("b AS a", "a AS b"))
    ends = cut_lineage(ends.unionByName(ends.selectExpr("a", "a AS b")).distinct())
    labels = cut_lineage(ends.where("a = b").selectExpr("a AS node", "a AS component"))
    while True:
        near = cut_lineage(
            ends.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("component"))
            .withColumnRenamed("a", "node")
        )
        further = cut_lineage(
            near.join(near.selectExpr("node AS component", "component AS next"), "component").select("node", F.col("next").alias("component"))
        )
        changed = further.join(labels.withColumnRenamed("component", "before"), "node").where("component < before")
        if changed.isEmpty():
            return labels
        labels = further
