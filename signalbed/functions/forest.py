"""Walk from every node of a forest to its root by doubling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.session import cut_lineage


def climb(nodes: DataFrame, keys: Sequence[str], node: str, parent: str) -> DataFrame:
    """(keys, node, top, hops) for every node whose parents lead to a root.

    A root has a null parent. Nodes that hang off a missing parent or a cycle
    are left out. Each round doubles the distance covered, so a chain of a
    million links takes twenty joins. ``nodes`` has one row per (keys, node).
    """
    keys = list(keys)
    is_root = F.col(parent).isNull()
    state = nodes.select(
        *keys,
        F.col(node).alias("node"),
        F.when(is_root, F.col(node)).otherwise(F.col(parent)).alias("top"),
        F.when(is_root, 0).otherwise(1).cast("long").alias("hops"),
        is_root.alias("done"),
    )
    reached = -1
    while True:
        state = cut_lineage(state)
        counts = state.agg(F.count_if("done").alias("done"), F.count_if(~F.col("done")).alias("open")).first()
        if counts["open"] == 0 or counts["done"] == reached:
            return state.where("done").drop("done")
        reached = counts["done"]
        target = state.select(
            *keys, F.col("node").alias("top"), F.col("top").alias("_top"),
            F.col("hops").alias("_hops"), F.col("done").alias("_done"),
        )
        moved = (
            state.where(~F.col("done"))
            .join(target, [*keys, "top"])
            .select(
                *keys, "node", F.col("_top").alias("top"),
                (F.col("hops") + F.col("_hops")).alias("hops"), F.col("_done").alias("done"),
            )
        )
        state = state.where("done").unionByName(moved)
