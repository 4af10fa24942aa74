"""Exact ranks of the values of groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbed.session import cut_lineage


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """How often each value occurs in its group; repeats are combined before the shuffle."""
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def ranked_values(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Value counts with ``rank`` (of the last repeat), and ``total`` and ``sum`` of the group.

    The counts are dealt out by ranges of (keys, value), so a group of any size
    lies in as many slices as its share of the rows asks for. Ranks are a
    running count inside each slice plus the totals of the slices before it.
    The slices are written once: all parts below must see the same ones.
    """
    keys = list(keys)
    rows = cut_lineage(counts.repartitionByRange(*keys, value).withColumn("_slice", F.spark_partition_id()))
    groups = rows.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.col(value)).alias("sum"))
    slices = rows.groupBy(*keys, "_slice").agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(*keys, "_slice", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_past")).join(groups, keys)
    inside = Window.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = rows.withColumn("_inside", F.sum("n").over(inside)).join(slices, [*keys, "_slice"])
    return ranked.select(*keys, value, "n", "total", "sum", (F.col("_inside") + F.col("_past")).alias("rank"))


def value_at(value: str, p: float) -> Column:
    """Aggregate over ranked values: the value at rank ``ceil(p / 100 * total)``."""
    rank = F.least(F.greatest(F.ceil(F.lit(p / 100.0) * F.col("total")), F.lit(1)), F.col("total"))
    return F.min(F.when(F.col("rank") >= rank, F.col(value)))


def ranked_percentiles(counts: DataFrame, keys: Sequence[str], value: str, wanted: Mapping[str, float]) -> DataFrame:
    columns = [value_at(value, p).alias(name) for name, p in wanted.items()]
    return ranked_values(counts, keys, value).groupBy(*keys).agg(*columns)
