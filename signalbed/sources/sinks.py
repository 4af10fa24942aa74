"""Appending facts by day, and the query history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbed.functions.times import instant, utc_day


def append_by_day(rows: DataFrame, folder: str, by: str = "timestamp", sort: tuple[str, ...] = ()) -> None:
    """Append, one directory per UTC day. Sorting inside the files makes min/max skipping work."""
    dated = rows.withColumn("day", utc_day(F.col(by)))
    if sort:
        dated = dated.sortWithinPartitions("day", *sort)
    dated.write.mode("append").partitionBy("day").parquet(folder)


def read_days(spark: SparkSession, folder: str, start=None, end=None, by: str = "timestamp") -> DataFrame:
    """Rows of an inclusive time range; the day test next to it prunes directories."""
    rows = spark.read.parquet(folder)
    if start is not None:
        rows = rows.where((F.col("day") >= utc_day(instant(start))) & (F.col(by) >= instant(start)))
    if end is not None:
        rows = rows.where((F.col("day") <= utc_day(instant(end))) & (F.col(by) <= instant(end)))
    return rows


def append_query_history(spark: SparkSession, folder: str, *, query_id: str, query: str, result_count: int,
                         execution_time_ms: int, team_id: str, created_by: str, created_at) -> None:
    row = spark.range(1).select(
        F.lit(query_id).alias("query_id"), F.lit(query).alias("query"), F.lit(result_count).cast("long").alias("result_count"),
        F.lit(execution_time_ms).cast("long").alias("execution_time_ms"), F.lit(team_id).alias("team_id"),
        F.lit(created_by).alias("created_by"), instant(created_at).alias("created_at"),
    )
    row.write.mode("append").parquet(folder)


def append_query_runs(runs: DataFrame, folder: str) -> None:
    """Append many finished queries at once, by the day they ran: a file per task and day, not one per query."""
    append_by_day(runs.repartition("query_id"), folder, by="created_at", sort=("created_at",))
