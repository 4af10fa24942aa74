"""Ordered scans that never put a whole key into one task.

A window over one key runs in one task, and one key may hold a third of all
rows. Each scan here runs in three steps of bounded size: inside one second of
one key, over the seconds of one day, over the days. Callers first reduce their
rows to one per (key, microsecond), so the first step sees at most two million
rows, the second 86 400, the third one per day.

``at`` is always a column of epoch microseconds (bigint).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalbed.functions.times import DAY, SECOND


def _slotted(df: DataFrame, at: str) -> DataFrame:
    return df.withColumn("_second", F.expr(f"{at} div {SECOND}"))


def _per_second(rows: DataFrame, keys: list[str], *columns: Column) -> DataFrame:
    """One row per second, with its day.

    The day is taken from the second, after the grouping: so rows and seconds
    read the same columns and share one shuffle.
    """
    return rows.groupBy(*keys, "_second").agg(*columns).withColumn("_day", F.expr(f"_second div {DAY // SECOND}"))


def _before(keys: Sequence[str], slot: Column) -> Window:
    return Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)


def running_total(df: DataFrame, keys: Sequence[str], at: str, value: str, out: str, tie: Sequence[str] = ()) -> DataFrame:
    """Sum of ``value`` over all rows of the key up to and including each row."""
    keys = list(keys)
    order = [at, *tie]
    rows = _slotted(df, at)
    inside = Window.partitionBy(*keys, "_second").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_inside", F.sum(value).over(inside))
    seconds = _per_second(rows, keys, F.max_by("_inside", F.struct(*order)).alias("_sum"))
    days = seconds.groupBy(*keys, "_day").agg(F.sum("_sum").alias("_sum"))
    days = days.select(
        *keys, "_day", F.coalesce(F.sum("_sum").over(_before(keys, F.col("_day"))), F.lit(0)).alias("_past_days")
    )
    seconds = seconds.select(
        *keys, "_second", "_day",
        F.coalesce(F.sum("_sum").over(_before([*keys, "_day"], F.col("_second"))), F.lit(0)).alias("_past_seconds"),
    )
    past = seconds.join(days, [*keys, "_day"]).select(
        *keys, "_second", (F.col("_past_seconds") + F.col("_past_days")).alias("_past")
    )
    return (
        rows.join(past, [*keys, "_second"])
        .withColumn(out, F.col("_inside") + F.col("_past"))
        .drop("_second", "_inside", "_past")
    )


def neighbours(points: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]) -> DataFrame:
    """Each probe with the last point at or before it and the first at or after it.

    ``points`` has one row per (keys, at). The result has the keys and ``at`` of
    the probes and two structs ``before`` and ``after`` of (at, *payload).
    """
    keys = list(keys)
    point = F.struct(F.col(at), *[F.col(name) for name in payload])
    marked = points.select(*keys, at, F.lit(0).alias("_probe"), point.alias("_point"))
    asked = probes.select(*keys, at, F.lit(1).alias("_probe"), F.lit(None).cast(marked.schema["_point"].dataType).alias("_point"))
    rows = _slotted(marked.unionByName(asked), at)

    cell = Window.partitionBy(*keys, "_second").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn(
        "_prev", F.last("_point", ignorenulls=True).over(cell.orderBy(F.col(at), F.col("_probe")))
    ).withColumn(
        "_next", F.last("_point", ignorenulls=True).over(cell.orderBy(F.col(at).desc(), F.col("_probe")))
    )
    seconds = _per_second(
        rows, keys, F.max_by("_prev", F.struct(F.col(at), F.col("_probe"))).alias("_last"),
        F.max_by("_next", F.struct(-F.col(at), F.col("_probe"))).alias("_first"),
    )
    days = seconds.groupBy(*keys, "_day").agg(F.max("_last").alias("_last"), F.min("_first").alias("_first"))

    def carried(table: DataFrame, by: list[str], slot: str, last: str, first: str) -> DataFrame:
        up, down = _before(by, F.col(slot)), _before(by, F.col(slot).desc())
        return table.withColumn(last, F.last("_last", ignorenulls=True).over(up)).withColumn(
            first, F.last("_first", ignorenulls=True).over(down)
        ).drop("_last", "_first")

    seconds = carried(seconds, [*keys, "_day"], "_second", "_last_second", "_first_second")
    days = carried(days, keys, "_day", "_last_day", "_first_day")
    around = seconds.join(days, [*keys, "_day"]).select(
        *keys, "_second",
        F.coalesce("_last_second", "_last_day").alias("_earlier"),
        F.coalesce("_first_second", "_first_day").alias("_later"),
    )
    return (
        rows.where(F.col("_probe") == 1)
        .join(around, [*keys, "_second"])
        .select(
            *keys, at,
            F.coalesce("_prev", "_earlier").alias("before"),
            F.coalesce("_next", "_later").alias("after"),
        )
    )


def previous(df: DataFrame, keys: Sequence[str], at: str, payload: Sequence[str]) -> DataFrame:
    """Add ``before``, a struct of (at, *payload) of the row before. One row per (keys, at)."""
    keys = list(keys)
    row = F.struct(F.col(at), *[F.col(name) for name in payload])
    rows = _slotted(df.withColumn("_row", row), at)
    rows = rows.withColumn("_lag", F.lag("_row").over(Window.partitionBy(*keys, "_second").orderBy(at)))
    seconds = _per_second(rows, keys, F.max("_row").alias("_last"))
    days = seconds.groupBy(*keys, "_day").agg(F.max("_last").alias("_last"))
    days = days.select(*keys, "_day", F.last("_last").over(_before(keys, F.col("_day"))).alias("_last_day"))
    seconds = seconds.select(
        *keys, "_day", "_second",
        F.last("_last").over(_before([*keys, "_day"], F.col("_second"))).alias("_last_second"),
    )
    earlier = seconds.join(days, [*keys, "_day"]).select(
        *keys, "_second", F.coalesce("_last_second", "_last_day").alias("_earlier")
    )
    return (
        rows.join(earlier, [*keys, "_second"])
        .withColumn("before", F.coalesce("_lag", "_earlier"))
        .drop("_second", "_row", "_lag", "_earlier")
    )
