"""Metric catalog, pushes, statistics and series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalbed.functions.ordered import previous
from signalbed.functions.quantiles import ranked_values, value_at, value_counts
from signalbed.functions.times import instant, micros

DEFAULT_RESOLUTION = 60
MIN_RESOLUTION, MAX_RESOLUTION = 10, 3600
METRIC_TYPES = ("COUNTER", "GAUGE", "HISTOGRAM", "TIMER")
METRIC_KEY = ("team_id", "name", "service_name")
PERCENTILES = {"p50": 50, "p95": 95, "p99": 99}


def register_metrics(existing: DataFrame, requested: DataFrame, order: str) -> DataFrame:
    """The catalog with new metrics added; the first request of a key wins, known keys stay."""
    key = list(METRIC_KEY)
    fields = [name for name in existing.columns if name not in key]
    new = requested.join(existing.select(*key), key, "left_anti")
    first = new.groupBy(*key).agg(F.min_by(F.struct(*fields), F.col(order)).alias("m")).select(*key, "m.*")
    return existing.unionByName(first)


def push_points(points: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored, rejected): a point is stored when its metric exists in its team."""
    known = catalog.select("metric_id", "team_id")
    stored = points.join(known, ["metric_id", "team_id"], "left_semi").withColumn("resolution", F.lit(DEFAULT_RESOLUTION))
    return stored, points.join(known, ["metric_id", "team_id"], "left_anti")


def push_values(values: DataFrame, catalog: DataFrame, now, order: str) -> tuple[DataFrame, DataFrame]:
    """(catalog, points): single values register their metric when needed and are stored at ``now``."""
    merged = register_metrics(catalog, values.select(*catalog.columns, order), order)
    ids = merged.select("metric_id", *METRIC_KEY)
    points = values.drop("metric_id").join(ids, list(METRIC_KEY)).select(
        "metric_id", instant(now).alias("timestamp"), "value", F.lit(DEFAULT_RESOLUTION).alias("resolution"), order
    )
    return merged, points


def _in_range(series: DataFrame, start, end) -> DataFrame:
    return series.where((F.col("timestamp") >= instant(start)) & (F.col("timestamp") <= instant(end)))


def metric_statistics(series: DataFrame, start, end, catalog: DataFrame | None = None, keys: Sequence[str] = ("metric_id",)) -> DataFrame:
    """Count, sum, mean, range, percentiles and population deviation of every metric.

    With a catalog, a metric without points in the range gets zeros.
    """
    keys = list(keys)
    ranked = ranked_values(value_counts(_in_range(series, start, end), keys, "value"), keys, "value")
    off = F.col("value") - F.col("sum") / F.col("total")
    stats = ranked.groupBy(*keys).agg(
        F.max("total").alias("count"), F.max("sum").alias("sum"), F.max(F.col("sum") / F.col("total")).alias("avg"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.sqrt(F.sum(F.col("n") * off * off) / F.max("total")).alias("stddev"),
        *[value_at("value", p).alias(name) for name, p in PERCENTILES.items()],
    )
    if catalog is not None:
        stats = catalog.select(*keys).join(stats, keys, "left")
    names = ["count", "sum", "avg", "min", "max", *PERCENTILES, "stddev"]
    return stats.select(*keys, *[F.coalesce(name, F.lit(0)).alias(name) for name in names])


def bucket_averages(series: DataFrame, start, end, resolution: int, keys: Sequence[str] = ("metric_id",)) -> DataFrame:
    """Mean per bucket of ``resolution`` seconds counted from ``start``; empty buckets are left out."""
    if not MIN_RESOLUTION <= resolution <= MAX_RESOLUTION:
        raise ValueError("resolution must be between 10 and 3600 seconds")
    first = F.unix_seconds(instant(start))
    slot = F.floor((F.unix_seconds("timestamp") - first) / resolution)
    bucket = F.timestamp_seconds(first + slot * resolution)
    return _in_range(series, start, end).groupBy(*keys, bucket.alias("bucket")).agg(F.avg("value").alias("value"))


def window_aggregates(series: DataFrame, start, end, keys: Sequence[str] = ("metric_id",)) -> DataFrame:
    return _in_range(series, start, end).groupBy(*keys).agg(
        F.avg("value").alias("avg"), F.max("value").alias("max"), F.min("value").alias("min")
    )


def service_summary(catalog: DataFrame) -> DataFrame:
    """Metric count of every (team, service), in all and per type."""
    counts = [F.count_if(F.col("metric_type") == kind).alias(kind.lower()) for kind in METRIC_TYPES]
    return catalog.groupBy("team_id", "service_name").agg(F.count(F.lit(1)).alias("metric_count"), *counts)


def counter_regressions(series: DataFrame, catalog: DataFrame) -> DataFrame:
    """Times at which a counter is lower than at the time before.

    Points of one metric at one microsecond are taken as one: their lowest
    value against the highest of the time before.
    """
    counters = catalog.where(F.col("metric_type") == "COUNTER").select("metric_id")
    times = (
        series.join(counters, "metric_id", "left_semi")
        .groupBy("metric_id", micros(F.col("timestamp")).alias("at"))
        .agg(F.min("value").alias("value"), F.max("value").alias("_high"))
    )
    rows = previous(times, ["metric_id"], "at", ["_high"])
    return rows.where(F.col("value") < F.col("before._high")).select(
        "metric_id", F.timestamp_micros("at").alias("timestamp"), "value", F.col("before._high").alias("previous_value")
    )


def latest_values(series: DataFrame, tie: str, keys: Sequence[str] = ("metric_id",)) -> DataFrame:
    newest = F.max_by(F.struct("timestamp", "value"), F.struct("timestamp", tie))
    return series.groupBy(*keys).agg(newest.alias("p")).select(*keys, "p.timestamp", "p.value")


def latest_by_service(series: DataFrame, catalog: DataFrame, team_id, service_name: str, tie: str) -> DataFrame:
    wanted = catalog.where((F.col("team_id") == F.lit(team_id)) & (F.col("service_name") == service_name))
    return latest_values(series.join(wanted.select("metric_id", "name"), "metric_id"), tie, ["name"])


def time_series(series: DataFrame, start, end) -> DataFrame:
    return _in_range(series, start, end).orderBy("metric_id", "timestamp")


def delete_metrics(catalog: DataFrame, series: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(catalog, series) without the given metrics."""
    ids = gone.select("metric_id").distinct()
    return catalog.join(ids, "metric_id", "left_anti"), series.join(ids, "metric_id", "left_anti")


