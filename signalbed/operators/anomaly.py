"""Hourly series, baselines and deviation checks for all services at once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbed.functions.times import HOUR, SECOND, instant, micros
from signalbed.sources.folders import children

LOG_VOLUME, ERROR_RATE = "log_volume", "error_rate"
DEFAULT_WINDOW_HOURS = 168
DEFAULT_THRESHOLD = 2.0
MIN_POINTS = 24
MIN_DEVIATION = 0.001
SERVICE = ("team_id", "service_name")


def _utc(value: str | dt.datetime) -> dt.datetime:
    moment = dt.datetime.fromisoformat(value) if isinstance(value, str) else value
    return moment if moment.tzinfo else moment.replace(tzinfo=dt.timezone.utc)


def _hours(start, end) -> int:
    return max(0, -((_utc(start) - _utc(end)) // dt.timedelta(hours=1)))


def hourly(rows: DataFrame, start, end) -> DataFrame:
    """Rows of the window with their ``hour`` number.

    Hours count from ``start`` and include both ends, so a row on an edge is in
    two hours. The last hour may reach past ``end``.
    """
    n = _hours(start, end)
    first = _utc(start)
    since = micros(F.col("timestamp")) - micros(instant(first))
    near = rows.where((F.col("timestamp") >= instant(first)) & (F.col("timestamp") <= instant(first + dt.timedelta(hours=n))))
    near = near.withColumn("_since", since)
    own = F.expr(f"CAST(_since div {HOUR} AS INT)")
    hours = F.when(F.col("_since") % HOUR == 0, F.array(own - 1, own)).otherwise(F.array(own))
    return near.withColumn("hour", F.explode(hours)).where(F.col("hour").between(0, n - 1)).drop("_since")


def with_empty_hours(counts: DataFrame, keys: DataFrame, start, end) -> DataFrame:
    """Every key with every hour of the window; hours without rows have nulls."""
    n = _hours(start, end)
    names = keys.columns
    if n == 0:
        return keys.withColumn("hour", F.lit(0)).join(counts, [*names, "hour"], "left").where(F.lit(False))
    grid = keys.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return grid.join(counts, [*names, "hour"], "left")


def hourly_log_series(entries: DataFrame, start, end, services: DataFrame | None = None) -> DataFrame:
    """(team, service, metric_name, hour, value) of log volume and error rate, gaps as zero."""
    counts = hourly(entries.select(*SERVICE, "timestamp", "level"), start, end).groupBy(*SERVICE, "hour").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("level").isin("ERROR", "FATAL")).alias("errors")
    )
    keys = services if services is not None else entries.select(*SERVICE)
    full = with_empty_hours(counts, keys.select(*SERVICE).distinct(), start, end)
    return _log_values(full)


def log_states(entries: DataFrame) -> DataFrame:
    """(team, service, minute, total, errors, edge_total, edge_errors): counts of each minute that has entries.

    States of the same minute add up, so they may come from any cut of the
    entries. The ``edge_`` counts are of the minute's first microsecond alone:
    an hour includes both its ends.
    """
    failed = F.col("level").isin("ERROR", "FATAL")
    edge = F.unix_micros("timestamp") % (60 * SECOND) == 0
    return entries.groupBy(*SERVICE, F.expr(f"unix_micros(timestamp) div {60 * SECOND}").alias("minute")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(failed).alias("errors"),
        F.count_if(edge).alias("edge_total"), F.count_if(edge & failed).alias("edge_errors"))


def roll_up(spark: SparkSession, folder: str, entries: DataFrame, upto) -> DataFrame:
    """Bring the states below ``folder`` up to ``upto`` (exclusive) and return them all.

    Only entries of the days from the last finished one on are read: those days
    are counted anew and replaced as a whole, so a roll-up that failed or ran
    twice is made good by the next. Entries later than a finished day are left
    out unless their day is given to :func:`log_states` again.
    """
    end = instant(_utc(upto))
    rows = entries.where(F.col("timestamp") < end)
    if children(spark, folder):
        newest = spark.read.parquet(folder).agg(F.max("day")).first()[0]
        rows = rows.where(F.col("timestamp") >= instant(_utc(dt.datetime.combine(newest, dt.time()))))
    states = log_states(rows).withColumn("day", F.to_date(F.timestamp_seconds(F.col("minute") * 60)))
    states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(folder)
    return spark.read.parquet(folder)


def rolled_log_series(states: DataFrame, start, end) -> DataFrame:
    """:func:`hourly_log_series` from :func:`log_states`; ``start`` must be a whole minute.

    The services are those of all states, a small table next to the entries.
    """
    n, first = _hours(start, end), _utc(start)
    if first.second or first.microsecond:
        raise ValueError("the window must start at a whole minute")
    zero = int(first.timestamp()) // 60
    near = states.where((F.col("minute") >= zero) & (F.col("minute") <= zero + 60 * n)).withColumn("_since", F.col("minute") - zero)
    if "day" in states.columns:  # the days are the folders: others are not read
        near = near.where((F.col("day") >= first.date()) & (F.col("day") <= (first + dt.timedelta(hours=n)).date()))
    hour = F.expr("CAST(_since div 60 AS INT)")
    # The first moment of an hour is in the hour before it too.
    parts = F.array(F.struct(hour.alias("hour"), "total", "errors"), F.struct(
        (hour - 1).alias("hour"), F.when(F.col("_since") % 60 == 0, F.col("edge_total")).otherwise(0).alias("total"),
        F.when(F.col("_since") % 60 == 0, F.col("edge_errors")).otherwise(0).alias("errors")))
    counts = near.select(*SERVICE, F.explode(parts).alias("p")).where(F.col("p.hour").between(0, n - 1)).groupBy(*SERVICE, "p.hour").agg(
        F.sum("p.total").alias("total"), F.sum("p.errors").alias("errors"))
    return _log_values(with_empty_hours(counts, states.select(*SERVICE).distinct(), start, end))


def _log_values(full: DataFrame) -> DataFrame:
    """Log volume and error rate of hours with ``total`` and ``errors``; empty hours are zero."""
    volume = F.coalesce("total", F.lit(0)).cast("double")
    rate = F.when(F.col("total") > 0, F.col("errors") * 100.0 / F.col("total")).otherwise(0.0)
    pairs = F.array(
        F.struct(F.lit(LOG_VOLUME).alias("metric_name"), volume.alias("value")),
        F.struct(F.lit(ERROR_RATE).alias("metric_name"), rate.alias("value")),
    )
    return full.select(*SERVICE, "hour", F.explode(pairs).alias("p")).select(*SERVICE, "p.metric_name", "hour", "p.value")


def _named_points(series: DataFrame, catalog: DataFrame) -> DataFrame:
    names = catalog.select("metric_id", *SERVICE, F.col("name").alias("metric_name"))
    return series.select("metric_id", "timestamp", "value").join(names, "metric_id")


def hourly_metric_series(series: DataFrame, catalog: DataFrame, start, end) -> DataFrame:
    """Mean per hour of every metric of the catalog; an hour without points is 0."""
    key = [*SERVICE, "metric_name"]
    points = hourly(_named_points(series, catalog), start, end)
    means = points.groupBy(*key, "hour").agg(F.avg("value").alias("value"))
    keys = catalog.select(*SERVICE, F.col("name").alias("metric_name")).distinct()
    full = with_empty_hours(means, keys, start, end)
    return full.select(*key, "hour", F.coalesce("value", F.lit(0.0)).alias("value"))


def baseline_statistics(hours: DataFrame) -> DataFrame:
    """Mean, deviation and number of hourly values; too few hours give no row."""
    key = [*SERVICE, "metric_name"]
    sd = F.stddev_pop("value")
    return hours.groupBy(*key).agg(
        F.avg("value").alias("baseline_value"),
        F.when(sd == 0, MIN_DEVIATION).otherwise(sd).alias("standard_deviation"),
        F.count("value").alias("sample_count"),
    ).where(F.col("sample_count") >= MIN_POINTS)


def learn_baselines(hours: DataFrame, start, end, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    return baseline_statistics(hours).withColumns({
        "window_start_time": instant(_utc(start)), "window_end_time": instant(_utc(end)),
        "deviation_threshold": F.lit(float(threshold)), "is_active": F.lit(True),
    })


_LEARNED = ("baseline_value", "standard_deviation", "sample_count", "window_start_time", "window_end_time")


def learn_changed_baselines(
    changes: DataFrame, entries: DataFrame, series: DataFrame, catalog: DataFrame, end, threshold: float = DEFAULT_THRESHOLD
) -> DataFrame:
    """Baselines of the changes that name a window, each from its own ``window_hours`` up to ``end``.

    All windows end together and last whole hours, so they share their hours:
    these are counted once, back from the end, over the longest window (which
    bounds the scans), for the services that are asked for. A change then meets
    the hours of its own window.
    """
    key = [*SERVICE, "metric_name"]
    asked = changes.where("window_hours > 0").groupBy(*key).agg(F.max("window_hours").cast("int").alias("window_hours"))
    longest = asked.agg(F.max("window_hours")).first()[0] or 0
    start = _utc(end) - dt.timedelta(hours=longest)
    back = (F.lit(longest - 1) - F.col("hour")).alias("back")
    services = asked.select(*SERVICE).distinct()
    logs = hourly(entries.select(*SERVICE, "timestamp", "level").join(services, list(SERVICE), "left_semi"), start, end)
    logs = logs.groupBy(*SERVICE, "hour").agg(
        F.count(F.lit(1)).cast("double").alias("volume"),
        (F.count_if(F.col("level").isin("ERROR", "FATAL")) * 100.0 / F.count(F.lit(1))).alias("rate"))
    pairs = F.array(F.struct(F.lit(LOG_VOLUME).alias("metric_name"), F.col("volume").alias("value")),
                    F.struct(F.lit(ERROR_RATE).alias("metric_name"), F.col("rate").alias("value")))
    logs = logs.select(*SERVICE, back, F.explode(pairs).alias("p")).select(*SERVICE, "p.metric_name", "back", "p.value")
    wanted = catalog.join(asked.select(*SERVICE, F.col("metric_name").alias("name")), [*SERVICE, "name"], "left_semi")
    points = hourly(_named_points(series, wanted), start, end).groupBy(*key, "hour").agg(F.avg("value").alias("value"))
    found = logs.unionByName(points.select(*key, back, "value"))
    known = wanted.select(*SERVICE, F.col("name").alias("metric_name")).unionByName(
        asked.where(F.col("metric_name").isin(LOG_VOLUME, ERROR_RATE)).select(*key)).distinct()
    grid = asked.join(known, key, "left_semi").withColumn("back", F.explode(F.sequence(F.lit(0), F.col("window_hours") - 1)))
    hours = grid.join(found, [*key, "back"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
    learned = baseline_statistics(hours).join(asked, key)
    return learned.withColumns({
        "window_start_time": instant(_utc(end)) - F.make_dt_interval(hours=F.col("window_hours")), "window_end_time": instant(_utc(end)),
        "deviation_threshold": F.lit(float(threshold)), "is_active": F.lit(True),
    }).drop("window_hours")


def recalculate_baselines(existing: DataFrame, learned: DataFrame) -> DataFrame:
    """Known baselines with fresh numbers; the old ones stay where nothing was learned."""
    key = [*SERVICE, "metric_name"]
    fresh = learned.select(*key, *[F.col(name).alias(f"_{name}") for name in _LEARNED])
    rows = existing.join(fresh, key, "left")
    return rows.select(*[
        F.coalesce(f"_{name}", name).alias(name) if name in _LEARNED else F.col(name) for name in existing.columns
    ])


def upsert_baselines(existing: DataFrame, learned: DataFrame) -> DataFrame:
    """Learned baselines replace or extend the known ones; ``is_active`` of a known one stays."""
    key = [*SERVICE, "metric_name"]
    new = learned.select(*key, F.struct(*[name for name in existing.columns if name not in key]).alias("_new"))
    rows = existing.join(new, key, "full")
    fields = [name for name in existing.columns if name not in key]
    return rows.select(*key, *[
        F.coalesce(F.col(name), F.col(f"_new.{name}")).alias(name) if name == "is_active"
        else F.coalesce(F.col(f"_new.{name}"), F.col(name)).alias(name) for name in fields
    ])


def update_baselines(existing: DataFrame, changes: DataFrame, learned: DataFrame | None = None) -> DataFrame:
    """Apply threshold and active changes; take fresh numbers where a change asks for a window.

    :func:`learn_changed_baselines` learns each from the window its change names.
    """
    key = [*SERVICE, "metric_name"]
    asked = changes.select(*key, F.col("deviation_threshold").alias("_threshold"), F.col("is_active").alias("_active"),
                           F.col("window_hours").alias("_window"))
    rows = existing.join(asked, key, "left").withColumns({
        "deviation_threshold": F.coalesce("_threshold", "deviation_threshold"),
        "is_active": F.coalesce("_active", "is_active"),
    })
    if learned is not None:
        fresh = learned.select(*key, *[F.col(name).alias(f"_{name}") for name in _LEARNED])
        rows = rows.join(fresh, key, "left").withColumns({
            name: F.when(F.col("_window").isNotNull(), F.coalesce(f"_{name}", name)).otherwise(F.col(name)) for name in _LEARNED
        })
    return rows.select(*existing.columns)


def current_values(entries: DataFrame, series: DataFrame, catalog: DataFrame, as_of) -> DataFrame:
    """Values of the hour up to ``as_of``: log volume, error rate and metric means."""
    end = _utc(as_of)
    recent = (F.col("timestamp") >= instant(end - dt.timedelta(hours=1))) & (F.col("timestamp") <= instant(end))
    logs = entries.where(recent).groupBy(*SERVICE).agg(
        F.count(F.lit(1)).cast("double").alias("volume"),
        (F.count_if(F.col("level").isin("ERROR", "FATAL")) * 100.0 / F.count(F.lit(1))).alias("rate"),
    )
    pairs = F.array(
        F.struct(F.lit(LOG_VOLUME).alias("metric_name"), F.col("volume").alias("current_value")),
        F.struct(F.lit(ERROR_RATE).alias("metric_name"), F.col("rate").alias("current_value")),
    )
    logs = logs.select(*SERVICE, F.explode(pairs).alias("p")).select(*SERVICE, "p.*")
    points = _named_points(series.where(recent), catalog)
    means = points.groupBy(*SERVICE, "metric_name").agg(F.avg("value").alias("current_value"))
    return logs.unionByName(means)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(deviation > 0, F.abs(value - mean) / deviation).otherwise(0.0)


def direction(value: Column, mean: Column) -> Column:
    return F.when(value > mean, "ABOVE").when(value < mean, "BELOW").otherwise("NORMAL")


def anomaly_checks(baselines: DataFrame, current: DataFrame) -> DataFrame:
    """Every active baseline against its current value; no value counts as 0."""
    key = [*SERVICE, "metric_name"]
    rows = baselines.where("is_active").join(current, key, "left")
    value = F.coalesce("current_value", F.lit(0.0))
    z = z_score(value, F.col("baseline_value"), F.col("standard_deviation"))
    return rows.select(
        *key, value.alias("current_value"), "baseline_value", "standard_deviation", "deviation_threshold",
        z.alias("z_score"), (z > F.col("deviation_threshold")).alias("is_anomaly"),
        direction(value, F.col("baseline_value")).alias("direction"),
    )


def anomaly_report(checks: DataFrame) -> DataFrame:
    return checks.groupBy("team_id").agg(
        F.count(F.lit(1)).alias("total_baselines"), F.count_if("is_anomaly").alias("anomalies_detected")
    )
