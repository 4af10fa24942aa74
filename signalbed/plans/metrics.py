"""Metric catalog, statistics and series."""

from pyspark.sql import functions as F

from signalbed.functions.quantiles import ranked_percentiles, value_counts
from signalbed.operators import metrics as m
from signalbed.plans.registry import query, using
from signalbed.sources import tables as t
from signalbed.streaming import jobs

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
RANGE = f"timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'"


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


def _known(spark, folder):
    return t.metrics(spark, folder).where("metric_type = 'COUNTER'")


@query("a06_metric_push", using("points metrics", """
    SELECT p.metric_id, p.value, p.timestamp, 60 AS resolution FROM points p JOIN metrics m ON p.metric_id = m.metric_id
    WHERE m.metric_type = 'COUNTER' AND m.team_id = CASE WHEN p.point_id % 9 = 0 THEN 9 ELSE p.team_id END"""))
def metric_push(spark, folder):
    points = t.metric_points(spark, folder).withColumn("team_id", F.when(F.col("point_id") % 9 == 0, 9).otherwise(F.col("team_id")))
    stored, _ = m.push_points(points, _known(spark, folder))
    return stored.select("metric_id", "value", "timestamp", "resolution")


@query("a06_metric_push_rejects", using("points metrics", """
    SELECT p.point_id, p.metric_id FROM points p WHERE p.point_id % 9 = 0
      OR p.metric_id NOT IN (SELECT metric_id FROM metrics WHERE metric_type = 'COUNTER')"""))
def metric_push_rejects(spark, folder):
    points = t.metric_points(spark, folder).withColumn("team_id", F.when(F.col("point_id") % 9 == 0, 9).otherwise(F.col("team_id")))
    _, rejected = m.push_points(points, _known(spark, folder))
    return rejected.select("point_id", "metric_id")


@query("a07_push_values", using("points", """
    SELECT metric_id, TIMESTAMP '2024-02-01' AS timestamp, value, 60 AS resolution, point_id FROM points"""))
def push_values(spark, folder):
    values = t.metric_points(spark, folder).select("metric_id", "team_id", "service_name", "name", "metric_type", "value", "point_id")
    _, points = m.push_values(values, _known(spark, folder), "2024-02-01", "point_id")
    return points


@query("a08_register_metrics", using("points", """
    SELECT team_id, service_name, name, CASE WHEN metric_type = 'COUNTER' THEN metric_id ELSE concat(metric_id, '#', first) END AS metric_id
    FROM (SELECT team_id, service_name, name, metric_type, metric_id, min(point_id) AS first FROM points GROUP BY ALL)"""))
def register_metrics(spark, folder):
    asked = t.metric_points(spark, folder).withColumn("metric_id", F.concat("metric_id", F.lit("#"), "point_id"))
    merged = m.register_metrics(_known(spark, folder), asked.select(*_known(spark, folder).columns, "point_id"), "point_id")
    return merged.select("team_id", "service_name", "name", "metric_id")


@query("b21_delete_metrics", using("points", "SELECT metric_id, point_id FROM points WHERE metric_type <> 'GAUGE'"))
def delete_metrics(spark, folder):
    gone = t.metrics(spark, folder).where("metric_type = 'GAUGE'")
    _, series = m.delete_metrics(t.metrics(spark, folder), t.metric_series(spark, folder), gone)
    return series.select("metric_id", "point_id")


STATISTICS_SQL = f"""
    SELECT m.metric_id, coalesce(s.n, 0) AS count, coalesce(s.sum, 0) AS sum, coalesce(s.avg, 0) AS avg, coalesce(s.min, 0) AS min,
      coalesce(s.max, 0) AS max, coalesce(s.p50, 0) AS p50, coalesce(s.p95, 0) AS p95, coalesce(s.p99, 0) AS p99,
      coalesce(s.stddev, 0) AS stddev
    FROM metrics m LEFT JOIN (
      SELECT metric_id, count(*) AS n, round(sum(value), 6) AS sum, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
        min(value) FILTER (rank >= ceil(CAST(0.5 AS DOUBLE) * total)) AS p50, min(value) FILTER (rank >= ceil(CAST(0.95 AS DOUBLE) * total)) AS p95,
        min(value) FILTER (rank >= ceil(CAST(0.99 AS DOUBLE) * total)) AS p99, round(stddev_pop(value), 6) AS stddev
      FROM (SELECT *, row_number() OVER (PARTITION BY metric_id ORDER BY value) AS rank, count(*) OVER (PARTITION BY metric_id) AS total
        FROM points WHERE {RANGE}) GROUP BY metric_id) s ON m.metric_id = s.metric_id"""


@query("e01_metric_statistics", using("points metrics", STATISTICS_SQL))
def metric_statistics(spark, folder):
    stats = m.metric_statistics(t.metric_series(spark, folder), START, END, t.metrics(spark, folder))
    return _rounded(stats, "sum", "avg", "stddev")


@query("e02_percentiles", using("points", """
    SELECT name, min(value) FILTER (rank >= ceil(CAST(0.5 AS DOUBLE) * total)) AS p50, min(value) FILTER (rank >= ceil(CAST(0.95 AS DOUBLE) * total)) AS p95,
      min(value) FILTER (rank >= ceil(CAST(0.99 AS DOUBLE) * total)) AS p99, min(value) AS p0, max(value) AS p100
    FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY value) AS rank, count(*) OVER (PARTITION BY name) AS total FROM points)
    GROUP BY name"""))
def percentiles(spark, folder):
    counts = value_counts(t.metric_points(spark, folder), ["name"], "value")
    return ranked_percentiles(counts, ["name"], "value", {"p50": 50, "p95": 95, "p99": 99, "p0": 0, "p100": 100})


@query("e03_deviation", using("points", """
    SELECT service_name, round(stddev_pop(value), 6) AS stddev FROM points GROUP BY service_name"""))
def deviation(spark, folder):
    rows = t.metric_points(spark, folder).groupBy("service_name").agg(F.stddev_pop("value").alias("stddev"))
    return _rounded(rows, "stddev")


@query("e04_bucket_averages", using("points", f"""
    SELECT metric_id, TIMESTAMP '{START}' + to_seconds(slot * 3600) AS bucket, round(avg(value), 6) AS value
    FROM (SELECT *, (epoch_us(timestamp) // 1000000 - epoch_us(TIMESTAMP '{START}') // 1000000) // 3600 AS slot FROM points WHERE {RANGE})
    GROUP BY ALL"""))
def bucket_averages(spark, folder):
    return _rounded(m.bucket_averages(t.metric_series(spark, folder), START, END, 3600), "value")


@query("e05_window_aggregates", using("points", f"""
    SELECT metric_id, round(avg(value), 6) AS avg, max(value) AS max, min(value) AS min FROM points WHERE {RANGE} GROUP BY metric_id"""))
def window_aggregates(spark, folder):
    return _rounded(m.window_aggregates(t.metric_series(spark, folder), START, END), "avg")


@query("e09_service_summary", using("points metrics", """
    SELECT team_id, service_name, count(*) AS metric_count, count(*) FILTER (metric_type = 'COUNTER') AS counter,
      count(*) FILTER (metric_type = 'GAUGE') AS gauge, count(*) FILTER (metric_type = 'HISTOGRAM') AS histogram,
      count(*) FILTER (metric_type = 'TIMER') AS timer FROM metrics GROUP BY ALL"""))
def service_summary(spark, folder):
    return m.service_summary(t.metrics(spark, folder))


@query("f05_counter_regressions", using("points", """
    SELECT metric_id, timestamp, value, previous_value FROM (
      SELECT *, lag(high) OVER (PARTITION BY metric_id ORDER BY timestamp) AS previous_value FROM (
        SELECT metric_id, timestamp, min(value) AS value, max(value) AS high FROM points WHERE metric_type = 'COUNTER' GROUP BY ALL))
    WHERE value < previous_value"""))
def counter_regressions(spark, folder):
    return m.counter_regressions(t.metric_series(spark, folder), t.metrics(spark, folder))


@query("f06_latest_values", using("points", """
    SELECT metric_id, timestamp, value FROM points
    QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY timestamp DESC, point_id DESC) = 1"""))
def latest_values(spark, folder):
    return m.latest_values(t.metric_series(spark, folder), "point_id")


@query("f06_latest_by_service", using("points", """
    SELECT name, timestamp, value FROM points WHERE team_id = 2 AND service_name = 'svc-3'
    QUALIFY row_number() OVER (PARTITION BY metric_id ORDER BY timestamp DESC, point_id DESC) = 1"""))
def latest_by_service(spark, folder):
    return m.latest_by_service(t.metric_series(spark, folder), t.metrics(spark, folder), 2, "svc-3", "point_id")


@query("g05_time_series", using("points", f"SELECT metric_id, timestamp, value FROM points WHERE {RANGE}"))
def time_series(spark, folder):
    return m.time_series(t.metric_series(spark, folder), START, END).select("metric_id", "timestamp", "value")


@query("i06_metric_rollup", using("points", """
    SELECT metric_id, time_bucket(INTERVAL 60 SECONDS, timestamp) AS bucket, round(avg(value), 6) AS value, count(*) AS n,
      min(value) AS min, max(value) AS max FROM points GROUP BY ALL"""))
def metric_rollup(spark, folder):
    return _rounded(jobs.metric_rollup(t.metric_series(spark, folder)), "value")
