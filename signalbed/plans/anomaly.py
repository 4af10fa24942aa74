"""Hourly series, baselines, checks."""

import uuid

from pyspark.sql import functions as F

from signalbed.operators import anomaly as a
from signalbed.plans.registry import query, using
from signalbed.session import shared_folder
from signalbed.sources import tables as t

START, END, HALF = "2024-01-23 23:30:00", "2024-01-30 23:30:00", "2024-01-30 23:30:00"
HOURS = f"""
    SELECT h AS hour, TIMESTAMP '{START}' + to_hours(h) AS lo, TIMESTAMP '{START}' + to_hours(h + 1) AS hi
    FROM (SELECT CAST(range AS INT) AS h FROM range(168))"""
LOG_HOURS = """
    SELECT k.team_id, k.service_name, h.hour, count(l.id) AS total, count(l.id) FILTER (l.level IN ('ERROR', 'FATAL')) AS errors
    FROM (SELECT DISTINCT team_id, service_name FROM log_entries) k CROSS JOIN hours h
    LEFT JOIN log_entries l ON l.team_id = k.team_id AND l.service_name = k.service_name AND l.timestamp BETWEEN h.lo AND h.hi
    GROUP BY ALL"""
METRIC_HOURS = """
    SELECT m.team_id, m.service_name, m.name AS metric_name, h.hour, coalesce(avg(p.value), 0.0) AS value
    FROM metrics m CROSS JOIN hours h LEFT JOIN points p ON p.metric_id = m.metric_id AND p.timestamp BETWEEN h.lo AND h.hi GROUP BY ALL"""
SERIES = """
    SELECT team_id, service_name, 'log_volume' AS metric_name, hour, CAST(total AS DOUBLE) AS value FROM log_hours
    UNION ALL SELECT team_id, service_name, 'error_rate', hour, CASE WHEN total = 0 THEN 0.0 ELSE errors * 100.0::DOUBLE / total END FROM log_hours
    UNION ALL SELECT * FROM metric_hours"""
BASELINES = """
    SELECT team_id, service_name, metric_name, avg(value) AS baseline_value,
      CASE WHEN stddev_pop(value) = 0 THEN 0.001 ELSE stddev_pop(value) END AS standard_deviation, count(*) AS sample_count
    FROM series GROUP BY ALL HAVING count(*) >= 24"""
RECENT = "timestamp BETWEEN TIMESTAMP '2024-01-30 22:30:00' AND TIMESTAMP '2024-01-30 23:30:00'"
CURRENT = f"""
    SELECT team_id, service_name, 'log_volume' AS metric_name, CAST(count(*) AS DOUBLE) AS current_value FROM log_entries WHERE {RECENT} GROUP BY ALL
    UNION ALL SELECT team_id, service_name, 'error_rate', count(*) FILTER (level IN ('ERROR', 'FATAL')) * 100.0::DOUBLE / count(*)
      FROM log_entries WHERE {RECENT} GROUP BY ALL
    UNION ALL SELECT team_id, service_name, name, avg(value) FROM points WHERE {RECENT} GROUP BY ALL"""
CHECKS = """
    SELECT b.team_id, b.service_name, b.metric_name, coalesce(c.current_value, 0) AS current_value, b.baseline_value, b.standard_deviation,
      CAST(2.0 AS DOUBLE) AS deviation_threshold, abs(coalesce(c.current_value, 0) - b.baseline_value) / b.standard_deviation AS z_score
    FROM baselines b LEFT JOIN current_values c ON b.team_id = c.team_id AND b.service_name = c.service_name AND b.metric_name = c.metric_name"""
ALL = {
    "hours": HOURS, "log_hours": LOG_HOURS, "metric_hours": METRIC_HOURS, "series": SERIES, "baselines": BASELINES,
    "current_values": CURRENT, "checks": CHECKS,
}


def _sql(body: str) -> str:
    return using("log_entries points metrics", body, **ALL)


def _series(spark, folder, start=START, end=END):
    logs = a.hourly_log_series(t.log_entries(spark, folder), start, end)
    points = a.hourly_metric_series(t.metric_series(spark, folder), t.metrics(spark, folder), start, end)
    return logs.unionByName(points)


def _rounded(df, *names):
    return df.withColumns({name: F.round(name, 6) for name in names})


@query("e15_hourly_log_volume", _sql("SELECT team_id, service_name, hour, CAST(total AS DOUBLE) AS value FROM log_hours"))
def hourly_log_volume(spark, folder):
    rows = a.hourly_log_series(t.log_entries(spark, folder), START, END).where("metric_name = 'log_volume'")
    return rows.select("team_id", "service_name", "hour", "value")


@query("e16_hourly_error_rate", _sql("""
    SELECT team_id, service_name, hour, round(value, 6) AS value FROM series WHERE metric_name = 'error_rate'"""))
def hourly_error_rate(spark, folder):
    rows = a.hourly_log_series(t.log_entries(spark, folder), START, END).where("metric_name = 'error_rate'")
    return _rounded(rows.select("team_id", "service_name", "hour", "value"), "value")


@query("e15_e16_rolled_up", _sql("""
    SELECT team_id, service_name, metric_name, hour, round(value, 6) AS value FROM series WHERE metric_name IN ('log_volume', 'error_rate')"""))
def rolled_up(spark, folder):
    """Hourly values from states that were rolled up in three steps, the second one twice."""
    entries, place = t.log_entries(spark, folder), f"{shared_folder(spark)}/states-{uuid.uuid4()}"
    for upto in ("2024-01-11 12:00:00", "2024-01-26 07:30:00", "2024-01-26 07:30:00", "2024-02-01"):
        states = a.roll_up(spark, place, entries, upto)
    return _rounded(a.rolled_log_series(states, START, END), "value")


@query("e17_c12_hourly_metric", _sql("SELECT team_id, service_name, metric_name, hour, round(value, 6) AS value FROM metric_hours"))
def hourly_metric(spark, folder):
    rows = a.hourly_metric_series(t.metric_series(spark, folder), t.metrics(spark, folder), START, END)
    return _rounded(rows, "value")


@query("e18_baseline_statistics", _sql("""
    SELECT team_id, service_name, metric_name, round(baseline_value, 6) AS baseline_value, round(standard_deviation, 6) AS standard_deviation,
      sample_count FROM baselines"""))
def baseline_statistics(spark, folder):
    return _rounded(a.baseline_statistics(_series(spark, folder)), "baseline_value", "standard_deviation")


def _known(spark, folder):
    """Baselines from an earlier run: the log ones, and one for a service that is gone."""
    rows = a.hourly_log_series(t.log_entries(spark, folder), "2024-01-02", "2024-01-09")
    known = a.learn_baselines(rows, "2024-01-02", "2024-01-09", threshold=3.0)
    gone = known.where("metric_name = 'log_volume'").withColumn("service_name", F.concat("service_name", F.lit("-gone")))
    return known.unionByName(gone)


@query("e19_recalculated_baselines", _sql("""
    SELECT team_id, service_name, metric_name, round(baseline_value, 6) AS baseline_value, sample_count, CAST(3.0 AS DOUBLE) AS deviation_threshold,
      TIMESTAMP '2024-01-23 23:30:00' AS window_start_time FROM baselines WHERE metric_name IN ('log_volume', 'error_rate')
    UNION ALL SELECT k.team_id, concat(k.service_name, '-gone'), 'log_volume', round(avg(k.n), 6), count(*), CAST(3.0 AS DOUBLE), TIMESTAMP '2024-01-02'
    FROM (SELECT s.team_id, s.service_name, h.range, count(l.id) AS n FROM (SELECT DISTINCT team_id, service_name FROM log_entries) s
      CROSS JOIN range(168) h LEFT JOIN log_entries l ON l.team_id = s.team_id AND l.service_name = s.service_name
        AND l.timestamp BETWEEN TIMESTAMP '2024-01-02' + to_hours(CAST(h.range AS INT)) AND TIMESTAMP '2024-01-02' + to_hours(CAST(h.range + 1 AS INT))
      GROUP BY ALL) k GROUP BY k.team_id, k.service_name"""))
def recalculated_baselines(spark, folder):
    learned = a.learn_baselines(_series(spark, folder), START, END)
    rows = a.recalculate_baselines(_known(spark, folder), learned)
    return _rounded(rows, "baseline_value").select(
        "team_id", "service_name", "metric_name", "baseline_value", "sample_count", "deviation_threshold", "window_start_time")


GONE = """
    SELECT k.team_id, concat(k.service_name, '-gone') AS service_name, 'log_volume' AS metric_name, k.baseline_value, k.sample_count
    FROM known k WHERE k.metric_name = 'log_volume'"""
KNOWN = """
    SELECT team_id, service_name, metric_name, round(avg(value), 6) AS baseline_value, count(*) AS sample_count FROM (
      SELECT team_id, service_name, 'log_volume' AS metric_name, CAST(n AS DOUBLE) AS value FROM known_hours
      UNION ALL SELECT team_id, service_name, 'error_rate', CASE WHEN n = 0 THEN 0.0 ELSE errors * 100.0::DOUBLE / n END FROM known_hours)
    GROUP BY ALL"""
KNOWN_HOURS = """
    SELECT s.team_id, s.service_name, h.range, count(l.id) AS n, count(l.id) FILTER (l.level IN ('ERROR', 'FATAL')) AS errors
    FROM (SELECT DISTINCT team_id, service_name FROM log_entries) s
    CROSS JOIN range(168) h LEFT JOIN log_entries l ON l.team_id = s.team_id AND l.service_name = s.service_name
      AND l.timestamp BETWEEN TIMESTAMP '2024-01-02' + to_hours(CAST(h.range AS INT)) AND TIMESTAMP '2024-01-02' + to_hours(CAST(h.range + 1 AS INT))
    GROUP BY ALL"""


def _known_sql(body: str) -> str:
    return using("log_entries points metrics", body, **ALL, known_hours=KNOWN_HOURS, known=KNOWN, gone=GONE)


@query("e19_upserted_baselines", _known_sql("""
    SELECT team_id, service_name, metric_name, round(baseline_value, 6) AS baseline_value, sample_count, CAST(2.0 AS DOUBLE) AS deviation_threshold,
      true AS is_active FROM baselines
    UNION ALL SELECT team_id, service_name, metric_name, baseline_value, sample_count, CAST(3.0 AS DOUBLE), true FROM gone"""))
def upserted_baselines(spark, folder):
    """Known log baselines replaced, metric baselines added, those of services that are gone kept."""
    rows = a.upsert_baselines(_known(spark, folder), a.learn_baselines(_series(spark, folder), START, END))
    return _rounded(rows, "baseline_value").select(
        "team_id", "service_name", "metric_name", "baseline_value", "sample_count", "deviation_threshold", "is_active")


# Learned afresh by their own windows: three days of error rates, ten of the clicks' means, twenty hours (too few) of volume.
OWN_WINDOWS = """
    SELECT service_name, metric_name, team_id, CASE metric_name WHEN 'error_rate' THEN 72 WHEN 'click' THEN 240 END AS hours
    FROM (SELECT DISTINCT team_id, service_name FROM log_entries), (VALUES ('error_rate'), ('click')) m(metric_name) WHERE team_id = 2"""
OWN_HOURS = f"""
    SELECT w.team_id, w.service_name, w.metric_name, TIMESTAMP '{END}' - to_hours(CAST(h.range + 1 AS INT)) AS lo,
      TIMESTAMP '{END}' - to_hours(CAST(h.range AS INT)) AS hi
    FROM own_windows w, range(240) h WHERE h.range < w.hours"""
OWN_VALUES = """
    SELECT o.team_id, o.service_name, o.metric_name, o.lo,
      CASE WHEN count(l.id) = 0 THEN 0.0 ELSE count(l.id) FILTER (l.level IN ('ERROR', 'FATAL')) * 100.0::DOUBLE / count(l.id) END AS value
    FROM own_hours o LEFT JOIN log_entries l ON l.team_id = o.team_id AND l.service_name = o.service_name AND l.timestamp BETWEEN o.lo AND o.hi
    WHERE o.metric_name = 'error_rate' GROUP BY ALL
    UNION ALL SELECT o.team_id, o.service_name, o.metric_name, o.lo, coalesce(avg(p.value), 0.0)
    FROM own_hours o JOIN metrics m ON m.team_id = o.team_id AND m.service_name = o.service_name AND m.name = o.metric_name
    LEFT JOIN points p ON p.metric_id = m.metric_id AND p.timestamp BETWEEN o.lo AND o.hi
    WHERE o.metric_name = 'click' GROUP BY ALL"""
OWN = """
    SELECT team_id, service_name, metric_name, round(avg(value), 6) AS baseline_value, count(*) AS sample_count, min(lo) AS window_start_time
    FROM own_values GROUP BY ALL"""


def _own_sql(body: str) -> str:
    return using("log_entries points metrics", body, **ALL, known_hours=KNOWN_HOURS, known=KNOWN, gone=GONE,
                 own_windows=OWN_WINDOWS, own_hours=OWN_HOURS, own_values=OWN_VALUES, own=OWN)


def _changes(spark, folder):
    """A new threshold for some; others switched off and learned afresh, each from a window of its own length."""
    services = t.log_entries(spark, folder).select("team_id", "service_name").distinct()
    kinds = spark.createDataFrame([(1, "log_volume", 1.5, None, None), (2, "error_rate", None, False, 72), (2, "click", None, None, 240),
                                   (2, "log_volume", None, None, 20)],
                                  "team_id bigint, metric_name string, deviation_threshold double, is_active boolean, window_hours int")
    return services.join(kinds, "team_id")


def _learned_by_window(spark, folder):
    return a.learn_changed_baselines(
        _changes(spark, folder), t.log_entries(spark, folder), t.metric_series(spark, folder), t.metrics(spark, folder), END)


@query("e19_baselines_by_window", _own_sql("SELECT * FROM own"))
def baselines_by_window(spark, folder):
    """What the changes learn: two window lengths, and none where the window holds too few hours."""
    rows = _rounded(_learned_by_window(spark, folder), "baseline_value")
    return rows.select("team_id", "service_name", "metric_name", "baseline_value", "sample_count", "window_start_time")


@query("e19_updated_baselines", _own_sql("""
    SELECT k.team_id, k.service_name, k.metric_name, coalesce(o.baseline_value, k.baseline_value) AS baseline_value,
      coalesce(o.sample_count, k.sample_count) AS sample_count,
      CAST(CASE WHEN k.team_id = 1 AND k.metric_name = 'log_volume' THEN 1.5 ELSE 3.0 END AS DOUBLE) AS deviation_threshold,
      NOT (k.team_id = 2 AND k.metric_name = 'error_rate') AS is_active
    FROM known k LEFT JOIN own o ON k.team_id = o.team_id AND k.service_name = o.service_name AND k.metric_name = o.metric_name
    UNION ALL SELECT team_id, service_name, metric_name, baseline_value, sample_count, CAST(3.0 AS DOUBLE), true FROM gone"""))
def updated_baselines(spark, folder):
    """Known baselines after the changes."""
    rows = a.update_baselines(_known(spark, folder), _changes(spark, folder), _learned_by_window(spark, folder))
    return _rounded(rows, "baseline_value").select(
        "team_id", "service_name", "metric_name", "baseline_value", "sample_count", "deviation_threshold", "is_active")


@query("e20_current_values", _sql("SELECT team_id, service_name, metric_name, round(current_value, 6) AS current_value FROM current_values"))
def current_values(spark, folder):
    rows = a.current_values(t.log_entries(spark, folder), t.metric_series(spark, folder), t.metrics(spark, folder), HALF)
    return _rounded(rows, "current_value")


def checks(spark, folder):
    baselines = a.learn_baselines(_series(spark, folder), START, END)
    current = a.current_values(t.log_entries(spark, folder), t.metric_series(spark, folder), t.metrics(spark, folder), HALF)
    return a.anomaly_checks(baselines, current)


@query("c11_f03_anomaly_checks", _sql("""
    SELECT team_id, service_name, metric_name, round(current_value, 6) AS current_value, round(baseline_value, 6) AS baseline_value,
      round(standard_deviation, 6) AS standard_deviation, deviation_threshold, round(z_score, 6) AS z_score, z_score > 2.0 AS is_anomaly,
      CASE WHEN current_value > baseline_value THEN 'ABOVE' WHEN current_value < baseline_value THEN 'BELOW' ELSE 'NORMAL' END AS direction
    FROM checks"""))
def anomaly_checks(spark, folder):
    return _rounded(checks(spark, folder), "current_value", "baseline_value", "standard_deviation", "z_score")


@query("e21_anomaly_report", _sql("""
    SELECT team_id, count(*) AS total_baselines, count(*) FILTER (z_score > 2.0) AS anomalies_detected FROM checks GROUP BY team_id"""))
def anomaly_report(spark, folder):
    return a.anomaly_report(checks(spark, folder))
