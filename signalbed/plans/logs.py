"""Filters, search, paging, counts, saved queries."""

from pyspark.sql import functions as F

from signalbed.functions.levels import level_ordinal
from signalbed.operators import ingest, query as q
from signalbed.operators.alerts import history_rows
from signalbed.plans.registry import query, using
from signalbed.sources import tables as t

START, END = "2024-01-05 00:00:00", "2024-01-20 12:00:00"
RANGE = f"timestamp >= TIMESTAMP '{START}' AND timestamp <= TIMESTAMP '{END}'"
BRIEF = ("id", "timestamp", "level", "service_name", "message")
BRIEF_SQL = ", ".join(BRIEF)


@query("b01_structured_filter", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE team_id = 1 AND service_name = 'svc-1' AND level = 'ERROR' AND {RANGE}
      AND host_name = 'host-0' AND lower(logger_name) LIKE '%app.e%' AND lower(exception_class) LIKE '%apperror%'
      AND (lower(message) LIKE '%user%' OR lower(logger_name) LIKE '%user%' OR lower(exception_class) LIKE '%user%'
        OR lower(exception_message) LIKE '%user%' OR lower(custom_fields) LIKE '%user%')"""))
def structured_filter(spark, folder):
    return q.filter_logs(
        t.log_entries(spark, folder), team_id=1, service_name="svc-1", level="error", start_time=START, end_time=END,
        host_name="host-0", logger_name="APP.e", exception_class="AppError", query="User",
    ).select(*BRIEF)


@query("b02_text_search", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE team_id = 2 AND {RANGE} AND (lower(message) LIKE '%time_ut%'
      OR lower(logger_name) LIKE '%time_ut%' OR lower(exception_class) LIKE '%time_ut%'
      OR lower(exception_message) LIKE '%time_ut%' OR lower(custom_fields) LIKE '%time_ut%')"""))
def text_search(spark, folder):
    return q.search_logs(t.log_entries(spark, folder), "Time_ut", team_id=2, start_time=START, end_time=END).select(*BRIEF)


@query("b02_text_search_long", using("document_logs", """
    SELECT id, service_name, length(message) AS size FROM document_logs
    WHERE lower(message) LIKE '%license%' OR lower(logger_name) LIKE '%license%'"""))
def text_search_long(spark, folder):
    found = q.search_logs(t.document_logs(spark, folder), "License")
    return found.select("id", "service_name", F.length("message").alias("size"))


def _conditions(*parts):
    return [dict(zip(("field", "operator", "value", "conjunction"), part)) for part in parts]


@query("b03_condition_fold", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE (service_name = 'svc-1' OR level IN ('ERROR', 'FATAL')) AND host_name <> 'host-2'"""))
def condition_fold(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("service", "=", "svc-1"), ("level", ">=", "ERROR", "OR"), ("host", "!=", "host-2", "AND"))).select(*BRIEF)


@query("b04_string_comparison", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE span_id > 's-5' AND span_id <> 's-77' AND service_name <= 'svc-3'
      AND host_name >= 'host-1' AND thread_name < 'worker-6'"""))
def string_comparison(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("spanId", ">", "s-5"), ("spanId", "!=", "s-77", "AND"), ("service", "<=", "svc-3", "AND"),
        ("hostName", ">=", "host-1", "AND"), ("thread", "<", "worker-6", "AND"))).select(*BRIEF)


@query("b05_contains", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE lower(message) LIKE '%timeout%' AND NOT lower(exception_message) LIKE '%code 1%'"""))
def contains(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("message", "CONTAINS", "TIMEOUT"), ("exceptionMessage", "NOT LIKE", "Code 1", "AND"))).select(*BRIEF)


@query("b06_in_list", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE service_name IN ('svc-1', 'svc-4') AND ip_address NOT IN ('10.0.0.1', '10.0.0.2')"""))
def in_list(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("service", "IN", "svc-1 , svc-4"), ("ip", "NOT IN", "10.0.0.1,10.0.0.2", "AND"))).select(*BRIEF)


@query("b07_level_comparison", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE level IN ('WARN', 'ERROR', 'FATAL') AND level <> 'ERROR' OR level = 'TRACE'"""))
def level_comparison(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("level", ">", "info"), ("level", "!=", "ERROR", "AND"), ("level", "IN", "trace", "OR"))).select(*BRIEF)


@query("b08_time_comparison", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE timestamp > TIMESTAMP '2024-01-10 06:00:00' AND timestamp <= TIMESTAMP '2024-01-22 18:30:00'"""))
def time_comparison(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("timestamp", ">", "2024-01-10T06:00:00Z"), ("timestamp", "<=", "2024-01-22T18:30:00Z", "AND"))).select(*BRIEF)


@query("b09_field_names", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE correlation_id >= 'c-2' AND trace_id >= 't-2' AND logger_name LIKE '%error%'
      AND exception_class = 'app.AppError' AND lower(exception_message) LIKE '%code%'"""))
def field_names(spark, folder):
    return q.filter_conditions(t.log_entries(spark, folder), _conditions(
        ("correlationId", ">=", "c-2"), ("traceId", ">=", "t-2", "AND"), ("logger", "LIKE", "error", "AND"),
        ("exception", "=", "app.AppError", "AND"), ("exceptionMessage", "CONTAINS", "code", "AND"))).select(*BRIEF)


@query("b10_lookup", using("log_entries alert_history", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE id IN (SELECT id FROM alert_history WHERE severity = 'CRITICAL' AND status = 'FIRED')"""))
def lookup(spark, folder):
    wanted = t.alert_history(spark, folder).where("severity = 'CRITICAL' AND status = 'FIRED'").select("id")
    return q.lookup(t.log_entries(spark, folder), wanted, "id").select(*BRIEF)


@query("b11_team_service_level", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE team_id = 0 AND service_name = 'svc-2' AND level = 'WARN' AND {RANGE}"""))
def team_service_level(spark, folder):
    return q.filter_logs(
        t.log_entries(spark, folder), team_id=0, service_name="svc-2", level="WARN", start_time=START, end_time=END
    ).select(*BRIEF)


@query("b12_spans_between", using("trace_spans", f"""
    SELECT id, span_id, service_name, start_time FROM trace_spans WHERE team_id = 1 AND status = 'ERROR'
      AND start_time >= TIMESTAMP '{START}' AND start_time <= TIMESTAMP '{END}'"""))
def spans_between(spark, folder):
    rows = q.filter_equal(t.trace_spans(spark, folder), team_id=1, status="ERROR")
    return q.filter_range(rows, "start_time", START, END).select("id", "span_id", "service_name", "start_time")


@query("b12_alerts_after", using("alert_history", """
    SELECT id, rule_id, created_at FROM alert_history WHERE rule_id = 'rule-2' AND created_at > TIMESTAMP '2024-01-12 00:00:00'"""))
def alerts_after(spark, folder):
    rows = q.filter_equal(t.alert_history(spark, folder), rule_id="rule-2")
    return q.filter_range(rows, "created_at", after="2024-01-12 00:00:00").select("id", "rule_id", "created_at")


SOURCES_SQL = "SELECT DISTINCT team_id, service_name AS name, concat('src-', team_id, '-', service_name) AS source_id FROM log_entries WHERE level = 'FATAL'"


def sources(spark, folder):
    """Sources known so far: those that logged something fatal."""
    rows = t.log_entries(spark, folder).where("level = 'FATAL'").select("team_id", F.col("service_name").alias("name")).distinct()
    return rows.withColumn("source_id", F.concat(F.lit("src-"), "team_id", F.lit("-"), "name"))


@query("b13_c01_entry_with_source", using("log_entries", """
    SELECT l.id, l.service_name, s.source_id, s.name AS source_name FROM log_entries l
    LEFT JOIN sources s ON l.team_id = s.team_id AND l.service_name = s.name""", sources=SOURCES_SQL))
def entry_with_source(spark, folder):
    rows = ingest.with_source(t.log_entries(spark, folder), sources(spark, folder))
    return rows.select("id", "service_name", "source_id", "source_name")


@query("b22_catalog_listing", using("points metrics", """
    SELECT metric_id, name, metric_type FROM metrics WHERE team_id = 1 AND metric_type = 'COUNTER'"""))
def catalog_listing(spark, folder):
    rows = q.filter_equal(t.metrics(spark, folder), team_id=1, metric_type="COUNTER", service_name=None)
    return rows.select("metric_id", "name", "metric_type")


@query("d10_level_ordinal", using("log_entries ordinals", """
    SELECT o.ord, count(*) AS n FROM log_entries l JOIN ordinals o ON l.level = o.level GROUP BY o.ord"""))
def ordinals(spark, folder):
    return t.log_entries(spark, folder).groupBy(level_ordinal(F.col("level")).alias("ord")).agg(F.count(F.lit(1)).alias("n"))


@query("e06_counts", using("log_entries", f"""
    SELECT team_id, service_name, count(*) AS n, count(*) FILTER (level = 'TRACE') AS n_trace,
      count(*) FILTER (level = 'DEBUG') AS n_debug, count(*) FILTER (level = 'INFO') AS n_info,
      count(*) FILTER (level = 'WARN') AS n_warn, count(*) FILTER (level = 'ERROR') AS n_error,
      count(*) FILTER (level = 'FATAL') AS n_fatal
    FROM log_entries WHERE {RANGE} GROUP BY ALL"""))
def counts(spark, folder):
    return q.level_counts(t.log_entries(spark, folder), ["team_id", "service_name"], START, END)


@query("e07_logs_per_service", using("log_entries", "SELECT service_name, count(*) AS n FROM log_entries GROUP BY service_name"))
def logs_per_service(spark, folder):
    return t.log_entries(spark, folder).groupBy("service_name").agg(F.count(F.lit(1)).alias("n"))


@query("e07_logs_per_level", using("log_entries", "SELECT level, count(*) AS n FROM log_entries GROUP BY level"))
def logs_per_level(spark, folder):
    return t.log_entries(spark, folder).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("e11_saved_query_usage", using("query_history", """
    SELECT query_id, count(*) AS execution_count, max(created_at) AS last_executed_at, sum(result_count)::BIGINT AS total_results,
      round(avg(execution_time_ms), 6) AS avg_execution_ms FROM query_history GROUP BY query_id"""))
def saved_query_usage(spark, folder):
    return q.saved_query_usage(t.query_history(spark, folder)).withColumn("avg_execution_ms", F.round("avg_execution_ms", 6))


@query("g01_newest_page", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE team_id = 1 AND level IN ('WARN', 'ERROR', 'FATAL')
    ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"""))
def newest_page(spark, folder):
    rows = q.filter_conditions(t.log_entries(spark, folder), _conditions(("level", ">=", "WARN")), team_id=1)
    return q.newest_page(rows, page=2, size=20).select(*BRIEF)


def _third_page(rows, size=20, **order):
    """Three pages, each from the last row of the one before: the caller keeps one row, not a number."""
    last = None
    for _ in range(2):
        found = q.page_after(rows, last, size, **order).collect()
        if len(found) < size:
            return rows.limit(0)
        last = found[-1]
    return q.page_after(rows, last, size, **order)


@query("g01_page_after", using("log_entries", f"""
    SELECT {BRIEF_SQL} FROM log_entries WHERE team_id = 1 AND level IN ('WARN', 'ERROR', 'FATAL')
    ORDER BY timestamp DESC, id DESC LIMIT 20 OFFSET 40"""))
def page_after(spark, folder):
    return _third_page(q.filter_conditions(t.log_entries(spark, folder), _conditions(("level", ">=", "WARN")), team_id=1).select(*BRIEF))


@query("g07_alert_page_after", using("alert_history", """
    SELECT id, rule_id, created_at FROM alert_history WHERE team_id = 2 ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 40"""))
def alert_page_after(spark, folder):
    return _third_page(history_rows(t.alert_history(spark, folder), team_id=2).select("id", "rule_id", "created_at"), by="created_at")


@query("g08_query_page_after", using("query_history", """
    SELECT history_id, query_id, created_at FROM query_history ORDER BY created_at DESC, history_id DESC LIMIT 7 OFFSET 14"""))
def query_page_after(spark, folder):
    return _third_page(t.query_history(spark, folder).select("history_id", "query_id", "created_at"), 7, by="created_at", tie="history_id")


@query("g01_page_info", using("log_entries", """
    SELECT 2 AS page, 20 AS size, count(*) AS total_elements, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages,
      60 >= count(*) AS is_last FROM log_entries WHERE team_id = 1 AND level IN ('WARN', 'ERROR', 'FATAL')"""))
def page_info(spark, folder):
    rows = q.filter_conditions(t.log_entries(spark, folder), _conditions(("level", ">=", "WARN")), team_id=1)
    return q.page_info(rows, page=2, size=20)


@query("g07_alert_history_page", using("alert_history", """
    SELECT id, rule_id, severity, status, created_at FROM alert_history WHERE team_id = 2 AND severity = 'CRITICAL'
    ORDER BY created_at DESC, id DESC LIMIT 20"""))
def alert_history_page(spark, folder):
    rows = history_rows(t.alert_history(spark, folder), team_id=2, severity="CRITICAL")
    return q.newest_page(rows, by="created_at").select("id", "rule_id", "severity", "status", "created_at")


@query("g08_query_history_page", using("query_history", """
    SELECT history_id, query_id, created_at FROM query_history WHERE created_by = 42
    ORDER BY created_at DESC, history_id DESC LIMIT 20"""))
def query_history_page(spark, folder):
    rows = q.filter_equal(t.query_history(spark, folder), created_by=42)
    return q.newest_page(rows, by="created_at", tie="history_id").select("history_id", "query_id", "created_at")


@query("h01_saved_queries", using("saved_queries", """
    SELECT query_id, name, team_id, created_by, is_shared, CASE WHEN created_by = 3 THEN 'own' ELSE 'shared' END AS origin
    FROM saved_queries WHERE created_by = 3 OR (team_id = 1 AND is_shared)"""))
def saved_queries(spark, folder):
    return q.merged_saved_queries(t.saved_queries(spark, folder), 1, 3).select(
        "query_id", "name", "team_id", "created_by", "is_shared", "origin")
