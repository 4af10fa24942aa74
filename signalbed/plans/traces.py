"""Traces: summaries, order, depth, waterfall, logs, root cause."""

from pyspark.sql import functions as F

from signalbed.functions.times import millis_between
from signalbed.operators import traces as tr
from signalbed.plans.registry import query, using
from signalbed.sources import tables as t


def _ms(start: str, end: str) -> str:
    """Whole milliseconds, cut toward zero."""
    return f"CAST(trunc((epoch_us({end}) - epoch_us({start})) / 1000.0) AS BIGINT)"


LAST = "coalesce(end_time, start_time)"
SUMMARIES = f"""
    SELECT correlation_id, arg_min(trace_id, r) AS trace_id, arg_min(service_name, r) AS root_service,
      arg_min(operation_name, r) AS root_operation, count(*) AS span_count, count(DISTINCT service_name) AS service_count,
      {_ms('min(start_time)', f'max({LAST})')} AS duration_ms, bool_or(status = 'ERROR') AS has_errors,
      min(start_time) AS start_time, max({LAST}) AS end_time, max(RECENT) AS recent_start
    FROM (SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY parent_span_id IS NOT NULL, start_time, span_id) AS r
      FROM trace_spans WHERE FILTER) GROUP BY correlation_id"""


def _summaries(where: str = "true", recent: str = "start_time") -> str:
    return SUMMARIES.replace("FILTER", where).replace("RECENT", recent)


@query("e12_trace_summaries", using("trace_spans", _summaries()))
def trace_summaries(spark, folder):
    return tr.trace_summaries(t.trace_spans(spark, folder))


@query("e13_root_spans", using("trace_spans", """
    SELECT correlation_id, root_service, root_operation FROM summaries WHERE has_errors""", summaries=_summaries()))
def root_spans(spark, folder):
    rows = tr.trace_summaries(t.trace_spans(spark, folder)).where("has_errors")
    return rows.select("correlation_id", "root_service", "root_operation")


@query("e14_trace_flows", using("trace_spans", f"""
    SELECT correlation_id, arg_min(trace_id, start_time) AS trace_id, count(*) AS span_count,
      {_ms('min(start_time)', f'arg_max({LAST}, start_time)')} AS duration_ms, bool_or(status = 'ERROR') AS has_errors
    FROM trace_spans GROUP BY correlation_id"""))
def trace_flows(spark, folder):
    return tr.trace_flows(t.trace_spans(spark, folder))


@query("e23_impacted_services", using("trace_spans", """
    SELECT correlation_id, count(DISTINCT service_name) AS impacted_services FROM trace_spans WHERE status = 'ERROR' GROUP BY correlation_id"""))
def impacted_services(spark, folder):
    return tr.root_causes(t.trace_spans(spark, folder)).select("correlation_id", "impacted_services")


@query("g02_recent_traces", using("trace_spans", "SELECT * FROM summaries ORDER BY recent_start DESC, correlation_id LIMIT 20 OFFSET 20",
                                  summaries=_summaries("team_id = 1")))
def recent_traces(spark, folder):
    return tr.recent_traces(t.trace_spans(spark, folder), 1, page=1, size=20)


@query("g02_traces_after", using("trace_spans", "SELECT * FROM summaries ORDER BY recent_start DESC, correlation_id LIMIT 20 OFFSET 20",
                                 summaries=_summaries("team_id = 1")))
def traces_after(spark, folder):
    """The second page from the last trace of the first."""
    spans = t.trace_spans(spark, folder)
    return tr.traces_after(spans, 1, tr.traces_after(spans, 1).collect()[-1])


OF_SERVICE = _summaries("true", "CASE WHEN team_id = 1 AND service_name = 'svc-2' THEN start_time END")
WITH_ERRORS = _summaries("true", "CASE WHEN team_id = 1 AND status = 'ERROR' THEN start_time END")


@query("c09_traces_of_service", using("trace_spans", """
    SELECT * FROM summaries WHERE correlation_id IN (SELECT correlation_id FROM trace_spans WHERE team_id = 1 AND service_name = 'svc-2')""",
    summaries=OF_SERVICE))
def traces_of_service(spark, folder):
    return tr.traces_of_service(t.trace_spans(spark, folder), 1, "svc-2")


@query("g03_traces_by_service", using("trace_spans", """
    SELECT * FROM summaries WHERE recent_start IS NOT NULL ORDER BY recent_start DESC, correlation_id LIMIT 20""", summaries=OF_SERVICE))
def traces_by_service(spark, folder):
    return tr.traces_by_service(t.trace_spans(spark, folder), 1, "svc-2")


@query("g03_service_traces_after", using("trace_spans", """
    SELECT * FROM summaries WHERE recent_start IS NOT NULL ORDER BY recent_start DESC, correlation_id LIMIT 20 OFFSET 20""", summaries=OF_SERVICE))
def service_traces_after(spark, folder):
    spans = t.trace_spans(spark, folder)
    first = tr.traces_after(spans, 1, service_name="svc-2").collect()[-1]
    return tr.traces_after(spans, 1, first, service_name="svc-2")


@query("c10_traces_with_errors", using("trace_spans", """
    SELECT * FROM summaries WHERE correlation_id IN (SELECT correlation_id FROM trace_spans WHERE team_id = 1 AND status = 'ERROR')""",
    summaries=WITH_ERRORS))
def traces_with_errors(spark, folder):
    return tr.traces_with_errors(t.trace_spans(spark, folder), 1)


@query("g04_error_traces", using("trace_spans", """
    SELECT * FROM summaries WHERE recent_start IS NOT NULL ORDER BY recent_start DESC, correlation_id LIMIT 20""", summaries=WITH_ERRORS))
def error_traces(spark, folder):
    return tr.error_traces(t.trace_spans(spark, folder), 1)


@query("g06_ordered_trace", using("trace_spans", """
    SELECT span_id, parent_span_id, start_time, status FROM trace_spans WHERE correlation_id = 'c-42' ORDER BY start_time"""))
def ordered_trace(spark, folder):
    rows = tr.trace_spans_in_order(t.trace_spans(spark, folder), "correlation_id", "c-42")
    return rows.select("span_id", "parent_span_id", "start_time", "status")


DURATION = f"coalesce(duration_ms, {_ms('start_time', 'end_time')}, 0)"


@query("f09_durations", using("trace_spans", f"SELECT span_id, {DURATION} AS duration_ms FROM trace_spans"))
def durations(spark, folder):
    return t.trace_spans(spark, folder).select("span_id", tr.resolved_duration().alias("duration_ms"))


@query("d11_milliseconds", using("trace_spans", f"""
    SELECT a.span_id, {_ms('b.start_time', 'a.start_time')} AS ms FROM trace_spans a
    JOIN trace_spans b ON a.correlation_id = b.correlation_id AND a.parent_span_id = b.span_id"""))
def milliseconds(spark, folder):
    """Start of every span against the start of its parent."""
    spans = t.trace_spans(spark, folder)
    parents = spans.select("correlation_id", F.col("span_id").alias("parent_span_id"), F.col("start_time").alias("parent_start"))
    rows = spans.join(parents, ["correlation_id", "parent_span_id"])
    return rows.select("span_id", millis_between(F.col("parent_start"), F.col("start_time")).alias("ms"))


REACHED = """
    SELECT correlation_id, span_id, 0 AS depth FROM trace_spans WHERE parent_span_id IS NULL
    UNION ALL SELECT s.correlation_id, s.span_id, r.depth + 1 FROM reached r
      JOIN trace_spans s ON s.correlation_id = r.correlation_id AND s.parent_span_id = r.span_id"""
DEPTHS = """
    SELECT s.*, coalesce(r.depth, 0) AS depth FROM trace_spans s
    LEFT JOIN reached r ON r.correlation_id = s.correlation_id AND r.span_id = s.span_id"""


@query("f07_c13_span_depths", using("trace_spans", "SELECT correlation_id, span_id, depth FROM depths", reached=REACHED, depths=DEPTHS))
def span_depths(spark, folder):
    return tr.span_depths(t.trace_spans(spark, folder)).select("correlation_id", "span_id", "depth")


SPAN_LOGS = """
    SELECT l.correlation_id, l.span_id, l.id AS log_id FROM log_entries l
    WHERE l.span_id IS NOT NULL AND l.correlation_id IN (SELECT correlation_id FROM trace_spans)
    UNION ALL SELECT l.correlation_id, s.span_id, l.id FROM log_entries l JOIN trace_spans s ON l.correlation_id = s.correlation_id
    WHERE l.span_id IS NULL
    QUALIFY row_number() OVER (PARTITION BY l.id ORDER BY abs(epoch_us(l.timestamp) - epoch_us(s.start_time)) // 1000, s.start_time, s.span_id) = 1"""
# The logs a second or so away from their spans, so that the nearest one is not the log's own.
SHIFTED_LOGS = SPAN_LOGS.replace("log_entries", "shifted")
SHIFTED = "SELECT * REPLACE (timestamp + to_milliseconds((id * 7919) % 900000) AS timestamp) FROM log_entries"


@query("c07_span_logs", using("log_entries trace_spans", "SELECT * FROM span_logs", span_logs=SPAN_LOGS))
def span_logs(spark, folder):
    return tr.span_logs(t.log_entries(spark, folder), t.trace_spans(spark, folder))


@query("c08_nearest_spans", using("log_entries trace_spans", "SELECT * FROM span_logs", shifted=SHIFTED, span_logs=SHIFTED_LOGS))
def nearest_spans(spark, folder):
    shift = F.make_dt_interval(secs=(F.col("id") * 7919 % 900000) / 1000)
    logs = t.log_entries(spark, folder).withColumn("timestamp", F.col("timestamp") + shift)
    return tr.span_logs(logs, t.trace_spans(spark, folder))


@query("c06_trace_logs", using("log_entries trace_spans", """
    SELECT correlation_id, id AS log_id, timestamp FROM log_entries WHERE correlation_id IN (SELECT correlation_id FROM trace_spans)"""))
def trace_logs(spark, folder):
    return tr.trace_logs(t.log_entries(spark, folder), t.trace_spans(spark, folder))


HEADERS = f"""
    SELECT correlation_id, arg_min(trace_id, r) AS trace_id, arg_min(start_time, r) AS root_start,
      {_ms('arg_min(start_time, r)', f'max({LAST})')} AS total_duration_ms, count(*) AS span_count,
      count(DISTINCT service_name) AS service_count, bool_or(status = 'ERROR') AS has_errors
    FROM (SELECT *, row_number() OVER (PARTITION BY correlation_id ORDER BY parent_span_id IS NOT NULL, start_time, span_id) AS r
      FROM trace_spans) GROUP BY correlation_id"""


@query("f08_waterfall_headers", using("trace_spans", HEADERS))
def waterfall_headers(spark, folder):
    return tr.waterfall_headers(t.trace_spans(spark, folder))


@query("f08_waterfall", using("log_entries trace_spans", f"""
    SELECT d.correlation_id, d.id, d.span_id, d.parent_span_id, d.service_name, d.operation_name, d.start_time,
      {_ms('h.root_start', 'd.start_time')} AS offset_ms, {DURATION.replace('start_time', 'd.start_time').replace('end_time', 'd.end_time')} AS duration_ms,
      d.status, d.status_message, d.depth, coalesce(c.log_count, 0) AS log_count
    FROM depths d JOIN headers h ON d.correlation_id = h.correlation_id
    LEFT JOIN (SELECT correlation_id, span_id, count(*) AS log_count FROM span_logs GROUP BY ALL) c
      ON c.correlation_id = d.correlation_id AND c.span_id = d.span_id""",
    reached=REACHED, depths=DEPTHS, headers=HEADERS, span_logs=SPAN_LOGS))
def waterfall(spark, folder):
    return tr.waterfall(t.trace_spans(spark, folder), t.log_entries(spark, folder))


@query("f10_root_causes", using("trace_spans", f"""
    SELECT correlation_id, arg_min(trace_id, start_time) FILTER (status = 'ERROR') AS trace_id,
      arg_min(span_id, start_time) FILTER (status = 'ERROR') AS root_cause_span,
      arg_min(service_name, start_time) FILTER (status = 'ERROR') AS root_cause_service,
      arg_min(status_message, start_time) FILTER (status = 'ERROR') AS error_message,
      count(DISTINCT service_name) FILTER (status = 'ERROR') AS impacted_services,
      {_ms('min(start_time)', f'max({LAST})')} AS duration_ms
    FROM trace_spans GROUP BY correlation_id HAVING count(*) FILTER (status = 'ERROR') > 0"""))
def root_causes(spark, folder):
    return tr.root_causes(t.trace_spans(spark, folder))


@query("f10_root_cause_logs", using("log_entries trace_spans", """
    SELECT correlation_id, id AS log_id, timestamp FROM log_entries
    WHERE correlation_id IN (SELECT correlation_id FROM trace_spans WHERE status = 'ERROR')"""))
def root_cause_logs(spark, folder):
    return tr.root_cause_logs(t.log_entries(spark, folder), t.trace_spans(spark, folder))


@query("f11_error_chains", using("trace_spans", "SELECT * FROM chain", errors="SELECT * FROM trace_spans WHERE status = 'ERROR'",
    chain="""
    SELECT correlation_id, span_id, 0 AS chain_depth FROM errors
      QUALIFY row_number() OVER (PARTITION BY correlation_id ORDER BY start_time, span_id) = 1
    UNION ALL SELECT e.correlation_id, e.span_id, c.chain_depth + 1 FROM chain c
      JOIN errors e ON e.correlation_id = c.correlation_id AND e.parent_span_id = c.span_id"""))
def error_chains(spark, folder):
    return tr.error_chains(t.trace_spans(spark, folder)).select("correlation_id", "span_id", "chain_depth")
