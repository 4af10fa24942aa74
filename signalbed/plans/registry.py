"""Named queries and, where SQL can say the same, their check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _plain_times(df: DataFrame) -> DataFrame:
    """Instants as zone-less UTC times, the type the parquet files use."""
    return df.select(*[
        F.col(f.name).cast("timestamp_ntz").alias(f.name) if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
        for f in df.schema.fields
    ])


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(make: Query) -> Query:
        QUERIES[name] = lambda spark, folder: _plain_times(make(spark, folder))
        if sql is not None:
            CHECKS[name] = sql
        return make

    return add


# The derived tables of ``signalbed.sources.tables`` once more, as SQL for the checks.
VIEWS = {
    "log_entries": """
      SELECT event_id AS id, user_id % 3 AS team_id, concat('svc-', user_id % 5) AS service_name,
        CASE event_type WHEN 'error' THEN CASE WHEN event_id % 10 = 0 THEN 'FATAL' ELSE 'ERROR' END
          WHEN 'signup' THEN 'WARN' WHEN 'view' THEN 'DEBUG' WHEN 'click' THEN 'INFO'
          ELSE CASE WHEN event_id % 2 = 0 THEN 'INFO' ELSE 'TRACE' END END AS level,
        concat(event_type, ' by user ', user_id, ' event ', event_id,
          CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN ' connection timeout' ELSE '' END) AS message,
        ts AS timestamp, concat('c-', event_id // 8) AS correlation_id, concat('t-', event_id // 8) AS trace_id,
        CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('s-', event_id) END AS span_id,
        concat('app.', event_type) AS logger_name, concat('worker-', user_id % 7) AS thread_name,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'app.AppError' END AS exception_class,
        CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN concat('code ', user_id) END AS exception_message,
        props AS custom_fields, concat('host-', user_id % 4) AS host_name, concat('10.0.0.', user_id % 9) AS ip_address
      FROM events""",
    "document_logs": """
      SELECT doc_id AS id, 'documents' AS service_name, text AS message, concat('doc.', source) AS logger_name FROM documents
      UNION ALL SELECT page_id, 'pages', html, url FROM pages""",
    "trace_spans": """
      SELECT event_id AS id, user_id % 3 AS team_id, concat('c-', event_id // 8) AS correlation_id,
        concat('t-', event_id // 8) AS trace_id, concat('s-', event_id) AS span_id,
        CASE WHEN event_id % 8 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'missing'
          ELSE concat('s-', event_id - event_id % 8 + (event_id % 8 - 1) // 2) END AS parent_span_id,
        concat('svc-', user_id % 5) AS service_name, event_type AS operation_name, ts AS start_time,
        CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts + to_milliseconds(CAST(floor(value) AS BIGINT)) END AS end_time,
        CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS duration_ms,
        CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'OK' END AS status,
        CASE WHEN event_type = 'error' THEN concat('m-', event_id) END AS status_message
      FROM events""",
    "points": """
      SELECT event_id AS point_id, user_id % 3 AS team_id, concat('svc-', user_id % 5) AS service_name, event_type AS name,
        CASE event_type WHEN 'signup' THEN 'COUNTER' WHEN 'error' THEN 'COUNTER' WHEN 'click' THEN 'GAUGE'
          WHEN 'view' THEN 'HISTOGRAM' ELSE 'TIMER' END AS metric_type,
        concat_ws('/', user_id % 3, concat('svc-', user_id % 5), event_type) AS metric_id, ts AS timestamp, value
      FROM events""",
    "metrics": "SELECT DISTINCT metric_id, team_id, service_name, name, metric_type FROM points",
    "alert_history": """
      SELECT event_id AS id, user_id % 3 AS team_id, concat('rule-', user_id % 6) AS rule_id,
        concat('trap-', user_id % 3) AS trap_id, concat('channel-', user_id % 4) AS channel_id,
        CASE event_type WHEN 'error' THEN 'CRITICAL' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS severity,
        CASE event_id % 3 WHEN 0 THEN 'FIRED' WHEN 1 THEN 'ACKNOWLEDGED' ELSE 'RESOLVED' END AS status,
        concat('alert ', event_id) AS message, ts AS created_at
      FROM events""",
    "alert_actions": """
      SELECT event_id AS action_id, event_id // 8 AS alert_id,
        CASE event_type WHEN 'purchase' THEN 'RESOLVED' WHEN 'signup' THEN 'FIRED' ELSE 'ACKNOWLEDGED' END AS status,
        user_id, ts AS at
      FROM events""",
    "saved_queries": """
      SELECT doc_id AS query_id, doc_id % 3 AS team_id, doc_id % 7 AS created_by, doc_id % 4 = 0 AS is_shared,
        concat(source, '-', doc_id) AS name
      FROM documents""",
    "query_history": """
      SELECT event_id AS history_id, concat('saved-', user_id % 20) AS query_id, user_id % 3 AS team_id, user_id AS created_by,
        CAST(floor(value) AS BIGINT) AS result_count, event_id % 100 AS execution_time_ms, ts AS created_at
      FROM events""",
    "rules": """
      SELECT concat(r.kind, '-', t.team_id) AS rule_id, t.team_id, concat(r.trap, '-', t.team_id) AS trap_id,
        concat(r.channel, '-', t.team_id) AS channel_id, r.name, r.severity, r.throttle
      FROM (VALUES (0), (1), (2)) t(team_id),
        (VALUES ('mail', 'timeouts', 'email', 'Mail', 'CRITICAL', 600), ('chat', 'timeouts', 'slack', 'Chat', 'WARNING', 60),
          ('card', 'fatal', 'teams', 'Card', 'CRITICAL', 1440), ('hook', 'fatal', 'webhook', 'Hook', 'INFO', 0))
        r(kind, trap, channel, name, severity, throttle)""",
    "pattern_hits": """
      SELECT *, concat('timeouts-', team_id) AS trap_id FROM log_entries
      WHERE regexp_matches(message, '(?i)(timeout|connection refused|unreachable)')
        AND level IN ('WARN', 'ERROR', 'FATAL') AND contains(lower(level), 'error')
      UNION ALL SELECT *, concat('fatal-', team_id) FROM log_entries WHERE contains(lower(level), 'fatal')""",
    "fires": """
      SELECT r.rule_id, r.trap_id, h.id AS entry_id, h.timestamp AS fired_at, r.severity, r.throttle,
        concat('Log entry [', h.level, '] ', h.service_name, ': ', h.message) AS message
      FROM pattern_hits h JOIN rules r ON h.trap_id = r.trap_id""",
    "policies": """
      SELECT concat(p.kind, '-', t.team_id) AS policy_id, t.team_id, p.source_name, p.top, p.days
      FROM (VALUES (0), (1), (2)) t(team_id),
        (VALUES ('debug', NULL, 1, 7), ('errors', NULL, 4, 20), ('service', 'svc-1', 5, 15), ('all', NULL, 5, 25))
        p(kind, source_name, top, days)""",
    "ordinals": "SELECT * FROM (VALUES ('TRACE', 0), ('DEBUG', 1), ('INFO', 2), ('WARN', 3), ('ERROR', 4), ('FATAL', 5)) o(level, ord)",
    "policy_rows": """
      SELECT p.policy_id, l.* FROM log_entries l JOIN ordinals o ON l.level = o.level JOIN policies p ON p.team_id = l.team_id
      WHERE o.ord <= p.top AND (p.source_name IS NULL OR p.source_name = l.service_name)
        AND l.timestamp < TIMESTAMP '2024-01-31' - to_days(p.days)""",
}


def using(names: str, body: str, **more: str) -> str:
    """A WITH clause of the named views and ``more``, then ``body``."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names.split()]
    parts += [f"{name} AS ({text})" for name, text in more.items()]
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body
