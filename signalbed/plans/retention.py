"""What retention removes and what storage holds."""

import uuid

from pyspark.sql import functions as F

from signalbed.operators import query as q
from signalbed.operators import retention as r
from signalbed.plans.registry import query, using
from signalbed.session import shared_folder
from signalbed.sources import sinks
from signalbed.sources import tables as t

AS_OF = "2024-01-31"


@query("b19_expired_logs", using("log_entries ordinals policies policy_rows", "SELECT DISTINCT id, team_id, level, timestamp FROM policy_rows"))
def expired_logs(spark, folder):
    rows = r.expired_logs(t.log_entries(spark, folder), t.retention_policies(spark), AS_OF)
    return rows.select("id", "team_id", "level", "timestamp")


@query("b19_kept_logs", using("log_entries ordinals policies policy_rows", """
    SELECT level, count(*) AS n FROM log_entries WHERE id NOT IN (SELECT id FROM policy_rows) GROUP BY level"""))
def kept_logs(spark, folder):
    rows = r.kept_logs(t.log_entries(spark, folder), t.retention_policies(spark), AS_OF)
    return rows.groupBy("level").agg(F.count(F.lit(1)).alias("n"))


@query("b19_policy_hits", using("log_entries ordinals policies policy_rows", """
    SELECT p.policy_id, count(x.id) AS removed FROM policies p LEFT JOIN policy_rows x ON x.policy_id = p.policy_id GROUP BY p.policy_id"""))
def policy_hits(spark, folder):
    return r.policy_hits(t.log_entries(spark, folder), t.retention_policies(spark), AS_OF)


OLD = "TIMESTAMP '2024-01-31' - to_days(12)"


@query("b20_global_purge", using("log_entries points trace_spans", f"""
    SELECT 'log_entries' AS fact, count(*) FILTER (timestamp < {OLD}) AS removed, count(*) FILTER (timestamp >= {OLD}) AS kept FROM log_entries
    UNION ALL SELECT 'metric_series', count(*) FILTER (timestamp < {OLD}), count(*) FILTER (timestamp >= {OLD}) FROM points
    UNION ALL SELECT 'trace_spans', count(*) FILTER (start_time < {OLD}), count(*) FILTER (start_time >= {OLD}) FROM trace_spans"""))
def global_purge(spark, folder):
    return r.global_purge_counts(t.log_entries(spark, folder), t.metric_series(spark, folder), t.trace_spans(spark, folder), AS_OF, 12)


@query("b20_query_history_purge", using("query_history", f"SELECT history_id, created_at FROM query_history WHERE created_at >= {OLD}"))
def query_history_purge(spark, folder):
    kept, _ = r.purge_before(t.query_history(spark, folder), "created_at", AS_OF, 12)
    return kept.select("history_id", "created_at")


@query("e08_storage_usage", using("log_entries policies", """
    SELECT 'log_entries' AS part, 'all' AS name, count(*) AS n, min(timestamp) AS oldest, max(timestamp) AS newest FROM log_entries
    UNION ALL SELECT 'service', service_name, count(*), min(timestamp), max(timestamp) FROM log_entries GROUP BY service_name
    UNION ALL SELECT 'level', level, count(*), min(timestamp), max(timestamp) FROM log_entries GROUP BY level
    UNION ALL SELECT 'metric_series', 'all', count(*), NULL, NULL FROM events
    UNION ALL SELECT 'trace_spans', 'all', count(*), NULL, NULL FROM events
    UNION ALL SELECT 'active_policies', 'all', count(*), NULL, NULL FROM policies"""))
def storage_usage(spark, folder):
    return r.storage_usage(t.log_entries(spark, folder), t.metric_series(spark, folder), t.trace_spans(spark, folder), t.retention_policies(spark))


def _archiving(spark):
    """The policies, and two more that archive: one of another level to the same folder, one of everything to another."""
    more = spark.createDataFrame(
        [(f"low-{team}", team, None, "INFO", 18, "archive", "archive/svc-1", True) for team in t.TEAMS]
        + [(f"cold-{team}", team, None, None, 23, "ARCHIVE", "archive/cold", True) for team in t.TEAMS],
        t.schemas.RETENTION_POLICIES)
    return t.retention_policies(spark).unionByName(more)


ROUTES = """
    SELECT l.id, d.destination, CAST(l.timestamp AS DATE) AS day FROM log_entries l JOIN ordinals o ON l.level = o.level, (VALUES
      ('archive/svc-1', 'svc-1', 5, 15), ('archive/svc-1', NULL, 2, 18), ('archive/cold', NULL, 5, 23)) d(destination, source, top, days)
    WHERE o.ord <= d.top AND (d.source IS NULL OR d.source = l.service_name) AND l.timestamp < TIMESTAMP '2024-01-31' - to_days(d.days)"""
STORED = f"""
    SELECT DISTINCT destination, id, day FROM ({ROUTES})
    UNION ALL SELECT 'store', l.id, CAST(l.timestamp AS DATE) FROM log_entries l WHERE l.id NOT IN (SELECT id FROM policy_rows)
      AND l.id NOT IN (SELECT id FROM ({ROUTES}))"""


@query("a12_archive_routes", using("log_entries ordinals", f"SELECT DISTINCT id, destination, day FROM ({ROUTES})"))
def archive_routes(spark, folder):
    rows = r.archive_routes(t.log_entries(spark, folder), _archiving(spark), AS_OF)
    return rows.select("id", F.col("archive_destination").alias("destination"), F.to_date("timestamp").alias("day"))


@query("a12_b19_policy_run", using("log_entries ordinals policies policy_rows", STORED))
def policy_run(spark, folder):
    """A store of days after the policies ran over it, twice: what is archived where, and what stays."""
    place = f"{shared_folder(spark)}/policies-{uuid.uuid4()}"
    sinks.append_by_day(t.log_entries(spark, folder), f"{place}/store", sort=("service_name", "level", "timestamp"))
    for _ in range(2):
        r.apply_policies(spark, f"{place}/store", _archiving(spark), AS_OF, f"{place}/archive")
    archived = spark.read.parquet(f"{place}/archive").select(F.col("archive_destination").alias("destination"), "id", "day")
    return archived.unionByName(spark.read.parquet(f"{place}/store").select(F.lit("store").alias("destination"), "id", "day"))


@query("a13_query_runs", using("query_history", """
    SELECT query_id, count(*) AS execution_count, max(created_at) AS last_executed_at, sum(result_count)::BIGINT AS total_results FROM query_history
    WHERE created_at >= TIMESTAMP '2024-01-10' GROUP BY query_id"""))
def query_runs(spark, folder):
    """Usage of saved queries, from a history that the finished queries were appended to."""
    place = f"{shared_folder(spark)}/query-runs-{uuid.uuid4()}"
    sinks.append_query_runs(t.query_history(spark, folder), place)
    usage = q.saved_query_usage(sinks.read_days(spark, place, start="2024-01-10", by="created_at"))
    return usage.select("query_id", "execution_count", "last_executed_at", "total_results")
