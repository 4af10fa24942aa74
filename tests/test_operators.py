"""Small cases with known results."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signalbed.operators import alerts, anomaly, ingest, metrics, query, retention, traces, traps
from signalbed.sources import sinks


def at(seconds, micros=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds, microseconds=micros)


def test_metric_statistics(spark):
    rows = [("ten", at(n), float(n)) for n in range(1, 11)] + [("hundred", at(n), float(n)) for n in range(1, 101)]
    rows += [("dev", at(n), float(v)) for n, v in enumerate((2, 4, 4, 4, 5, 5, 7, 9))]
    series = spark.createDataFrame(rows, "metric_id string, timestamp timestamp, value double")
    catalog = spark.createDataFrame([("ten",), ("hundred",), ("dev",), ("none",)], "metric_id string")
    got = {r.metric_id: r for r in metrics.metric_statistics(series, at(0), at(1000), catalog).collect()}
    assert got["ten"].p50 == 5
    assert (got["hundred"].p95, got["hundred"].p99) == (95, 99)
    assert got["dev"].stddev == pytest.approx(2.0)
    assert tuple(got["none"])[1:] == (0,) * 9


def test_buckets(spark):
    rows = [("m", at(5), 10.0), ("m", at(30), 20.0), ("m", at(65), 30.0), ("m", at(90), 40.0), ("m", at(200), 1.0)]
    series = spark.createDataFrame(rows, "metric_id string, timestamp timestamp, value double")
    got = [(r.bucket, r.value) for r in metrics.bucket_averages(series, at(0), at(300), 60).orderBy("bucket").collect()]
    assert got == [(at(0), 15.0), (at(60), 35.0), (at(180), 1.0)]
    with pytest.raises(ValueError):
        metrics.bucket_averages(series, at(0), at(1), 5)


def spans(spark, rows):
    """(span, parent, start second, seconds, status, service)"""
    data = [("c", "t", s, p, at(b), at(b + d) if d is not None else None, None, st, svc, s, s, "m-" + s) for s, p, b, d, st, svc in rows]
    return spark.createDataFrame(data, """correlation_id string, trace_id string, span_id string, parent_span_id string, start_time timestamp,
        end_time timestamp, duration_ms long, status string, service_name string, operation_name string, id string, status_message string""")


def test_depths(spark):
    rows = spans(spark, [
        ("root", None, 0, 9, "OK", "a"), ("child", "root", 1, 2, "OK", "b"), ("grand", "child", 2, 1, "OK", "b"),
        ("sister", "root", 1, 1, "OK", "c"), ("orphan", "gone", 3, 1, "OK", "c"), ("below", "orphan", 4, 1, "OK", "c"),
    ])
    got = {r.span_id: r.depth for r in traces.span_depths(rows).collect()}
    assert got == {"root": 0, "child": 1, "grand": 2, "sister": 1, "orphan": 0, "below": 0}


def test_waterfall_and_summary(spark):
    rows = spans(spark, [("early", "gone", 0, 1, "OK", "a"), ("root", None, 1, None, "OK", "b"), ("child", "root", 2, 5, "ERROR", "c")])
    got = {r.span_id: (r.offset_ms, r.duration_ms, r.depth) for r in traces.waterfall(rows).collect()}
    assert got == {"early": (-1000, 1000, 0), "root": (0, 0, 0), "child": (1000, 5000, 1)}
    header = traces.waterfall_headers(rows).first()
    assert (header.total_duration_ms, header.span_count, header.service_count, header.has_errors) == (6000, 3, 3, True)
    summary = traces.trace_summaries(rows).first()
    assert (summary.root_service, summary.duration_ms, summary.start_time) == ("b", 7000, at(0))
    assert traces.trace_flows(rows).first().duration_ms == 7000


def test_error_chain_stops_at_a_good_span(spark):
    rows = spans(spark, [
        ("root", None, 0, 9, "OK", "a"), ("first", "root", 1, 2, "ERROR", "b"), ("next", "first", 2, 1, "ERROR", "c"),
        ("good", "first", 2, 1, "OK", "c"), ("after", "good", 3, 1, "ERROR", "d"), ("deep", "next", 4, 1, "ERROR", "e"),
    ])
    chain = [(r.span_id, r.chain_depth) for r in traces.error_chains(rows).orderBy("chain_depth").collect()]
    assert chain == [("first", 0), ("next", 1), ("deep", 2)]
    cause = traces.root_causes(rows).first()
    assert (cause.root_cause_span, cause.root_cause_service, cause.error_message, cause.impacted_services) == ("first", "b", "m-first", 4)
    assert traces.root_causes(rows.where("status = 'OK'")).count() == 0


def test_nearest_span_ties_within_a_millisecond(spark):
    data = [("c", "s1", at(0)), ("c", "s2", at(0, 400)), ("c", "s3", at(2)), ("c", "s4", at(2, 900))]
    starts = spark.createDataFrame(data, "correlation_id string, span_id string, start_time timestamp")
    logs = [("c", " ", "a", at(0, 900)), ("c", None, "b", at(1)), ("c", None, "d", at(1, 1)), ("c", None, "e", at(5)), ("c", "own", "f", at(0)), ("x", None, "g", at(0))]
    entries = spark.createDataFrame(logs, "correlation_id string, span_id string, id string, timestamp timestamp")
    got = {r.log_id: r.span_id for r in traces.span_logs(entries, starts).collect()}
    # d: s2 and s3 are both 999 whole milliseconds away, the earlier start wins.
    assert got == {"a": "s1", "b": "s2", "d": "s2", "e": "s4", "f": "own"}


def entries(spark, rows):
    return spark.createDataFrame(rows, "id long, team_id long, service_name string, level string, message string, timestamp timestamp")


def test_pattern_rules(spark):
    rows = entries(spark, [(1, 0, "a", "ERROR", "Connection refused", at(0)), (2, 0, "b", "DEBUG", "connection Refused", at(1)), (3, 0, "a", "FATAL", None, at(2))])

    def hits(*conditions):
        trap = {"trap_id": "t", "team_id": 0, "trap_type": "PATTERN", "is_active": True, "conditions": list(conditions)}
        return sorted(r.id for r in traps.pattern_hits(rows, [trap]).collect())

    assert hits() == [1, 2, 3]
    assert hits({"condition_type": "KEYWORD", "field": "message", "pattern": "REFUSED"}) == [1, 2]
    assert hits({"condition_type": "REGEX", "field": "message", "pattern": "refused$"}) == [1]
    assert hits({"condition_type": "REGEX", "field": "message", "pattern": "(["}) == []
    assert hits({"condition_type": "REGEX", "field": "nothing", "pattern": "."}) == []
    assert hits({"condition_type": "ABSENCE", "field": "level", "log_level": "ERROR"}) == [1, 3]
    assert hits({"condition_type": "KEYWORD", "field": "serviceName", "pattern": "a", "service_name": "a"}) == [1, 3]


def test_condition_fold_and_errors(spark):
    rows = entries(spark, [(1, 0, "a", "INFO", "x", at(0)), (2, 0, "b", "ERROR", "x", at(1)), (3, 0, "c", "ERROR", None, at(2))])

    def ids(*parts):
        conditions = [dict(zip(("field", "operator", "value", "conjunction"), p)) for p in parts]
        return sorted(r.id for r in query.filter_conditions(rows, conditions).collect())

    assert ids(("service", "=", "a"), ("level", ">=", "WARN", "OR"), ("message", "=", "x", "AND")) == [1, 2]
    assert ids(("message", "!=", "y")) == [1, 2]
    assert ids(("message", "NOT CONTAINS", "y")) == [1, 2]
    assert ids(("level", "<", "TRACE")) == []
    for bad in (("nope", "=", "x"), ("level", "LIKE", "E"), ("level", "=", "LOUD"), ("timestamp", ">", "2024-01-01"), ("message", "~", "x")):
        with pytest.raises(ValueError):
            ids(bad)
    with pytest.raises(ValueError):
        query.search_logs(rows, "  ")


def test_throttle_edges(spark):
    fires = spark.createDataFrame(
        [("r", 1, at(0), 5), ("r", 2, at(299, 999_999), 5), ("r", 3, at(300), 5), ("r", 9, at(600), 5), ("r", 4, at(600), 5), ("free", 1, at(0), 0), ("free", 2, at(0), 0)],
        "rule_id string, entry_id long, fired_at timestamp, throttle_minutes int")
    assert sorted((r.rule_id, r.entry_id) for r in alerts.throttle(fires).collect()) == [("free", 1), ("free", 2), ("r", 1), ("r", 3), ("r", 4)]
    history = spark.createDataFrame([("r", at(1))], "rule_id string, created_at timestamp")
    assert sorted((r.rule_id, r.entry_id) for r in alerts.throttle(fires, history).collect()) == [("free", 1), ("free", 2), ("r", 4)]


def test_alert_life_cycle(spark):
    known = spark.createDataFrame([(1, "FIRED"), (2, "FIRED"), (3, "RESOLVED")], "alert_id long, status string")
    acts = [(1, 1, "ACKNOWLEDGED", 7, at(1)), (1, 2, "ACKNOWLEDGED", 8, at(2)), (1, 3, "RESOLVED", 9, at(3)), (1, 4, "RESOLVED", 9, at(4)), (1, 5, "FIRED", 9, at(0)),
            (2, 6, "RESOLVED", 5, at(1)), (3, 7, "ACKNOWLEDGED", 5, at(1))]
    actions = spark.createDataFrame(acts, "alert_id long, action_id long, status string, user_id long, at timestamp")
    got = {r.alert_id: (r.status, r.acknowledged_by, r.resolved_by, r.accepted_actions) for r in alerts.apply_actions(known, actions).collect()}
    assert got == {1: ("RESOLVED", 8, 9, 3), 2: ("RESOLVED", 5, 5, 1), 3: ("RESOLVED", None, None, 0)}
    assert sorted(r.action_id for r in alerts.rejected_actions(known, actions).collect()) == [4, 5, 7]


def test_baselines(spark):
    def stats(n, value):
        hours = [(0, "s", "m", h, float(value(h))) for h in range(n)]
        return anomaly.baseline_statistics(spark.createDataFrame(hours, "team_id long, service_name string, metric_name string, hour int, value double")).collect()

    assert stats(23, lambda h: h) == []
    assert stats(24, lambda h: 5)[0].standard_deviation == 0.001


def test_hourly_series_counts_edges_twice(spark):
    rows = entries(spark, [(1, 0, "s", "ERROR", "", at(0)), (2, 0, "s", "INFO", "", at(3600)), (3, 0, "s", "INFO", "", at(7200)), (4, 0, "s", "INFO", "", at(7201))])
    got = {(r.metric_name, r.hour): r.value for r in anomaly.hourly_log_series(rows, at(0), at(7200)).collect()}
    assert got == {("log_volume", 0): 2, ("log_volume", 1): 2, ("error_rate", 0): 50, ("error_rate", 1): 0}
    # A window that is no whole number of hours reaches past its end.
    got = {(r.metric_name, r.hour): r.value for r in anomaly.hourly_log_series(rows, at(0), at(7199)).collect()}
    assert got[("log_volume", 1)] == 2


def test_retention_levels_and_strict_cutoff(spark):
    day = 86400
    rows = entries(spark, [(n, 0, "s", level, "", at(0)) for n, level in enumerate(("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL"))] + [(9, 0, "s", "INFO", "", at(day)), (10, 1, "s", "INFO", "", at(0))])
    policies = spark.createDataFrame([("p", 0, None, "WARN", 1, "PURGE", True)], "policy_id string, team_id long, source_name string, log_level string, retention_days int, action string, is_active boolean")
    assert sorted(r.id for r in retention.expired_logs(rows, policies, at(2 * day)).collect()) == [0, 1, 2, 3]
    assert retention.policy_hits(rows, policies, at(2 * day)).first().removed == 4
    with pytest.raises(ValueError):
        retention.purge_before(rows, "timestamp", at(0), 0)


def test_archive_then_purge(spark, tmp_path):
    rows = entries(spark, [(1, 0, "s", "INFO", "old", at(0)), (2, 0, "s", "INFO", "new", at(10 * 86400)), (3, 0, "x", "INFO", "old", at(0))])
    policies = spark.createDataFrame(
        [("p", 0, "s", None, 5, "ARCHIVE", f"{tmp_path}/archive", True), ("q", 0, "x", None, 5, "PURGE", None, True)],
        "policy_id string, team_id long, source_name string, log_level string, retention_days int, action string, archive_destination string, is_active boolean")
    retention.run_policies(rows, policies, at(10 * 86400), f"{tmp_path}/kept")
    assert [r.id for r in spark.read.parquet(f"{tmp_path}/archive").collect()] == [1]
    assert [r.id for r in sinks.read_days(spark, f"{tmp_path}/kept", at(0), at(20 * 86400)).collect()] == [2]


def test_query_history_sink(spark, tmp_path):
    folder = f"{tmp_path}/history"
    for n in range(2):
        sinks.append_query_history(spark, folder, query_id="q", query="level = ERROR", result_count=n, execution_time_ms=10, team_id="t", created_by="u", created_at=at(n))
    usage = query.saved_query_usage(spark.read.parquet(folder)).first()
    assert (usage.execution_count, usage.last_executed_at, usage.total_results) == (2, at(1), 1)


def test_ingest_keeps_good_rows(spark):
    rows = spark.createDataFrame([("error", "x" * 70_000, None), ("WARNING", "m", at(0)), (None, "m", at(0))], "level string, message string, timestamp timestamp")
    stored, rejected = ingest.ingest_logs(rows, at(5))
    row = stored.first()
    assert (row.level, len(row.message), row.timestamp) == ("ERROR", 70_000, at(5))
    assert (stored.count(), rejected.count()) == (1, 2)


def test_outbox_bodies(spark):
    history = spark.createDataFrame([("a1", "c", "t", "WARNING", 'say "hi"', at(0))], "id string, channel_id string, trap_id string, severity string, message string, created_at timestamp")
    names = spark.createDataFrame([("t", "Trap")], "trap_id string, name string")

    def sent(kind, config):
        channel = spark.createDataFrame([("c", kind, config, True)], "channel_id string, channel_type string, configuration string, is_active boolean")
        return [(r.target, r.body) for r in alerts.outbox(history, channel, names).collect()]

    target, body = sent("WEBHOOK", '{"url":"u"}')[0]
    assert target == "u" and json.loads(body)["message"] == 'say "hi"' and json.loads(body)["trapName"] == "Trap"
    card = json.loads(sent("TEAMS", '{"webhook_url":"w"}')[0][1])
    assert card["themeColor"] == "FFA500" and card["sections"][0]["activityTitle"] == "[WARNING] Trap"
    chat = json.loads(sent("SLACK", '{"webhook_url":"w"}')[0][1])
    assert chat["blocks"][0]["type"] == "header" and chat["blocks"][1]["fields"][2]["text"] == '*Message:* say "hi"'
    assert [t for t, _ in sent("EMAIL", '{"recipients":["a","b"]}')] == ["a", "b"]


def test_frequency_restriction_needs_service_and_level(spark):
    rows = entries(spark, [(n, 0, "a" if n % 2 else "b", "ERROR", "", at(n)) for n in range(6)])

    def counts(**extra):
        return [r.window_count for r in traps.window_counts(rows, {"window_seconds": 2, **extra}).orderBy("at").collect()]

    assert counts() == [1, 2, 3, 3, 3, 3]
    assert counts(service_name="a") == [1, 2, 3, 3, 3, 3]
    assert counts(service_name="a", log_level="error") == [0, 1, 1, 2, 1, 2]


def test_level_filter_reaches_the_scan(spark, tmp_path):
    entries(spark, [(1, 0, "a", "ERROR", "m", at(0))]).write.parquet(f"{tmp_path}/logs")
    stored = spark.read.parquet(f"{tmp_path}/logs")
    rows = query.filter_conditions(stored, [{"field": "level", "operator": ">=", "value": "ERROR"}], team_id=0).select("id")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "In(level, [ERROR,FATAL])" in plan and "EqualTo(team_id,0)" in plan and "message" not in plan


def test_required_literal(spark):
    cases = {
        "timeout": "timeout", "(?i)TimeOut now": "timeout now", "ab|timeout": None, "(timeout)": None, "time(out)?": None,
        "conn.*refused": "refused", "abcd?ef": "abc", "abc{0,2}def": "def", r"code \d+ failed": " failed", r"a\.bcd": "bcd", r"\x41bcd": None,
        r"\Qabc\E": None, "[abc]defg[^xyz]hi": "defg", "[a[bc]]defg": None, "ab": None, "": None, "übermut": "bermut", "abc+de": "abc", "(?s)abc": None,
        r"\bword\b": "word", r"\p{L}abc": None, "^start$": "start", "x*abc": "abc",
    }
    rows = spark.createDataFrame([(k, v) for k, v in cases.items()], "pattern string, want string")
    got = {r.pattern: r.got for r in rows.select("pattern", traps.required_literal(F.col("pattern")).alias("got")).collect()}
    assert got == cases


def test_rule_index_finds_what_the_predicates_find(spark):
    """Rules of every kind, filed or not, against each rule as a predicate of its own."""
    messages = ["Timeout at DB-1", "connection refused by db", "TIMEOUT", "time out", "a", "", None, "x.y abcdef", "abef", "straße ÜBER 😀 ok", "code 12 failed"]
    rows = entries(spark, [(n, team, f"svc-{n % 3}", ("INFO", "ERROR", "WARN")[n % 3], m, at(n)) for n, m in enumerate(messages) for team in (0, 1)])
    rows = rows.withColumn("host_name", F.when(F.col("id") % 2 == 0, "db-1"))

    def condition(kind, field, pattern, service=None, level=None):
        return {"condition_type": kind, "field": field, "pattern": pattern, "service_name": service, "log_level": level}

    lists = [
        [condition("KEYWORD", "message", "TimeOut")], [condition("KEYWORD", "message", "o")], [condition("KEYWORD", "message", "")],
        [condition("KEYWORD", "message", "db"), condition("REGEX", "message", "(?i)refused|timeout")], [condition("REGEX", "message", "abcd?ef")],
        [condition("REGEX", "message", "([")], [condition("KEYWORD", "nothing", "timeout")], [condition("KEYWORD", "message", None)], [],
        [condition("KEYWORD", "message", "ÜBER 😀", "svc-0", "INFO")], [condition("REGEX", "message", r"code \\d+ failed".replace("\\\\", "\\"))],
        [condition("KEYWORD", "hostName", "db-1", level="WARN"), condition("REGEX", "message", "^[Tt]")], [condition("FREQUENCY_THRESHOLD", "level", None, "svc-1")],
    ]
    rules = [{"trap_id": f"{n}/{team}", "team_id": team, "trap_type": "PATTERN", "is_active": True, "conditions": c} for n, c in enumerate(lists) for team in (0, 1)]
    got = sorted((r.id, r.trap_id) for r in traps.pattern_hits(rows, rules + rules[:2]).collect())
    full = traps._with_fields(rows)
    want = [(r.id, rule["trap_id"]) for rule in rules
            for r in full.where((F.col("team_id") == rule["team_id"]) & traps.pattern_predicate(spark, rule["conditions"])).collect()]
    assert got == sorted(want) and len(got) > 40
    for most in (0, 10**6):  # a large index is not broadcast, and gives the same
        traps.BROADCAST_RULES, before = most, traps.BROADCAST_RULES
        assert sorted((r.id, r.trap_id) for r in traps.pattern_hits(rows, rules).collect()) == got
        traps.BROADCAST_RULES = before
    assert traps.pattern_hits(rows, []).collect() == []


def _files(folder):
    return {str(p.relative_to(folder)): (p.stat().st_mtime_ns, p.read_bytes()) for p in folder.rglob("*.parquet")}


def test_policy_run_can_be_repeated(spark, tmp_path):
    day = 86400
    rows = entries(spark, [(n, 0, "s" if n % 2 else "x", "INFO", "m", at(n // 4 * day + n)) for n in range(40)])
    policies = spark.createDataFrame(
        [("p", 0, "s", None, 5, "ARCHIVE", "cold", True), ("q", 0, None, None, 7, "PURGE", None, True)],
        "policy_id string, team_id long, source_name string, log_level string, retention_days int, action string, archive_destination string, is_active boolean")
    store, cold = tmp_path / "store", tmp_path / "cold"
    sinks.append_by_day(rows, str(store))
    untouched = {k: v for k, v in _files(store).items() if k >= "day=2024-01-06"}
    changed = retention.apply_policies(spark, str(store), policies, at(10 * day), str(cold))
    assert len(changed["changed"]) == 5 and len(changed["emptied"]) == 3
    after = _files(store), _files(cold)
    assert {k: v for k, v in after[0].items() if k >= "day=2024-01-06"} == untouched and len(untouched) >= 5
    assert retention.apply_policies(spark, str(store), policies, at(10 * day), str(cold)) == {"changed": [], "emptied": []}
    assert (_files(store), _files(cold)) == after
    limit = at(5 * day)
    archived = sorted(r.id for r in spark.read.parquet(str(cold)).collect())
    assert archived == sorted(r.id for r in rows.where((F.col("service_name") == "s") & (F.col("timestamp") < F.lit(limit))).collect())
    # What a failed removal leaves behind is archived again by the same run, once.
    sinks.append_by_day(rows.where("id IN (1, 3)"), str(store))
    retention.apply_policies(spark, str(store), policies, at(10 * day), str(cold))
    assert sorted(r.id for r in spark.read.parquet(str(cold)).collect()) == archived
    later = retention.apply_policies(spark, str(store), policies, at(11 * day), str(cold))
    assert later["changed"] and len(spark.read.parquet(str(cold)).collect()) > len(archived)


def test_many_rules_do_not_share_their_grams(spark):
    rules = spark.range(3000).selectExpr(
        "concat('t-', id) AS trap_id", "0L AS team_id", "'PATTERN' AS trap_type", "true AS is_active",
        """array(named_struct('condition_type', 'KEYWORD', 'field', 'message', 'pattern', concat('USER ', id, ' '), 'log_level', CAST(NULL AS STRING),
            'service_name', CAST(NULL AS STRING), 'threshold', CAST(NULL AS BIGINT), 'window_seconds', CAST(NULL AS BIGINT))) AS conditions""")
    index = traps.rule_index(traps._prepared(rules))
    assert index.count() == 3000
    assert index.groupBy("_field", "_gram").count().agg(F.max("count")).first()[0] <= 2
    rows = entries(spark, [(n, 0, "s", "INFO", f"click by User {n} event 1{n} ", at(n)) for n in (7, 42, 999, 2999, 3000)])
    got = sorted((r.id, r.trap_id) for r in traps.pattern_hits(rows, rules).collect())
    assert got == [(n, f"t-{n}") for n in (7, 42, 999, 2999)]
