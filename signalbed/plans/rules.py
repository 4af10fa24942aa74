"""Traps and alerts."""

from pyspark.sql import functions as F

from signalbed.operators import alerts, traps
from signalbed.plans.registry import query, using
from signalbed.sources import tables as t
from signalbed.streaming import jobs, replay

AS_OF = "2024-01-31 00:00:00"


@query("b14_c03_pattern_traps", using("log_entries pattern_hits", "SELECT id, trap_id FROM pattern_hits"))
def pattern_traps(spark, folder):
    return traps.pattern_hits(t.log_entries(spark, folder), t.trap_rules()).select("id", "trap_id")


def _trap(*conditions):
    return [{"trap_id": "x", "team_id": team, "trap_type": "PATTERN", "is_active": True, "conditions": list(conditions)} for team in t.TEAMS]


@query("b15_regex_trap", using("document_logs", r"""
    SELECT id, service_name FROM document_logs WHERE regexp_matches(message, '(?i)\bcopyright\b|<h1>[^<]*</h1>')"""))
def regex_trap(spark, folder):
    rows = t.document_logs(spark, folder).withColumn("team_id", F.lit(0))
    rule = _trap({"condition_type": "REGEX", "field": "message", "pattern": r"(?i)\bcopyright\b|<h1>[^<]*</h1>"})
    return traps.pattern_hits(rows, rule).select("id", "service_name")


@query("b15_bad_regex_trap", using("log_entries", r"""
    SELECT id, 'good' AS trap_id FROM log_entries WHERE regexp_matches(message, 'event [0-9]*7( |$)')"""))
def bad_regex_trap(spark, folder):
    """A pattern that does not compile never matches, and the good one next to it still does."""
    rows = t.log_entries(spark, folder)
    rules = []
    for name, pattern in (("bad", "(["), ("good", "event [0-9]*7( |$)")):
        rules += [{**trap, "trap_id": name} for trap in _trap({"condition_type": "REGEX", "field": "message", "pattern": pattern})]
    return traps.pattern_hits(rows, rules).select("id", "trap_id")


@query("b14_rules_of_a_table", using("log_entries", """
    SELECT l.id, concat('watch-', c.c_custkey) AS trap_id FROM log_entries l JOIN customer c ON l.team_id = c.c_custkey % 3
    WHERE contains(l.message, concat('user ', c.c_custkey, ' ')) AND l.level IN ('WARN', 'ERROR', 'FATAL')"""))
def rules_of_a_table(spark, folder):
    """One trap per customer, from a table: the plan does not grow with the rules."""
    condition = """named_struct('condition_type', 'KEYWORD', 'field', 'message', 'pattern', concat('USER ', c_custkey, ' '),
        'log_level', 'WARN', 'service_name', CAST(NULL AS STRING), 'threshold', CAST(NULL AS BIGINT), 'window_seconds', CAST(NULL AS BIGINT))"""
    rules = t.table(spark, folder, "customer").selectExpr(
        "concat('watch-', c_custkey) AS trap_id", "CAST(c_custkey % 3 AS BIGINT) AS team_id", "'PATTERN' AS trap_type", "true AS is_active",
        f"array({condition}) AS conditions")
    return traps.pattern_hits(t.log_entries(spark, folder), rules).select("id", "trap_id")


@query("b16_d14_keyword_trap", using("document_logs", """
    SELECT id, service_name FROM document_logs WHERE contains(lower(message), 'license')"""))
def keyword_trap(spark, folder):
    rows = t.document_logs(spark, folder).withColumn("team_id", F.lit(0))
    return traps.pattern_hits(rows, _trap({"condition_type": "KEYWORD", "field": "message", "pattern": "LicenSe"})).select("id", "service_name")


@query("b17_trap_fields", using("log_entries", """
    SELECT id FROM log_entries WHERE contains(lower(exception_message), 'code 1') AND contains(host_name, 'host-1')
      AND regexp_matches(thread_name, '[2-5]$')"""))
def trap_fields(spark, folder):
    rule = _trap(
        {"condition_type": "KEYWORD", "field": "exceptionMessage", "pattern": "Code 1"},
        {"condition_type": "KEYWORD", "field": "host_name", "pattern": "HOST-1"},
        {"condition_type": "REGEX", "field": "threadName", "pattern": "[2-5]$"},
    )
    return traps.pattern_hits(t.log_entries(spark, folder), rule).select("id")


@query("b18_level_at_or_above", using("log_entries", """
    SELECT id FROM log_entries WHERE service_name = 'svc-2' AND level IN ('WARN', 'ERROR', 'FATAL')"""))
def level_at_or_above(spark, folder):
    rule = _trap({"condition_type": "FREQUENCY_THRESHOLD", "field": "level", "service_name": "svc-2", "log_level": "WARN"})
    return traps.pattern_hits(t.log_entries(spark, folder), rule).select("id")


RULE_ROWS = """
    SELECT event_id AS id, ['REGEX', 'keyword', 'FREQUENCY_THRESHOLD', 'ABSENCE', 'OTHER'][event_id % 5 + 1] AS condition_type,
      CASE WHEN event_id % 3 > 0 THEN user_id END AS threshold, CASE WHEN event_id % 4 > 0 THEN user_id END AS window_seconds,
      CASE WHEN event_id % 7 = 0 THEN 'LOUD' WHEN event_id % 7 > 3 THEN 'error' END AS log_level FROM events"""


@query("b23_rule_validation", using("", """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN condition_type = 'OTHER' THEN 'unknown condition type' END AS reason FROM rows
      UNION ALL SELECT CASE WHEN condition_type = 'FREQUENCY_THRESHOLD' AND threshold IS NULL THEN 'threshold is missing' END FROM rows
      UNION ALL SELECT CASE WHEN condition_type IN ('FREQUENCY_THRESHOLD', 'ABSENCE') AND window_seconds IS NULL THEN 'window is missing' END FROM rows
      UNION ALL SELECT CASE WHEN log_level = 'LOUD' THEN 'unknown log level' END FROM rows)
    WHERE reason IS NOT NULL GROUP BY reason""", rows=RULE_ROWS))
def rule_validation(spark, folder):
    rows = t.events(spark, folder).selectExpr(
        "event_id AS id", "array('REGEX', 'keyword', 'FREQUENCY_THRESHOLD', 'ABSENCE', 'OTHER')[CAST(event_id % 5 AS INT)] AS condition_type",
        "CASE WHEN event_id % 3 > 0 THEN user_id END AS threshold", "CASE WHEN event_id % 4 > 0 THEN user_id END AS window_seconds",
        "CASE WHEN event_id % 7 = 0 THEN 'LOUD' WHEN event_id % 7 > 3 THEN 'error' END AS log_level",
    )
    found = traps.condition_reject_reasons(rows).select(F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("b23_policy_validation", """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN event_type NOT IN ('view', 'click') THEN 'unknown action' END AS reason FROM events
      UNION ALL SELECT CASE WHEN event_type = 'view' AND event_id % 2 = 0 THEN 'archive destination is missing' END FROM events
      UNION ALL SELECT CASE WHEN event_id % 400 NOT BETWEEN 1 AND 365 THEN 'retention days out of range' END FROM events)
    WHERE reason IS NOT NULL GROUP BY reason""")
def policy_validation(spark, folder):
    rows = t.events(spark, folder).selectExpr(
        "CASE event_type WHEN 'view' THEN 'archive' WHEN 'click' THEN 'PURGE' ELSE event_type END AS action",
        "CASE WHEN event_id % 2 = 1 THEN 'folder' END AS archive_destination", "event_id % 400 AS retention_days",
    )
    found = traps.policy_reject_reasons(rows).select(F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


CONDITIONS = [
    {"condition_type": "KEYWORD", "field": "message", "pattern": "TIMEOUT", "log_level": "WARN"},
    {"condition_type": "REGEX", "field": "message", "pattern": "event [0-9]*[05] "},
]
MATCH = "contains(message, 'timeout') AND level IN ('WARN', 'ERROR', 'FATAL') AND regexp_matches(message, 'event [0-9]*[05] ')"
BACK = "team_id = 1 AND timestamp >= TIMESTAMP '2024-01-03' AND timestamp <= TIMESTAMP '2024-01-31'"


@query("e22_back_test", using("log_entries", f"""
    SELECT count(*) FILTER ({MATCH}) AS match_count, count(*) AS total_evaluated,
      round(count(*) FILTER ({MATCH}) * 100.0::DOUBLE / count(*), 6) AS match_percentage FROM log_entries WHERE {BACK}"""))
def back_test(spark, folder):
    rows = traps.back_test(t.log_entries(spark, folder), CONDITIONS, 1, "2024-01-03", "2024-01-31")
    return rows.withColumn("match_percentage", F.round("match_percentage", 6))


@query("e22_back_test_samples", using("log_entries", f"""
    SELECT id, timestamp FROM log_entries WHERE {BACK} AND {MATCH}"""))
def back_test_samples(spark, folder):
    return traps.back_test_samples(t.log_entries(spark, folder), CONDITIONS, 1, "2024-01-03", "2024-01-31")


@query("f01_window_counts", using("log_entries", """
    SELECT id, count(*) FILTER (service_name = 'svc-1' AND level = 'ERROR') OVER (PARTITION BY team_id ORDER BY epoch_us(timestamp)
      RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS window_count FROM log_entries"""))
def window_counts(spark, folder):
    condition = {"window_seconds": 86400, "service_name": "svc-1", "log_level": "ERROR"}
    rows = t.log_entries(spark, folder).select("id", "team_id", "timestamp", "service_name", "level")
    counts = traps.window_counts(rows, condition)
    return rows.withColumn("at", F.unix_micros("timestamp")).join(counts, ["team_id", "at"]).select("id", "window_count")


@query("f01_frequency_traps", using("log_entries", """
    SELECT id, concat('burst-', team_id) AS trap_id FROM (
      SELECT *, count(*) OVER (PARTITION BY team_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n
      FROM log_entries) WHERE n >= 6"""))
def frequency_traps(spark, folder):
    return traps.frequency_hits(t.log_entries(spark, folder), t.trap_rules()).select("id", "trap_id")


@query("f02_absences", using("log_entries", """
    SELECT r.team_id, r.trap_id, r.condition, count(l.id) AS seen, count(l.id) = 0 AS absent
    FROM (VALUES (0, 'quiet-0', 0), (1, 'quiet-1', 0), (2, 'quiet-2', 0)) r(team_id, trap_id, condition)
    LEFT JOIN log_entries l ON l.team_id = r.team_id AND l.timestamp >= TIMESTAMP '2024-01-30 23:15:00' AND l.timestamp <= TIMESTAMP '2024-01-30 23:45:00'
    GROUP BY ALL"""))
def absences(spark, folder):
    return traps.absences(t.log_entries(spark, folder), t.trap_rules(), "2024-01-30 23:45:00")


GAP_START, GAP_END = "2024-01-05 00:00:00", "2024-01-30 12:00:00"


def _absence_rules(spark, folder):
    """The quiet rules, and one per customer's nation: a service and level each, or all of the team, in windows of their own."""
    nations = t.table(spark, folder, "nation").selectExpr(
        "concat('gap-', n_nationkey) AS trap_id", "CAST(n_nationkey % 3 AS BIGINT) AS team_id", "'ABSENCE' AS trap_type", "true AS is_active",
        """array(named_struct('condition_type', 'ABSENCE', 'field', 'level', 'pattern', CAST(NULL AS STRING),
            'log_level', IF(n_nationkey % 5 = 4, NULL, array('ERROR', 'info', 'FATAL', 'DEBUG')[CAST(n_nationkey % 5 AS INT)]),
            'service_name', concat('svc-', n_nationkey % 7), 'threshold', CAST(NULL AS BIGINT), 'window_seconds', CAST(3600 * n_nationkey + 60 AS BIGINT))) AS conditions""")
    return traps.trap_table(spark, t.trap_rules()).unionByName(nations.select("trap_id", "team_id", "trap_type", "is_active", "conditions"))


GAP_RULES = """
    SELECT n_nationkey % 3 AS team_id, concat('gap-', n_nationkey) AS trap_id, CASE WHEN n_nationkey % 5 < 4 THEN concat('svc-', n_nationkey % 7) END AS service,
      CASE n_nationkey % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'INFO' WHEN 2 THEN 'FATAL' WHEN 3 THEN 'DEBUG' END AS own_level, 3600 * n_nationkey + 60 AS width
    FROM nation
    UNION ALL SELECT t.team_id, concat('quiet-', t.team_id), NULL, NULL, 1800 FROM (VALUES (0), (1), (2)) t(team_id)"""
GAP_POINTS = f"""
    SELECT r.trap_id, l.timestamp AS moment FROM gap_rules r JOIN log_entries l ON l.team_id = r.team_id
      AND (r.service IS NULL OR (l.service_name = r.service AND l.level = r.own_level)) AND l.timestamp <= TIMESTAMP '{GAP_END}'
    UNION SELECT trap_id, TIMESTAMP '2000-01-01' FROM gap_rules UNION SELECT trap_id, TIMESTAMP '{GAP_END}' + INTERVAL 1 MICROSECOND FROM gap_rules"""
GAPS = f"""
    SELECT team_id, trap_id, absent_from, CASE WHEN moment <= TIMESTAMP '{GAP_END}' THEN moment END AS absent_until, moment > TIMESTAMP '{GAP_END}' AS still_absent
    FROM (SELECT r.team_id, r.trap_id, p.moment, greatest(lag(p.moment) OVER (PARTITION BY p.trap_id ORDER BY p.moment) + to_seconds(r.width) + INTERVAL 1 MICROSECOND,
        TIMESTAMP '{GAP_START}') AS absent_from, lag(p.moment) OVER (PARTITION BY p.trap_id ORDER BY p.moment) AS seen
      FROM gap_points p JOIN gap_rules r ON p.trap_id = r.trap_id)
    WHERE seen IS NOT NULL AND absent_from < moment"""


@query("f02_gaps", using("log_entries", GAPS, gap_rules=GAP_RULES, gap_points=GAP_POINTS))
def gaps(spark, folder):
    """All spans of the month in which an absence rule held, rules with and without entries alike."""
    rows = traps.absence_gaps(t.log_entries(spark, folder), _absence_rules(spark, folder), GAP_START, GAP_END)
    return rows.select("team_id", "trap_id", "absent_from", "absent_until", "still_absent")


def _hits(spark, folder):
    return traps.pattern_hits(t.log_entries(spark, folder), t.trap_rules())


def _fires(spark, folder):
    return alerts.fan_out(_hits(spark, folder), t.alert_rules(spark))


@query("c04_alert_fan_out", using("log_entries pattern_hits rules fires", "SELECT rule_id, trap_id, entry_id, fired_at, severity FROM fires"))
def alert_fan_out(spark, folder):
    return _fires(spark, folder).select("rule_id", "trap_id", "entry_id", "fired_at", "severity")


@query("d12_trigger_messages", using("log_entries pattern_hits rules fires", "SELECT rule_id, entry_id, message FROM fires"))
def trigger_messages(spark, folder):
    return _fires(spark, folder).select("rule_id", "entry_id", "message")


@query("c05_throttled_by_history", using("log_entries pattern_hits rules fires", """
    SELECT f.rule_id, f.entry_id, f.fired_at FROM fires f LEFT JOIN (SELECT rule_id, max(fired_at) AS last FROM fires
      WHERE fired_at < TIMESTAMP '2024-01-15' GROUP BY rule_id) h ON f.rule_id = h.rule_id
    WHERE f.fired_at >= TIMESTAMP '2024-01-15' AND (h.last IS NULL OR NOT h.last > f.fired_at - to_minutes(f.throttle))"""))
def throttled_by_history(spark, folder):
    fires = _fires(spark, folder)
    new = F.col("fired_at") >= F.lit("2024-01-15").cast("timestamp")
    history = fires.where(~new).select("rule_id", F.col("fired_at").alias("created_at"))
    return alerts.not_recently_fired(fires.where(new), history).select("rule_id", "entry_id", "fired_at")


# One row per rule and time, each with the next time that is free again; then a walk along them.
WALK = """
    SELECT rule_id, entry_id, fired_at FROM walk
    UNION ALL SELECT rule_id, entry_id, fired_at FROM fires WHERE throttle = 0"""
ONCE = "SELECT rule_id, throttle, fired_at, min(entry_id) AS entry_id FROM fires WHERE throttle > 0 GROUP BY ALL"
NEXT = """
    SELECT a.*, (SELECT min(b.fired_at) FROM once b WHERE b.rule_id = a.rule_id AND b.fired_at >= a.fired_at + to_minutes(a.throttle)) AS next
    FROM once a"""
STEPS = """
    SELECT * FROM (SELECT * FROM nexts QUALIFY row_number() OVER (PARTITION BY rule_id ORDER BY fired_at) = 1)
    UNION ALL SELECT n.* FROM walk w JOIN nexts n ON n.rule_id = w.rule_id AND n.fired_at = w.next"""


@query("f04_throttled_alerts", using("log_entries pattern_hits rules fires", WALK, once=ONCE, nexts=NEXT, walk=STEPS))
def throttled_alerts(spark, folder):
    return alerts.throttle(_fires(spark, folder)).select("rule_id", "entry_id", "fired_at")


@query("i02_pattern_stream", using("log_entries pattern_hits", "SELECT id, trap_id FROM pattern_hits"))
def pattern_stream(spark, folder):
    """What the pattern stream emits, on the same entries as a batch."""
    return jobs.pattern_stream(t.log_entries(spark, folder), t.trap_rules()).select("id", "trap_id")


@query("i03_frequency_windows", using("log_entries", """
    SELECT team_id, "start", "start" + INTERVAL 1 HOUR AS "end", count(*) AS n FROM (
      SELECT l.team_id, time_bucket(INTERVAL 10 MINUTE, l.timestamp) - to_minutes(CAST(10 * k.range AS INT)) AS "start" FROM log_entries l, range(6) k)
    GROUP BY team_id, "start" HAVING count(*) >= 6"""))
def frequency_windows(spark, folder):
    """Windows of an hour, every ten minutes, in which a team reaches the threshold; as a batch."""
    rows = jobs.frequency_windows(t.log_entries(spark, folder), {"window_seconds": 3600, "threshold": 6}, slide="10 minutes")
    return rows.select("team_id", "start", "end", "n")


# What a stream has closed: all up to the watermark, which lies ten minutes and a millisecond before the newest row.
CLOSED = "epoch_us({}) // 1000 + 1 < (SELECT max(epoch_us(timestamp)) // 1000 - 600000 FROM {})"


@query("i03_frequency_stream", using("log_entries", f"""
    SELECT id, concat('burst-', team_id) AS trap_id, timestamp FROM (
      SELECT *, count(*) OVER (PARTITION BY team_id ORDER BY epoch_us(timestamp) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS n
      FROM log_entries) WHERE n >= 6 AND {CLOSED.format('timestamp', 'log_entries')}"""))
def frequency_stream(spark, folder):
    """The stream over all events: each entry at which the frequency trap fires."""
    return replay.run_to_end(replay.frequency_stream(t.log_entries(spark, folder, stream=True), t.trap_rules()))


@query("i04_absence_stream", using("log_entries", f"""
    SELECT team_id, trap_id, absent_from, NULL::TIMESTAMP AS absent_until FROM gaps WHERE {CLOSED.format('absent_from', 'log_entries')}
    UNION ALL SELECT team_id, trap_id, absent_from, absent_until FROM gaps WHERE {CLOSED.format('absent_until', 'log_entries')}""",
    gap_rules=GAP_RULES, gap_points=GAP_POINTS.replace(GAP_END, "2024-02-29 00:00:00"),
    gaps=GAPS.replace(GAP_END, "2024-02-29 00:00:00").replace(GAP_START, "2024-01-01 00:00:00")))
def absence_stream(spark, folder):
    """The stream over all events: each gap as it is noticed, and as it ends."""
    rows = replay.absence_rule_stream(t.log_entries(spark, folder, stream=True), _absence_rules(spark, folder), "2024-01-01 00:00:00")
    return replay.run_to_end(rows).select("team_id", "trap_id", "absent_from", "absent_until")


@query("i05_throttle_stream", using("log_entries pattern_hits rules fires", f"""
    SELECT rule_id, entry_id, fired_at FROM walk WHERE {CLOSED.format('fired_at', '(SELECT fired_at AS timestamp FROM fires WHERE throttle > 0)')}
    UNION ALL SELECT rule_id, entry_id, fired_at FROM fires WHERE throttle = 0""", once=ONCE, nexts=NEXT, walk=STEPS))
def throttle_stream(spark, folder):
    """The stream over all events: pattern traps, fan-out to the rules, throttling."""
    hits = jobs.pattern_stream(t.log_entries(spark, folder, stream=True), t.trap_rules())
    rows = replay.throttle_stream(alerts.fan_out(hits, t.alert_rules(spark)))
    return replay.run_to_end(rows).select("rule_id", "entry_id", "fired_at")


@query("i08_trap_statistics", using("log_entries pattern_hits", """
    SELECT trap_id, count(*) AS trigger_count, max(timestamp) AS last_triggered_at FROM pattern_hits GROUP BY trap_id"""))
def trap_statistics(spark, folder):
    return traps.trap_statistics(_hits(spark, folder))


def _named(spark, folder):
    h = t.alert_history(spark, folder)
    rules = h.select("rule_id", F.concat(F.lit("Rule "), "rule_id").alias("name")).distinct().where("rule_id <> 'rule-5'")
    traps_ = h.select("trap_id", F.concat(F.lit("Trap "), "trap_id").alias("name")).distinct()
    channels = h.select("channel_id", F.concat(F.lit("Channel "), "channel_id").alias("name")).distinct()
    return h, rules, traps_, channels


@query("c02_alert_names", using("alert_history", """
    SELECT id, concat('Rule ', rule_id) AS rule_name, concat('Trap ', trap_id) AS trap_name, concat('Channel ', channel_id) AS channel_name
    FROM alert_history WHERE rule_id <> 'rule-5'"""))
def alert_names(spark, folder):
    return alerts.with_names(*_named(spark, folder)).select("id", "rule_name", "trap_name", "channel_name")


@query("e10_active_alerts", using("alert_history", """
    SELECT s.severity, count(h.id) AS active FROM (VALUES ('INFO'), ('WARNING'), ('CRITICAL')) s(severity)
    LEFT JOIN alert_history h ON h.severity = s.severity AND h.status IN ('FIRED', 'ACKNOWLEDGED') AND h.team_id = 1 GROUP BY s.severity"""))
def active_alerts(spark, folder):
    return alerts.active_alert_counts(t.alert_history(spark, folder), 1)


def _alerts(spark, folder):
    """Alerts to act on; every ninth is resolved already."""
    rows = t.alert_actions(spark, folder).select("alert_id").distinct()
    return rows.withColumn("status", F.when(F.col("alert_id") % 9 == 0, "RESOLVED").otherwise("FIRED"))


FIRSTS = """
    SELECT alert_id, min(action_id) FILTER (status = 'RESOLVED') AS first FROM alert_actions GROUP BY alert_id"""


@query("f12_alert_life_cycle", using("alert_actions", """
    SELECT alert_id, CASE WHEN alert_id % 9 = 0 OR r IS NOT NULL THEN 'RESOLVED' WHEN a IS NOT NULL THEN 'ACKNOWLEDGED' ELSE 'FIRED' END AS status,
      coalesce(a.user_id, r.user_id) AS acknowledged_by, coalesce(a.at, r.at) AS acknowledged_at,
      r.user_id AS resolved_by, r.at AS resolved_at, n + CASE WHEN r IS NULL THEN 0 ELSE 1 END AS accepted_actions
    FROM (SELECT x.alert_id, arg_max({'user_id': x.user_id, 'at': x.at}, x.action_id) FILTER (x.status = 'ACKNOWLEDGED' AND x.alert_id % 9 > 0
        AND (f.first IS NULL OR x.action_id < f.first)) AS a,
      arg_min({'user_id': x.user_id, 'at': x.at}, x.action_id) FILTER (x.status = 'RESOLVED' AND x.alert_id % 9 > 0) AS r,
      count(*) FILTER (x.status = 'ACKNOWLEDGED' AND x.alert_id % 9 > 0 AND (f.first IS NULL OR x.action_id < f.first)) AS n
      FROM alert_actions x JOIN firsts f ON x.alert_id = f.alert_id GROUP BY x.alert_id)""", firsts=FIRSTS))
def alert_life_cycle(spark, folder):
    return alerts.apply_actions(_alerts(spark, folder), t.alert_actions(spark, folder))


@query("f12_rejected_actions", using("alert_actions", """
    SELECT x.action_id, x.alert_id, CASE WHEN x.status = 'FIRED' THEN 'cannot go back to FIRED' ELSE 'alert is resolved' END AS reason
    FROM alert_actions x JOIN firsts f ON x.alert_id = f.alert_id
    WHERE x.status = 'FIRED' OR x.alert_id % 9 = 0 OR x.action_id > f.first""", firsts=FIRSTS))
def rejected_actions(spark, folder):
    rows = alerts.rejected_actions(_alerts(spark, folder), t.alert_actions(spark, folder))
    return rows.select("action_id", "alert_id", "reason")


def _trap_names(spark):
    return spark.createDataFrame([(x["trap_id"], x["name"]) for x in t.trap_rules()], "trap_id string, name string")


OUTBOX_ROWS = """
    SELECT concat(f.rule_id, '/', f.entry_id) AS alert_id, r.channel_id, f.severity, f.message,
      CASE WHEN f.trap_id LIKE 'timeouts%' THEN 'Timeouts' ELSE 'Fatal' END AS trap,
      upper(split_part(r.channel_id, '-', 1)) AS channel_type, strftime(f.fired_at, '%Y-%m-%dT%H:%M:%S.%fZ') AS stamp
    FROM fires f JOIN rules r ON f.rule_id = r.rule_id"""


@query("d13_outbox", using("log_entries pattern_hits rules fires", """
    SELECT alert_id, channel_id, channel_type, target, CASE channel_type
      WHEN 'WEBHOOK' THEN concat('{"severity":"', severity, '","trapName":"', trap, '","message":"', message, '","timestamp":"', stamp,
        '","service":"signalbed"}')
      WHEN 'TEAMS' THEN concat('{"@type":"MessageCard","@context":"http://schema.org/extensions","themeColor":"',
        CASE severity WHEN 'CRITICAL' THEN 'FF0000' WHEN 'WARNING' THEN 'FFA500' ELSE '0076D7' END,
        '","summary":"Log alert","sections":[{"activityTitle":"[', severity, '] ', trap, '","facts":[{"name":"Severity","value":"', severity,
        '"},{"name":"Trap","value":"', trap, '"},{"name":"Message","value":"', message, '"},{"name":"Time","value":"', stamp, '"}],"markdown":true}]}')
      WHEN 'SLACK' THEN concat('{"text":"Log alert: [', severity, '] ', trap,
        '","blocks":[{"text":{"text":"Log alert","type":"plain_text"},"type":"header"},{"fields":[{"text":"*Severity:* ', severity,
        '","type":"mrkdwn"},{"text":"*Trap:* ', trap, '","type":"mrkdwn"},{"text":"*Message:* ', message,
        '","type":"mrkdwn"}],"type":"section"}]}')
      ELSE concat('[Log alert] [', severity, '] ', trap, ' - ', message) END AS body
    FROM (SELECT *, unnest(CASE channel_type WHEN 'EMAIL' THEN ['a@example.org', 'b@example.org'] WHEN 'SLACK' THEN ['https://chat.example.org/hook']
        WHEN 'TEAMS' THEN ['https://card.example.org/hook'] ELSE ['https://hook.example.org/x'] END) AS target FROM outbox_rows)""",
    outbox_rows=OUTBOX_ROWS))
def outbox(spark, folder):
    history = alerts.to_history(_fires(spark, folder))
    return alerts.outbox(history, t.alert_channels(spark), _trap_names(spark))
