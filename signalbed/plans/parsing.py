"""Raw lines, topic records, ingest and validation."""

from pyspark.sql import functions as F

from signalbed.functions.levels import normal_level
from signalbed.functions.times import parse_time
from signalbed.operators import ingest, parse
from signalbed.operators.alerts import ALERT_TEXT, trigger_message
from signalbed.plans.logs import SOURCES_SQL, sources
from signalbed.plans.registry import query, using
from signalbed.sources import tables as t

NOW = "2024-02-01 00:00:00"

# What the five line formats of ``raw_logs`` hold, said from the events directly.
PARSED_SQL = """
    SELECT event_id AS id, user_id % 3 AS team_id,
      ['json', 'key_value', 'spring_boot', 'syslog', 'plain'][event_id % 5 + 1] AS log_format,
      CASE event_id % 5 WHEN 0 THEN CASE event_type WHEN 'error' THEN 'error' ELSE 'INFO' END WHEN 1 THEN 'WARN' WHEN 2 THEN 'INFO'
        WHEN 3 THEN ['FATAL', 'FATAL', 'FATAL', 'ERROR', 'WARN', 'INFO', 'INFO', 'DEBUG'][user_id % 8 + 1] ELSE 'INFO' END AS level,
      CASE event_id % 5 WHEN 0 THEN concat(event_type, ' by user ', user_id) WHEN 1 THEN concat(event_type, ' by user ', user_id)
        WHEN 2 THEN concat('done in ', event_id, ' steps') WHEN 3 THEN concat('request ', event_id, ' served')
        ELSE concat(event_type, ' happened to user ', user_id) END AS message,
      CASE event_id % 5 WHEN 0 THEN ts WHEN 1 THEN date_trunc('millisecond', ts) WHEN 2 THEN date_trunc('millisecond', ts) END AS timestamp,
      CASE event_id % 5 WHEN 0 THEN concat('svc-', user_id % 5) WHEN 1 THEN CASE WHEN event_id % 2 = 0 THEN 'fallback' ELSE 'unknown' END
        WHEN 2 THEN concat('svc-', user_id % 5) WHEN 3 THEN concat('app-', event_type)
        ELSE CASE WHEN event_id % 2 = 0 THEN 'fallback' END END AS service_name,
      CASE WHEN event_id % 5 IN (0, 2) THEN concat('t-', event_id // 8) END AS trace_id,
      CASE WHEN event_id % 5 IN (1, 2) THEN concat('s-', event_id) END AS span_id,
      CASE WHEN event_id % 5 = 2 THEN concat('app.', event_type) END AS logger_name,
      CASE WHEN event_id % 5 = 2 THEN 'main' END AS thread_name,
      CASE WHEN event_id % 5 = 0 AND event_type = 'error' THEN 'app.AppError' END AS exception_class,
      CASE WHEN event_id % 5 = 0 AND event_type = 'error' THEN concat('code ', user_id) END AS exception_message,
      CASE WHEN event_id % 5 = 0 THEN concat('{"user":"', user_id, '","tag":"null"}') END AS custom_fields,
      CASE WHEN event_id % 5 IN (1, 3) THEN concat('host-', user_id % 4) END AS host_name
    FROM events"""
PARSED = (
    "id", "team_id", "log_format", "level", "message", "timestamp", "service_name", "trace_id", "span_id", "logger_name",
    "thread_name", "exception_class", "exception_message", "custom_fields", "host_name",
)


def _parsed(spark, folder):
    return parse.parse_raw_logs(t.raw_logs(spark, folder), "raw", F.col("default_service"))


def _topic(spark, folder):
    """Raw lines as topic records; some carry no usable team."""
    team = F.concat(F.lit("00000000-0000-0000-0000-00000000000"), F.col("team_id"))
    team = F.when(F.col("id") % 13 == 0, "not-a-team").otherwise(team)
    structured = F.concat(
        F.lit('{"level":"warn","message":"seen '), F.col("id"), F.lit('","timestamp":"2024-01-02T03:04:05","hostName":"h"}')
    )
    return t.raw_logs(spark, folder).select(
        F.when(F.col("id") % 7 == 0, structured).otherwise(F.col("raw")).cast("binary").alias("value"),
        F.when(F.col("id") % 2 == 0, F.lit("keyed")).cast("binary").alias("key"),
        F.array(F.struct(F.lit("other").alias("key"), F.lit("x").cast("binary").alias("value")),
                F.struct(F.lit("X-Team-Id").alias("key"), team.cast("binary").alias("value"))).alias("headers"),
        "id",
    )


def _one_format(name: str) -> str:
    return using("", f"SELECT {', '.join(PARSED)} FROM parsed WHERE log_format = '{name}'", parsed=PARSED_SQL)


@query("d01_parse_cascade", using("", "SELECT log_format, level, service_name, count(*) AS n FROM parsed GROUP BY ALL", parsed=PARSED_SQL))
def parse_cascade(spark, folder):
    return _parsed(spark, folder).groupBy("log_format", "level", "service_name").agg(F.count(F.lit(1)).alias("n"))


def _parse_query(number: str, form: str) -> None:
    @query(f"{number}_parse_{form}", _one_format(form))
    def parse_one(spark, folder):
        return _parsed(spark, folder).where(F.col("log_format") == form).select(*PARSED)


for _number, _form in (("d02", "json"), ("d03", "key_value"), ("d04", "spring_boot"), ("d04b", "syslog"), ("d04c", "plain")):
    _parse_query(_number, _form)


@query("d04_control_characters", """
    SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'spring_boot' ELSE 'syslog' END AS log_format,
      CASE WHEN event_id % 2 = 0 THEN concat('ma', chr(1), 'in') END AS thread_name,
      CASE WHEN event_id % 2 = 0 THEN concat('a', chr(1), 'B') END AS logger_name,
      CASE WHEN event_id % 2 = 1 THEN concat('ho', chr(1), 'st') END AS host_name,
      CASE WHEN event_id % 2 = 1 THEN 'app' ELSE 'svc' END AS service_name,
      concat('step', chr(1), event_id) AS message FROM events""")
def control_characters(spark, folder):
    """Control characters inside a line stay where they are."""
    rows = t.events(spark, folder).selectExpr("event_id AS id", """CASE WHEN event_id % 2 = 0
        THEN concat('2024-01-15 10:30:45.123 INFO [svc,t,s] 7 --- [ ma', char(1), 'in] a', char(1), 'B : step', char(1), event_id)
        ELSE concat('<14>Jan 15 10:30:45 ho', char(1), 'st app[3]: step', char(1), event_id) END AS raw""")
    return parse.parse_raw_logs(rows).select("id", "log_format", "thread_name", "logger_name", "host_name", "service_name", "message")


@query("d04_long_texts", using("document_logs", """
    SELECT service_name, count(*) AS n, sum(CASE WHEN id % 50 = 0 THEN 40 ELSE 1 END * length(message))::BIGINT AS chars
    FROM document_logs GROUP BY service_name"""))
def long_texts(spark, folder):
    """Whole documents and pages, each as one message and some of them very long, stored with their full length."""
    rows = t.document_logs(spark, folder).withColumns({
        "message": F.when(F.col("id") % 50 == 0, F.repeat("message", F.lit(40))).otherwise(F.col("message")), "level": F.lit("info"), "timestamp": F.lit(None).cast("timestamp"),
    })
    stored, _ = ingest.ingest_logs(rows, NOW)
    return stored.groupBy("service_name").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("message")).alias("chars"))


@query("d05_service_default", using("", "SELECT id, service_name FROM parsed WHERE log_format <> 'plain'", parsed=PARSED_SQL))
def service_default(spark, folder):
    return _parsed(spark, folder).where("log_format <> 'plain'").select("id", "service_name")


@query("d06_reject_reasons", using("", """
    SELECT reason, count(*) AS n FROM (
      SELECT CASE WHEN trim(message) = '' THEN 'message is blank' END AS reason FROM rows
      UNION ALL SELECT CASE WHEN service_name IS NULL THEN 'service_name is blank' END FROM rows
      UNION ALL SELECT CASE WHEN length(message) > 65536 THEN 'message is too long' END FROM rows
      UNION ALL SELECT CASE WHEN length(logger_name) > 500 THEN 'logger_name is too long' END FROM rows)
    WHERE reason IS NOT NULL GROUP BY reason""",
    rows="SELECT CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS message, CASE WHEN doc_id % 3 <> 0 THEN source END AS service_name,"
         " text AS logger_name FROM documents"))
def reject_reasons(spark, folder):
    rows = t.table(spark, folder, "documents").selectExpr(
        "'INFO' AS level", "CASE WHEN doc_id % 5 = 0 THEN ' ' ELSE text END AS message",
        "CASE WHEN doc_id % 3 <> 0 THEN source END AS service_name", "text AS logger_name",
    )
    found = ingest.log_reject_reasons(rows).select(F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("d07_time_forms", """
    SELECT event_id AS id, CASE event_id % 7 WHEN 0 THEN ts WHEN 1 THEN date_trunc('second', ts) WHEN 2 THEN date_trunc('millisecond', ts)
      WHEN 3 THEN date_trunc('millisecond', ts) WHEN 4 THEN date_trunc('second', ts) WHEN 5 THEN date_trunc('millisecond', ts) END AS time
    FROM events""")
def time_forms(spark, folder):
    text = F.expr("""CASE event_id % 7 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
        WHEN 1 THEN CAST(unix_seconds(ts) AS STRING) WHEN 2 THEN CAST(unix_millis(ts) AS STRING)
        WHEN 3 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSS') WHEN 4 THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss')
        WHEN 5 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS") ELSE date_format(ts, 'yyyy-MM-dd') END""")
    return t.events(spark, folder).withColumn("text", text).select(F.col("event_id").alias("id"), parse_time(F.col("text")).alias("time"))


@query("d08_level_normalise", """
    SELECT event_type, CASE WHEN event_type = 'error' THEN 'ERROR' END AS level, count(*) AS n FROM events GROUP BY event_type""")
def level_normalise(spark, folder):
    rows = t.events(spark, folder).select("event_type", normal_level(F.initcap("event_type")).alias("level"))
    return rows.groupBy("event_type", "level").agg(F.count(F.lit(1)).alias("n"))


@query("d09_truncate", using("document_logs", """
    SELECT id, service_name, least(length(message), 65536) AS kept,
      length(concat('Log entry [INFO] ', service_name, ': ',
        CASE WHEN length(message) > 200 THEN concat(left(message, 200), '...') ELSE message END)) AS alert_length FROM document_logs"""))
def truncate(spark, folder):
    rows = t.document_logs(spark, folder).withColumn("level", F.lit("INFO"))
    return rows.select("id", "service_name", F.length(F.left("message", F.lit(ingest.MAX_MESSAGE))).alias("kept"),
                       F.length(trigger_message(F.col("service_name"), ALERT_TEXT)).alias("alert_length"))


@query("h02_custom_fields", using("", "SELECT id, custom_fields FROM parsed WHERE log_format = 'json'", parsed=PARSED_SQL))
def custom_fields(spark, folder):
    return _parsed(spark, folder).where("log_format = 'json'").select("id", "custom_fields")


# The lines of ``raw_logs`` once more, and the records of the topic.
RAW_SQL = """
    SELECT event_id AS id, user_id % 3 AS team_id, CASE event_id % 5
      WHEN 0 THEN concat('{"severity":"', CASE event_type WHEN 'error' THEN 'error' ELSE 'INFO' END, '","msg":"', event_type, ' by user ', user_id,
        '","@timestamp":"', strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","Service.Name":"svc-', user_id % 5, '","traceId":"t-', event_id // 8,
        '","user":', user_id, CASE event_type WHEN 'error' THEN concat(',"exception":"app.AppError: code ', user_id, '"') ELSE '' END, ',"tag":null}')
      WHEN 1 THEN concat('level=WARN msg="', event_type, ' by user ', user_id, '" time=', epoch_us(ts) // 1000, ' span_id=s-', event_id, ' host=host-', user_id % 4)
      WHEN 2 THEN concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%g'), '  INFO [svc-', user_id % 5, ',t-', event_id // 8, ',s-', event_id, '] ', user_id,
        ' --- [  main] app.', event_type, ' : done in ', event_id, ' steps')
      WHEN 3 THEN concat('<', user_id, '>Jan 15 10:30:45 host-', user_id % 4, ' app-', event_type, '[', event_id, ']: request ', event_id, ' served')
      ELSE concat('  ', event_type, ' happened to user ', user_id, ' ') END AS raw FROM events"""


@query("a01_topic_records", using("", """
    SELECT concat('00000000-0000-0000-0000-00000000000', team_id) AS team_id,
      CASE WHEN id % 7 = 0 THEN concat('{"level":"warn","message":"seen ', id, '","timestamp":"2024-01-02T03:04:05","hostName":"h"}') ELSE raw END AS raw,
      CASE WHEN id % 2 = 0 THEN 'keyed' ELSE 'unknown' END AS default_service
    FROM raw_logs WHERE id % 13 <> 0""", raw_logs=RAW_SQL))
def topic_records(spark, folder):
    return ingest.topic_records(_topic(spark, folder))


TOPIC_SQL = f"""
    SELECT p.id, CASE WHEN s THEN 'structured' ELSE log_format END AS log_format, CASE WHEN s THEN 'warn' ELSE level END AS level,
      CASE WHEN s THEN concat('seen ', p.id) ELSE message END AS message,
      CASE WHEN s THEN TIMESTAMP '2024-01-02 03:04:05' ELSE timestamp END AS timestamp,
      CASE WHEN s OR log_format IN ('key_value', 'plain') THEN CASE WHEN p.id % 2 = 0 THEN 'keyed' ELSE 'unknown' END
        ELSE service_name END AS service_name,
      CASE WHEN s THEN 'h' ELSE host_name END AS host_name, team_id
    FROM (SELECT *, id % 7 = 0 AS s FROM parsed) p WHERE p.id % 13 <> 0"""


@query("a02_structured_records", using("", """
    SELECT log_format, level, message, timestamp, service_name, host_name,
      concat('00000000-0000-0000-0000-00000000000', team_id) AS team_id FROM lines""", parsed=PARSED_SQL, lines=TOPIC_SQL))
def structured_records(spark, folder):
    rows = ingest.parse_topic_lines(ingest.topic_records(_topic(spark, folder)))
    return rows.select("log_format", "level", "message", "timestamp", "service_name", "host_name", "team_id")


@query("i01_ingested_records", using("", """
    SELECT upper(CASE WHEN level = 'warn' THEN 'WARN' ELSE level END) AS level, message, coalesce(timestamp, TIMESTAMP '2024-02-01') AS timestamp, service_name,
      concat('00000000-0000-0000-0000-00000000000', team_id) AS team_id FROM lines""", parsed=PARSED_SQL, lines=TOPIC_SQL))
def ingested_records(spark, folder):
    """What the ingest stream stores, on the same records as a batch."""
    rows = ingest.ingest_logs(ingest.parse_topic_lines(ingest.topic_records(_topic(spark, folder))), NOW)[0]
    return rows.select("level", "message", "timestamp", "service_name", "team_id")


def _requests(spark, folder):
    return t.events(spark, folder).selectExpr(
        "event_id AS id", "user_id % 3 AS team_id", "concat('svc-', user_id % 5) AS service_name",
        "CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'Debug' WHEN 'signup' THEN 'warning' ELSE event_type END AS level",
        "props AS message", "CASE WHEN event_id % 4 <> 0 THEN ts END AS timestamp",
    )


REQUESTS_SQL = """
    SELECT event_id AS id, user_id % 3 AS team_id, concat('svc-', user_id % 5) AS service_name, props AS message,
      CASE event_type WHEN 'click' THEN 'INFO' WHEN 'view' THEN 'DEBUG' WHEN 'error' THEN 'ERROR' END AS level,
      CASE WHEN event_id % 4 <> 0 THEN ts ELSE TIMESTAMP '2024-02-01' END AS timestamp
    FROM events"""


@query("a03_batch_ingest", using("", """
    SELECT team_id, count(level) AS ingested, count(*) AS total FROM requests GROUP BY team_id""", requests=REQUESTS_SQL))
def batch_ingest(spark, folder):
    return ingest.ingest_counts(_requests(spark, folder), NOW, ("team_id",))


@query("a03_rejects", using("", """
    SELECT id, concat_ws(', ', CASE WHEN level_ IS NULL OR trim(level_) = '' THEN 'level is blank' END,
      CASE WHEN id % 3 = 0 THEN 'message is blank' END, CASE WHEN id % 4 = 0 THEN 'service_name is blank' END,
      CASE WHEN level_ = 'purchase' THEN 'level is unknown' END) AS reasons
    FROM (SELECT event_id AS id, CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN ' ' WHEN 'signup' THEN 'info' ELSE event_type END AS level_ FROM events)
    WHERE level_ IS NULL OR level_ IN (' ', 'purchase') OR id % 3 = 0 OR id % 4 = 0"""))
def rejects(spark, folder):
    rows = t.events(spark, folder).selectExpr(
        "event_id AS id", "CASE event_type WHEN 'click' THEN NULL WHEN 'view' THEN ' ' WHEN 'signup' THEN 'info' ELSE event_type END AS level",
        "CASE WHEN event_id % 3 > 0 THEN props ELSE '  ' END AS message", "CASE WHEN event_id % 4 > 0 THEN 'svc' END AS service_name", "ts AS timestamp",
    )
    _, rejected = ingest.ingest_logs(rows, NOW)
    return rejected.select("id", F.concat_ws(", ", "reasons").alias("reasons"))


@query("a04_normalised", using("", """
    SELECT id, team_id, service_name, level, timestamp, message FROM requests WHERE level IS NOT NULL""", requests=REQUESTS_SQL))
def normalised(spark, folder):
    stored, _ = ingest.ingest_logs(_requests(spark, folder), NOW)
    return stored.select("id", "team_id", "service_name", "level", "timestamp", "message")


@query("a05_raw_ingest", using("", """
    SELECT id, upper(level) AS level, coalesce(timestamp, TIMESTAMP '2024-02-01') AS timestamp, message, service_name
    FROM parsed WHERE service_name IS NOT NULL""", parsed=PARSED_SQL))
def raw_ingest(spark, folder):
    rows = ingest.ingest_raw(t.raw_logs(spark, folder), NOW, "raw", F.col("default_service"))
    return rows.select("id", "level", "timestamp", "message", "service_name")


@query("a09_span_ingest", using("trace_spans", """
    SELECT span_id, CASE WHEN status = 'ERROR' THEN 'ERROR' ELSE 'OK' END AS status,
      coalesce(duration_ms, (epoch_us(end_time) - epoch_us(start_time)) // 1000) AS duration_ms FROM trace_spans"""))
def span_ingest(spark, folder):
    given = t.trace_spans(spark, folder).withColumn("status", F.expr("""
        CASE WHEN status = 'ERROR' THEN 'error' WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'weird' ELSE 'ok' END"""))
    return ingest.ingest_spans(given).select("span_id", "status", "duration_ms")


@query("a09_span_reject_reasons", using("trace_spans", """
    SELECT 'parent_span_id is too long' AS reason, count(*) AS n FROM trace_spans WHERE parent_span_id IS NOT NULL AND id % 2 = 0
    UNION ALL SELECT 'operation_name is blank', count(*) FROM trace_spans WHERE operation_name = 'view'
    UNION ALL SELECT 'start_time is missing', count(*) FROM trace_spans WHERE end_time IS NULL"""))
def span_reject_reasons(spark, folder):
    given = t.trace_spans(spark, folder).withColumns({
        "parent_span_id": F.when(F.col("id") % 2 == 0, F.rpad("parent_span_id", 101, "x")).otherwise(F.col("parent_span_id")),
        "operation_name": F.when(F.col("operation_name") != "view", F.col("operation_name")),
        "start_time": F.when(F.col("end_time").isNotNull(), F.col("start_time")),
    })
    found = ingest.span_reject_reasons(given).select(F.explode("reasons").alias("reason"))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@query("a10_new_sources", using("log_entries", """
    SELECT team_id, service_name AS name FROM log_entries EXCEPT SELECT team_id, name FROM sources""", sources=SOURCES_SQL.replace("level = 'FATAL'", "level = 'FATAL' AND team_id = 1")))
def new_sources(spark, folder):
    known = sources(spark, folder).where("team_id = 1")
    return ingest.missing_sources(t.log_entries(spark, folder), known)


@query("a11_source_statistics", using("log_entries", """
    SELECT team_id, service_name AS name, count(*) AS log_count, max(timestamp) AS last_log_received_at
    FROM log_entries GROUP BY ALL"""))
def source_statistics(spark, folder):
    return ingest.source_statistics(t.log_entries(spark, folder))


@query("e24_ingest_statistics", using("log_entries", """
    SELECT part, name, count(*) AS logs, round(count(*) / 864000.0::DOUBLE, 9) AS logs_per_second,
      count(DISTINCT (team_id, service_name)) AS active_sources
    FROM (SELECT 'total' AS part, 'all' AS name, team_id, service_name, timestamp FROM log_entries
      UNION ALL SELECT 'level', level, team_id, service_name, timestamp FROM log_entries
      UNION ALL SELECT 'service', service_name, team_id, service_name, timestamp FROM log_entries)
    WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp <= TIMESTAMP '2024-01-20' GROUP BY part, name"""))
def ingest_statistics(spark, folder):
    return ingest.ingest_statistics(t.log_entries(spark, folder), "2024-01-10", "2024-01-20")
