"""From topic records and requests to stored log entries, spans and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed import schemas
from signalbed.functions.levels import normal_level
from signalbed.functions.times import ISO_INSTANT, instant, millis_between
from signalbed.operators.parse import parse_raw_logs, reject_reasons

# Field limits of incoming records, for the reports.
MAX_MESSAGE = 65_536
REQUIRED_LOG_FIELDS = ("level", "message", "service_name")
LOG_LIMITS = {
    "message": MAX_MESSAGE, "service_name": 200, "correlation_id": 100, "trace_id": 100, "span_id": 100,
    "logger_name": 500, "thread_name": 200, "exception_class": 500, "host_name": 200, "ip_address": 45,
}
REQUIRED_SPAN_FIELDS = ("correlation_id", "trace_id", "span_id", "service_name", "operation_name")
SPAN_LIMITS = {
    "correlation_id": 100, "trace_id": 100, "span_id": 100, "parent_span_id": 100, "service_name": 200,
    "operation_name": 500,
}
TEAM_HEADER = "X-Team-Id"
TEAM_PATTERN = r"^[0-9a-fA-F]+(-[0-9a-fA-F]+){4}$"
LOCAL_TIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"


def _blank(name: str) -> Column:
    return F.col(name).isNull() | (F.trim(F.col(name)) == "")


def _limits(columns: list[str], required: tuple[str, ...], limits: dict[str, int]) -> list[tuple[Column, str]]:
    rules = [(_blank(name), f"{name} is blank") for name in required if name in columns]
    rules += [(F.length(name) > size, f"{name} is too long") for name, size in limits.items() if name in columns]
    return rules


def log_reject_reasons(entries: DataFrame) -> DataFrame:
    """Every entry with the array of limits it breaks (empty when it is fine)."""
    return entries.withColumn("reasons", reject_reasons(_limits(entries.columns, REQUIRED_LOG_FIELDS, LOG_LIMITS)))


def span_reject_reasons(spans: DataFrame) -> DataFrame:
    rules = _limits(spans.columns, REQUIRED_SPAN_FIELDS, SPAN_LIMITS)
    rules.append((F.col("start_time").isNull(), "start_time is missing"))
    return spans.withColumn("reasons", reject_reasons(rules))


def normalise_logs(entries: DataFrame, ingest_time) -> DataFrame:
    """Upper-cased level and the ingest time where none is given; adds ``reasons``, empty for a valid entry.

    A blank required field or an unknown level makes an entry invalid. Texts
    are kept whole: a length is something to report, no reason to drop a row.
    """
    required = [name for name in REQUIRED_LOG_FIELDS if name in entries.columns]
    rules = [(_blank(name), f"{name} is blank") for name in required]
    rules.append((~_blank("level") & normal_level(F.col("level")).isNull(), "level is unknown"))
    return entries.withColumn("reasons", reject_reasons(rules)).withColumns({
        "level": F.coalesce(normal_level(F.col("level")), F.col("level")),
        "timestamp": F.coalesce(F.col("timestamp"), instant(ingest_time)),
    })


def ingest_logs(entries: DataFrame, ingest_time) -> tuple[DataFrame, DataFrame]:
    """(stored, rejected): good rows are kept, bad ones come with their ``reasons``."""
    rows = normalise_logs(entries, ingest_time)
    return rows.where(F.size("reasons") == 0).drop("reasons"), rows.where(F.size("reasons") > 0)


def ingest_counts(entries: DataFrame, ingest_time, by: tuple[str, ...] = ()) -> DataFrame:
    rows = normalise_logs(entries, ingest_time)
    counts = [F.count_if(F.size("reasons") == 0).alias("ingested"), F.count(F.lit(1)).alias("total")]
    return rows.groupBy(*by).agg(*counts)


def ingest_raw(lines: DataFrame, ingest_time, raw: str = "raw", default_service: Column | None = None) -> DataFrame:
    """Parse, normalise, leave out what is not valid: a line without any service is not stored."""
    return ingest_logs(parse_raw_logs(lines, raw, default_service), ingest_time)[0]


def topic_records(records: DataFrame) -> DataFrame:
    """(value, key, headers) records to (team_id, raw, default_service).

    Blank values and records without a well-formed team header are dropped.
    ``headers`` is an array of (key, value) as the topic source gives it.
    """
    header = F.filter("headers", lambda h: h["key"] == TEAM_HEADER)
    rows = records.select(
        F.col("value").cast("string").alias("raw"),
        F.col("key").cast("string").alias("_key"),
        F.get(header, F.lit(0))["value"].cast("string").alias("team_id"),
    )
    well_formed = F.col("team_id").rlike(TEAM_PATTERN) & (F.length("team_id") <= 36)
    service = F.when(F.trim("_key") != "", F.col("_key")).otherwise("unknown")
    return rows.where(~_blank("raw") & well_formed).select("team_id", "raw", service.alias("default_service"))


# JSON names of the record fields.
RECORD_NAMES = {
    "service_name": "serviceName", "correlation_id": "correlationId", "trace_id": "traceId",
    "span_id": "spanId", "logger_name": "loggerName", "thread_name": "threadName",
    "exception_class": "exceptionClass", "exception_message": "exceptionMessage",
    "stack_trace": "stackTrace", "custom_fields": "customFields", "host_name": "hostName",
}


def parse_topic_lines(lines: DataFrame) -> DataFrame:
    """Structured JSON records where level and message are set, raw parsing for the rest.

    A record whose timestamp cannot be read goes to raw parsing too.
    """
    body = F.when(F.trim("raw").startswith("{"), F.from_json("raw", schemas.STRUCTURED_RECORD))
    rows = parse_raw_logs(lines.withColumn("_body", body), "raw", F.col("default_service"))
    text = F.col("_body.timestamp")
    stamp = F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp")).when(
        text.rlike(LOCAL_TIME), F.concat(text, F.lit("Z")).try_cast("timestamp")
    )
    structured = F.coalesce(
        F.col("_body.level").isNotNull() & F.col("_body.message").isNotNull() & (text.isNull() | stamp.isNotNull()),
        F.lit(False),
    )
    chosen = {
        "level": F.col("_body.level"),
        "message": F.col("_body.message"),
        "timestamp": stamp,
        **{name: F.col(f"_body.{json_name}") for name, json_name in RECORD_NAMES.items()},
    }
    chosen["service_name"] = F.coalesce(chosen["service_name"], F.col("default_service"))
    rows = rows.withColumn("_structured", structured)
    picked = {name: F.when(F.col("_structured"), value).otherwise(F.col(name)) for name, value in chosen.items()}
    return rows.withColumns(
        {**picked, "ip_address": F.when(F.col("_structured"), F.col("_body.ipAddress")),
         "log_format": F.when(F.col("_structured"), "structured").otherwise(F.col("log_format"))}
    ).drop("_structured", "_body")


def missing_sources(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """One new source per (team, service) that is not known yet; entries without a service have none."""
    seen = entries.where("service_name IS NOT NULL").select("team_id", F.col("service_name").alias("name")).distinct()
    return seen.join(sources.select("team_id", "name"), ["team_id", "name"], "left_anti")


def source_statistics(entries: DataFrame, received: str = "timestamp") -> DataFrame:
    return entries.groupBy("team_id", F.col("service_name").alias("name")).agg(
        F.count(F.lit(1)).alias("log_count"), F.max(received).alias("last_log_received_at")
    )


def with_source(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """Entries with the id of their source, null where there is none.

    No hint: Spark broadcasts the sources only below its own size limit, and
    splits hot services otherwise.
    """
    named = sources.select("team_id", F.col("name").alias("service_name"), "source_id", F.col("name").alias("source_name"))
    return entries.join(named, ["team_id", "service_name"], "left")


def ingest_spans(spans: DataFrame) -> DataFrame:
    """Unknown or missing status becomes OK; a missing duration is taken from the end.

    Spans without a start or with a blank required field are not stored
    (:func:`span_reject_reasons` says why).
    """
    status = F.upper("status")
    whole = F.col("start_time").isNotNull()
    for name in REQUIRED_SPAN_FIELDS:
        whole &= ~_blank(name)
    return spans.where(whole).withColumns({
        "status": F.when(status.isin("OK", "ERROR"), status).otherwise("OK"),
        "duration_ms": F.coalesce("duration_ms", millis_between(F.col("start_time"), F.col("end_time"))),
    })


def ingest_statistics(entries: DataFrame, since, until) -> DataFrame:
    """Totals, rate and active sources, then the counts by level and by service, in one scan."""
    rows = entries.where((F.col("timestamp") >= instant(since)) & (F.col("timestamp") <= instant(until)))
    pairs = rows.groupBy("level", "service_name", "team_id").agg(F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_micros(instant(until)) - F.unix_micros(instant(since))) / 1e6
    grouped = pairs.groupingSets([[], ["level"], ["service_name"]], "level", "service_name").agg(
        F.grouping_id().alias("g"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.count_distinct("team_id", "service_name").alias("sources"),
    )
    return grouped.select(
        F.when(F.col("g") == 3, "total").when(F.col("g") == 1, "level").otherwise("service").alias("part"),
        F.coalesce("level", "service_name", F.lit("all")).alias("name"),
        F.col("n").alias("logs"),
        F.round(F.col("n") / seconds, 9).alias("logs_per_second"),
        F.col("sources").alias("active_sources"),
    )
