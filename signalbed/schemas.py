"""Row types of the facts and of the rule tables."""

from pyspark.sql import types as T


def _struct(**fields: str | T.DataType) -> T.StructType:
    named = {
        "s": T.StringType(), "t": T.TimestampType(), "l": T.LongType(),
        "i": T.IntegerType(), "d": T.DoubleType(), "b": T.BooleanType(),
    }
    return T.StructType(
        [T.StructField(name, named[kind] if isinstance(kind, str) else kind) for name, kind in fields.items()]
    )


LOG_ENTRIES = _struct(
    id="s", team_id="s", level="s", message="s", timestamp="t", service_name="s",
    correlation_id="s", trace_id="s", span_id="s", logger_name="s", thread_name="s",
    exception_class="s", exception_message="s", stack_trace="s", custom_fields="s",
    host_name="s", ip_address="s",
)

METRICS = _struct(
    metric_id="s", team_id="s", name="s", metric_type="s", description="s", unit="s",
    service_name="s", tags="s",
)

METRIC_SERIES = _struct(metric_id="s", timestamp="t", value="d", tags="s", resolution="i")

TRACE_SPANS = _struct(
    id="s", team_id="s", correlation_id="s", trace_id="s", span_id="s", parent_span_id="s",
    service_name="s", operation_name="s", start_time="t", end_time="t", duration_ms="l",
    status="s", status_message="s", tags="s",
)

TRAPS = _struct(trap_id="s", team_id="l", name="s", trap_type="s", is_active="b")

ALERT_RULES = _struct(
    rule_id="s", team_id="l", name="s", trap_id="s", channel_id="s", severity="s",
    is_active="b", throttle_minutes="i",
)

ALERT_CHANNELS = _struct(
    channel_id="s", team_id="l", name="s", channel_type="s", configuration="s", is_active="b",
)

RETENTION_POLICIES = _struct(
    policy_id="s", team_id="l", source_name="s", log_level="s", retention_days="i",
    action="s", archive_destination="s", is_active="b",
)

BASELINES = _struct(
    team_id="l", service_name="s", metric_name="s", baseline_value="d",
    standard_deviation="d", sample_count="l", window_start_time="t", window_end_time="t",
    deviation_threshold="d", is_active="b",
)

# The JSON body of a structured record on the log topic (camelCase, all optional).
STRUCTURED_RECORD = _struct(
    level="s", message="s", timestamp="s", serviceName="s", correlationId="s", traceId="s",
    spanId="s", loggerName="s", threadName="s", exceptionClass="s", exceptionMessage="s",
    stackTrace="s", customFields="s", hostName="s", ipAddress="s",
)
