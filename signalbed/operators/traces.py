"""Traces: summaries, depth, waterfall, log correlation, root cause.

Every operator works on all traces at once and returns flat rows. A trace may
hold any number of spans and logs: nothing gathers a whole trace in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed.functions.forest import climb
from signalbed.functions.ordered import neighbours
from signalbed.functions.times import micros, millis_between

TRACE = "correlation_id"


def _end() -> Column:
    return F.coalesce("end_time", "start_time")


def _root(*fields: str) -> Column:
    """Fields of the root: the first span without parent, else the first span."""
    rank = F.struct(F.col("parent_span_id").isNotNull(), F.col("start_time"), F.col("span_id"))
    return F.min_by(F.struct(*fields), rank)


def trace_summaries(spans: DataFrame, recent: Column | None = None) -> DataFrame:
    """One row per trace. ``recent`` picks the spans whose newest start orders the traces."""
    start = F.col("start_time") if recent is None else F.when(recent, F.col("start_time"))
    found = spans.groupBy(TRACE).agg(
        _root("trace_id", "service_name", "operation_name").alias("root"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_distinct("service_name").alias("service_count"),
        F.min("start_time").alias("start_time"),
        F.max(_end()).alias("end_time"),
        F.bool_or(F.col("status") == "ERROR").alias("has_errors"),
        F.max(start).alias("recent_start"),
    )
    return found.select(
        TRACE, F.col("root.trace_id").alias("trace_id"), F.col("root.service_name").alias("root_service"),
        F.col("root.operation_name").alias("root_operation"), "span_count", "service_count",
        millis_between(F.col("start_time"), F.col("end_time")).alias("duration_ms"),
        "has_errors", "start_time", "end_time", "recent_start",
    )


def _touching(spans: DataFrame, mine: Column) -> DataFrame:
    """All spans of the traces that have a span of ``mine``: the others are gone before anything is summed up."""
    return spans.join(spans.where(mine).select(TRACE).distinct(), TRACE, "left_semi")


def _newest(spans: DataFrame, mine: Column, page: int, size: int) -> DataFrame:
    """Summaries of one page of traces, by the newest start of their spans of ``mine``.

    The page is chosen by times alone; only its traces are summed up.
    """
    order = [F.col("recent_start").desc(), F.col(TRACE)]
    rows = spans.where(mine).groupBy(TRACE).agg(F.max("start_time").alias("recent_start")).orderBy(*order)
    chosen = (rows.offset(page * size) if page else rows).limit(size).select(TRACE)
    return trace_summaries(spans.join(chosen, TRACE, "left_semi"), mine).orderBy(*order)


def traces_after(spans: DataFrame, team_id, last=None, size: int = 20, service_name: str | None = None) -> DataFrame:
    """The page of a team's traces that follows the trace ``last`` (with ``recent_start`` and ``correlation_id``).

    Newest first, of one service if named. Traces that started later are cut
    off by their newest start before anything is sorted; only the traces of the
    page are summed up.
    """
    own = F.col("team_id") == F.lit(team_id)
    if service_name is not None:
        own = own & (F.col("service_name") == service_name)
    order = [F.col("recent_start").desc(), F.col(TRACE)]
    rows = spans.where(own).groupBy(TRACE).agg(F.max("start_time").alias("recent_start"))
    if last is not None:
        newest = F.lit(last["recent_start"])
        rows = rows.where((F.col("recent_start") < newest) | ((F.col("recent_start") == newest) & (F.col(TRACE) > last[TRACE])))
    chosen = rows.orderBy(*order).limit(size).select(TRACE)
    mine = spans if service_name is not None else spans.where(own)
    return trace_summaries(mine.join(chosen, TRACE, "left_semi"), own).orderBy(*order)


def recent_traces(spans: DataFrame, team_id, page: int = 0, size: int = 20) -> DataFrame:
    return _newest(spans.where(F.col("team_id") == F.lit(team_id)), F.lit(True), page, size)


def traces_of_service(spans: DataFrame, team_id, service_name: str) -> DataFrame:
    """Whole traces with at least one span of the service."""
    own = (F.col("team_id") == F.lit(team_id)) & (F.col("service_name") == service_name)
    return trace_summaries(_touching(spans, own), own)


def traces_by_service(spans: DataFrame, team_id, service_name: str, page: int = 0, size: int = 20) -> DataFrame:
    own = (F.col("team_id") == F.lit(team_id)) & (F.col("service_name") == service_name)
    return _newest(spans, own, page, size)


def traces_with_errors(spans: DataFrame, team_id) -> DataFrame:
    failed = (F.col("team_id") == F.lit(team_id)) & (F.col("status") == "ERROR")
    return trace_summaries(_touching(spans, failed), failed)


def error_traces(spans: DataFrame, team_id, limit: int = 20) -> DataFrame:
    failed = (F.col("team_id") == F.lit(team_id)) & (F.col("status") == "ERROR")
    return _newest(spans, failed, 0, limit)


def trace_flows(spans: DataFrame) -> DataFrame:
    """Header of the flow view: the duration ends with the span that started last."""
    last = F.max_by(_end(), F.struct("start_time", "span_id"))
    return spans.groupBy(TRACE).agg(
        F.min_by("trace_id", F.struct("start_time", "span_id")).alias("trace_id"),
        F.count(F.lit(1)).alias("span_count"),
        F.min("start_time").alias("_start"), last.alias("_end"),
        F.bool_or(F.col("status") == "ERROR").alias("has_errors"),
    ).select(
        TRACE, "trace_id", "span_count", millis_between(F.col("_start"), F.col("_end")).alias("duration_ms"), "has_errors"
    )


def trace_spans_in_order(spans: DataFrame, by: str, value: str) -> DataFrame:
    """All spans of one trace, by correlation or trace id, first start first."""
    return spans.where(F.col(by) == value).orderBy("start_time", "span_id")


def resolved_duration() -> Column:
    return F.coalesce("duration_ms", millis_between(F.col("start_time"), F.col("end_time")), F.lit(0))


def _nodes(spans: DataFrame) -> DataFrame:
    """One node per span id of a trace; the earliest span stands for repeats."""
    return spans.groupBy(TRACE, "span_id").agg(
        F.min_by(F.struct("parent_span_id"), F.struct("start_time", "parent_span_id")).alias("n")
    ).select(TRACE, "span_id", F.col("n.parent_span_id").alias("parent_span_id"))


def span_depths(spans: DataFrame) -> DataFrame:
    """Spans with their ``depth``. Orphans, cycles and all below them have depth 0.

    Only spans that are someone's parent take part in the climb; leaves, most of
    a wide trace, are joined to their parent once at the end.
    """
    parents = spans.where("parent_span_id IS NOT NULL").select(TRACE, F.col("parent_span_id").alias("span_id")).distinct()
    inner = _nodes(spans.join(parents, [TRACE, "span_id"], "left_semi"))
    placed = climb(inner, [TRACE], "span_id", "parent_span_id").select(
        TRACE, F.col("node").alias("parent_span_id"), (F.col("hops") + 1).alias("depth")
    )
    return spans.join(placed, [TRACE, "parent_span_id"], "left").withColumn("depth", F.coalesce("depth", F.lit(0)))


def span_logs(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """(correlation_id, span_id, log_id) of every log whose trace has spans.

    A log that names its span goes there, even when no such span exists. Other
    logs go to the span whose start is nearest in whole milliseconds, on a tie
    to the earliest start.
    """
    logs = entries.select(TRACE, "span_id", F.col("id").alias("log_id"), micros(F.col("timestamp")).alias("at"))
    named = F.coalesce(F.trim("span_id") != "", F.lit(False))
    direct = logs.where(named).join(spans.select(TRACE).distinct(), TRACE, "left_semi").select(TRACE, "span_id", "log_id")
    loose = logs.where(~named).drop("span_id")
    near = nearest_spans(loose.select(TRACE, "at").distinct(), spans).where("span_id IS NOT NULL")
    return direct.unionByName(loose.join(near, [TRACE, "at"]).select(TRACE, "span_id", "log_id"))


def nearest_spans(moments: DataFrame, spans: DataFrame) -> DataFrame:
    """(correlation_id, at, span_id) for distinct moments, without pairing moments and spans."""
    starts = spans.groupBy(TRACE, micros(F.col("start_time")).alias("at")).agg(F.min("span_id").alias("span_id"))
    around = neighbours(starts, moments, [TRACE], "at", ["span_id"])
    back = F.expr("(at - before.at) div 1000")
    ahead = F.expr("(after.at - at) div 1000")
    earlier = F.col("before").isNotNull() & (F.col("after").isNull() | (back <= ahead))
    chosen = around.select(
        TRACE, "at",
        F.when(earlier, F.col("before")).otherwise(F.col("after")).alias("span"),
        # Starts above this moment are as near, in whole milliseconds, as the one found.
        F.when(earlier, F.col("at") - (back + 1) * 1000).alias("_above"),
    ).withColumn("_cell", F.expr("span.at div 1000"))
    # Starts of a millisecond and of the one before it: two thousand at most.
    cells = starts.select(TRACE, F.struct("at", "span_id").alias("s"), F.explode(F.expr("array(at div 1000, at div 1000 + 1)")).alias("_cell"))
    cells = cells.groupBy(TRACE, "_cell").agg(F.array_sort(F.collect_list("s")).alias("_starts"))
    tied = F.filter("_starts", lambda s: (s["at"] > F.col("_above")) & (s["at"] <= F.col("span.at")))
    return chosen.join(cells, [TRACE, "_cell"], "left").select(
        TRACE, "at", F.coalesce(F.get(tied, F.lit(0))["span_id"], F.col("span.span_id")).alias("span_id")
    )


def trace_logs(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """Log entries that belong to a trace."""
    return entries.join(spans.select(TRACE).distinct(), TRACE, "left_semi").select(TRACE, F.col("id").alias("log_id"), "timestamp")


def waterfall_headers(spans: DataFrame) -> DataFrame:
    """Per trace: total time from the start of the root to the last end, counts, errors."""
    return spans.groupBy(TRACE).agg(
        _root("trace_id", "start_time").alias("root"),
        F.max(_end()).alias("_end"),
        F.count(F.lit(1)).alias("span_count"),
        F.count_distinct("service_name").alias("service_count"),
        F.bool_or(F.col("status") == "ERROR").alias("has_errors"),
    ).select(
        TRACE, F.col("root.trace_id").alias("trace_id"), F.col("root.start_time").alias("root_start"),
        millis_between(F.col("root.start_time"), F.col("_end")).alias("total_duration_ms"),
        "span_count", "service_count", "has_errors",
    )


def waterfall(spans: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """One row per span: offset from the root, duration, depth, number of logs.

    The log ids themselves are the rows of :func:`span_logs`.
    """
    headers = waterfall_headers(spans).select(TRACE, "root_start")
    rows = span_depths(spans).join(headers, TRACE).select(
        TRACE, "id", "span_id", "parent_span_id", "service_name", "operation_name", "start_time",
        millis_between(F.col("root_start"), F.col("start_time")).alias("offset_ms"),
        resolved_duration().alias("duration_ms"), "status", "status_message", "depth",
    )
    if entries is None:
        return rows
    counts = span_logs(entries, spans).groupBy(TRACE, "span_id").agg(F.count(F.lit(1)).alias("log_count"))
    return rows.join(counts, [TRACE, "span_id"], "left").withColumn("log_count", F.coalesce("log_count", F.lit(0)))


def root_causes(spans: DataFrame) -> DataFrame:
    """The first failed span of every trace that has one, and how far the failure went."""
    failed = F.col("status") == "ERROR"
    rank = F.when(failed, F.struct("start_time", "span_id"))
    found = spans.groupBy(TRACE).agg(
        F.min_by(F.struct("trace_id", "span_id", "service_name", "status_message"), rank).alias("cause"),
        F.count_distinct(F.when(failed, F.col("service_name"))).alias("impacted_services"),
        F.min("start_time").alias("_start"), F.max(_end()).alias("_end"),
        F.count_if(failed).alias("error_count"),
    ).where("error_count > 0")
    return found.select(
        TRACE, F.col("cause.trace_id").alias("trace_id"), F.col("cause.span_id").alias("root_cause_span"),
        F.col("cause.service_name").alias("root_cause_service"), F.col("cause.status_message").alias("error_message"),
        "impacted_services", millis_between(F.col("_start"), F.col("_end")).alias("duration_ms"),
    )


def root_cause_logs(entries: DataFrame, spans: DataFrame) -> DataFrame:
    """Log entries of the traces that failed."""
    return trace_logs(entries, spans.where(F.col("status") == "ERROR"))


def error_chains(spans: DataFrame) -> DataFrame:
    """Failed spans reached from the root cause through failed children only, with their distance."""
    errors = spans.where(F.col("status") == "ERROR")
    causes = errors.groupBy(TRACE).agg(F.min_by("span_id", F.struct("start_time", "span_id")).alias("cause"))
    nodes = _nodes(errors).join(causes, TRACE).select(
        TRACE, "span_id", F.when(F.col("span_id") != F.col("cause"), F.col("parent_span_id")).alias("up")
    )
    reached = climb(nodes, [TRACE], "span_id", "up")
    reached = reached.join(causes, (reached[TRACE] == causes[TRACE]) & (reached["top"] == causes["cause"]), "left_semi")
    chain = reached.select(TRACE, F.col("node").alias("span_id"), F.col("hops").alias("chain_depth"))
    return errors.join(chain, [TRACE, "span_id"])
