"""Filters over log entries, paging, saved queries."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed.functions.levels import LEVELS, level_compare, parse_level
from signalbed.functions.times import instant

# The columns a search term is looked up in.
SEARCH_COLUMNS = ("message", "logger_name", "exception_class", "exception_message", "custom_fields")

# The field names of a condition and the columns they stand for.
CONDITION_FIELDS = {
    "service": "service_name",
    "level": "level",
    "message": "message",
    "correlationId": "correlation_id",
    "traceId": "trace_id",
    "spanId": "span_id",
    "logger": "logger_name",
    "thread": "thread_name",
    "exception": "exception_class",
    "exceptionMessage": "exception_message",
    "host": "host_name",
    "hostName": "host_name",
    "ip": "ip_address",
    "timestamp": "timestamp",
}

DEFAULT_PAGE_SIZE = 20


def _given(value) -> bool:
    return value is not None and (not isinstance(value, str) or value.strip() != "")


def _like(column: str, term: str) -> Column:
    """Case-insensitive substring; ``%`` and ``_`` in the term act as wildcards."""
    return F.lower(F.col(column)).like(f"%{term.lower()}%")


def text_match(term: str) -> Column:
    if not _given(term):
        raise ValueError("search term must not be blank")
    return reduce(Column.__or__, [_like(name, term) for name in SEARCH_COLUMNS])


def filter_logs(
    entries: DataFrame,
    *,
    team_id=None,
    service_name: str | None = None,
    level: str | None = None,
    start_time=None,
    end_time=None,
    correlation_id: str | None = None,
    host_name: str | None = None,
    logger_name: str | None = None,
    exception_class: str | None = None,
    query: str | None = None,
) -> DataFrame:
    """AND of the given parts; the time range includes both ends."""
    parts: list[Column] = []
    equal = {
        "team_id": team_id, "service_name": service_name, "correlation_id": correlation_id, "host_name": host_name,
    }
    parts += [F.col(name) == F.lit(value) for name, value in equal.items() if _given(value)]
    if _given(level):
        parts.append(F.col("level") == parse_level(level))
    if start_time is not None:
        parts.append(F.col("timestamp") >= instant(start_time))
    if end_time is not None:
        parts.append(F.col("timestamp") <= instant(end_time))
    part_of = {"logger_name": logger_name, "exception_class": exception_class}
    parts += [_like(name, value) for name, value in part_of.items() if _given(value)]
    if _given(query):
        parts.append(text_match(query))
    return entries.where(reduce(Column.__and__, parts)) if parts else entries


def search_logs(entries: DataFrame, term: str, *, team_id=None, start_time=None, end_time=None) -> DataFrame:
    found = entries.where(text_match(term))
    return filter_logs(found, team_id=team_id, start_time=start_time, end_time=end_time)


def _one_condition(field: str, operator: str, value: str) -> Column:
    if field not in CONDITION_FIELDS:
        raise ValueError(f"unknown field: {field}")
    column = F.col(CONDITION_FIELDS[field])
    op = operator.upper()
    items = re.split(r"\s*,\s*", value)
    if field == "level":
        if op in ("IN", "NOT IN"):
            listed = column.isin(*[parse_level(item) for item in items])
            return listed if op == "IN" else ~listed
        return level_compare(column, op, value)
    target: Column = F.lit(value)
    if field == "timestamp":
        if op not in ("=", "!=", ">", "<", ">=", "<="):
            raise ValueError(f"operator {operator!r} is not supported for timestamps")
        moment = dt.datetime.fromisoformat(value)
        if moment.tzinfo is None:
            raise ValueError(f"not a full instant: {value}")
        target = instant(moment)
    match op:
        case "=":
            return column == target
        case "!=":
            return column != target
        case ">":
            return column > target
        case "<":
            return column < target
        case ">=":
            return column >= target
        case "<=":
            return column <= target
        case "CONTAINS" | "LIKE":
            return _like(CONDITION_FIELDS[field], value)
        case "NOT CONTAINS" | "NOT LIKE":
            return ~_like(CONDITION_FIELDS[field], value)
        case "IN":
            return column.isin(*items)
        case "NOT IN":
            return ~column.isin(*items)
    raise ValueError(f"unsupported operator: {operator}")


def condition_predicate(conditions: Iterable[Mapping[str, str]]) -> Column:
    """Conditions joined strictly from left to right: ``a OR b AND c`` is ``(a OR b) AND c``."""
    combined: Column | None = None
    for condition in conditions:
        one = _one_condition(condition["field"], condition["operator"], condition["value"])
        if combined is None:
            combined = one
        elif condition.get("conjunction", "AND").upper() == "OR":
            combined = combined | one
        else:
            combined = combined & one
    return F.lit(True) if combined is None else combined


def filter_conditions(entries: DataFrame, conditions: Iterable[Mapping[str, str]], team_id=None) -> DataFrame:
    found = entries.where(condition_predicate(conditions))
    return found if team_id is None else found.where(F.col("team_id") == F.lit(team_id))


def lookup(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """The rows whose key is asked for, many at once."""
    return rows.join(wanted.select(key).distinct(), key, "left_semi")


def newest_page(rows: DataFrame, page: int = 0, size: int = DEFAULT_PAGE_SIZE, *, by: str = "timestamp", tie: str = "id") -> DataFrame:
    """One page, newest first; ``tie`` makes the order total."""
    if page < 0 or size < 1:
        raise ValueError("page must be at least 0 and size at least 1")
    ordered = rows.orderBy(F.col(by).desc(), F.col(tie).desc())
    if page:
        ordered = ordered.offset(page * size)
    return ordered.limit(size)


def page_after(rows: DataFrame, last=None, size: int = DEFAULT_PAGE_SIZE, *, by: str = "timestamp", tie: str = "id") -> DataFrame:
    """The page that follows the row ``last``, newest first; the first page without one.

    ``last`` is the last row of the page before, or any mapping with its ``by``
    and ``tie``. It is a bound of the scan (``by`` at most that time is pushed
    to the files), and no row before it is sorted or counted, so a page costs the
    same wherever it lies. Rows that came in since do not shift it.
    """
    if size < 1:
        raise ValueError("size must be at least 1")
    if last is not None:
        time = instant(last[by]) if isinstance(last[by], str) else F.lit(last[by])  # a collected time is in the driver's own zone
        rows = rows.where((F.col(by) <= time) & ((F.col(by) < time) | (F.col(tie) < F.lit(last[tie]))))
    return rows.orderBy(F.col(by).desc(), F.col(tie).desc()).limit(size)


def page_info(rows: DataFrame, page: int = 0, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """Total rows and pages, and whether this page is the last."""
    total = F.col("total_elements")
    return rows.agg(F.count(F.lit(1)).alias("total_elements")).select(
        F.lit(page).alias("page"), F.lit(size).alias("size"), total,
        F.ceil(total / size).cast("long").alias("total_pages"),
        ((page + 1) * size >= total).alias("is_last"),
    )


def merged_saved_queries(saved: DataFrame, team_id, user_id) -> DataFrame:
    """A user's own saved queries and those shared in the team, each once, own first."""
    own = saved.where(F.col("created_by") == F.lit(user_id)).withColumn("origin", F.lit("own"))
    shared = saved.where((F.col("team_id") == F.lit(team_id)) & F.col("is_shared")).withColumn("origin", F.lit("shared"))
    both = own.unionByName(shared)
    rest = [name for name in both.columns if name != "query_id"]
    return both.groupBy("query_id").agg(F.min_by(F.struct(*rest), F.col("origin")).alias("q")).select("query_id", "q.*")


def saved_query_usage(history: DataFrame) -> DataFrame:
    return history.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("execution_count"),
        F.max("created_at").alias("last_executed_at"),
        F.sum("result_count").alias("total_results"),
        F.avg("execution_time_ms").alias("avg_execution_ms"),
    )


def filter_equal(rows: DataFrame, **wanted) -> DataFrame:
    """Equality on the given columns; a value of None leaves the column out."""
    parts = [F.col(name) == F.lit(value) for name, value in wanted.items() if value is not None]
    return rows.where(reduce(Column.__and__, parts)) if parts else rows


def filter_range(rows: DataFrame, column: str, start=None, end=None, *, after=None) -> DataFrame:
    """``start <= column <= end``, or strictly after an instant."""
    if start is not None:
        rows = rows.where(F.col(column) >= instant(start))
    if end is not None:
        rows = rows.where(F.col(column) <= instant(end))
    if after is not None:
        rows = rows.where(F.col(column) > instant(after))
    return rows


def level_counts(entries: DataFrame, by: Sequence[str], start=None, end=None) -> DataFrame:
    """Total and per-level counts of every group in one pass."""
    ranged = filter_range(entries, "timestamp", start, end)
    counts = [F.count_if(F.col("level") == name).alias(f"n_{name.lower()}") for name in LEVELS]
    return ranged.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *counts)
