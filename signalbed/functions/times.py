"""Event time helpers: microseconds, millisecond differences, lenient parsing."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR


def instant(value: str | dt.datetime | Column) -> Column:
    """A timestamp literal; text without a zone is read as UTC."""
    if isinstance(value, Column):
        return value
    if isinstance(value, str):
        value = dt.datetime.fromisoformat(value)
    if value.tzinfo is None:
        value = value.replace(tzinfo=dt.timezone.utc)
    micros = (value - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)
    return F.timestamp_micros(F.lit(micros))


def micros(ts: Column) -> Column:
    return F.unix_micros(ts)


def utc_day(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the zone of the session: folders must not depend on it."""
    return F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int"))


def millis_between(start: Column, end: Column) -> Column:
    """Whole milliseconds from start to end, cut toward zero."""
    return F.timestamp_diff("MILLISECOND", start, end)


# The accepted spellings of a time (after the number forms).
ISO_INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{0,9})?([Zz]|[+-]\d{2}:\d{2})$"
LOCAL_FORMS = (
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{3}$", "yyyy-MM-dd HH:mm:ss.SSS"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\.\d{3}$", "yyyy-MM-dd'T'HH:mm:ss.SSS"),
)
MILLIS_ABOVE = 1_000_000_000_000


def parse_time(text: Column) -> Column:
    """ISO instant, else epoch number, else one of the local forms as UTC, else null."""
    number = F.when(text.rlike(r"^[+-]?\d{1,19}$"), text.try_cast("bigint"))
    limit = (2**63 - 1) // 1000
    epoch = F.when(
        number > MILLIS_ABOVE, F.when(number <= limit, F.timestamp_millis(number))
    ).when(F.abs(number) <= limit // 1000, F.timestamp_seconds(number))
    forms = [F.when(text.rlike(ISO_INSTANT), text.try_cast("timestamp")), epoch]
    for shape, pattern in LOCAL_FORMS:
        utc = F.try_to_timestamp(F.concat(text, F.lit("Z")), F.lit(pattern + "X"))
        forms.append(F.when(text.rlike(shape), utc))
    return F.coalesce(*forms)
