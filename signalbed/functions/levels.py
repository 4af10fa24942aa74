"""Severity order of log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six levels in order of severity.
LEVELS = ("TRACE", "DEBUG", "INFO", "WARN", "ERROR", "FATAL")


def parse_level(value: str) -> str:
    level = value.strip().upper()
    if level not in LEVELS:
        raise ValueError(f"invalid log level: {value}")
    return level


def level_ordinal(level: Column) -> Column:
    """0 for TRACE up to 5 for FATAL, null for anything else."""
    position = F.array_position(F.array(*[F.lit(name) for name in LEVELS]), level)
    return F.when(position > 0, (position - 1).cast("int"))


def level_compare(level: Column, op: str, value: str) -> Column:
    """Compare by severity. The test becomes ``IN`` on the stored text, so it reaches the scan."""
    n = LEVELS.index(parse_level(value))
    kept = {
        "=": LEVELS[n : n + 1],
        "!=": LEVELS[:n] + LEVELS[n + 1 :],
        ">": LEVELS[n + 1 :],
        ">=": LEVELS[n:],
        "<": LEVELS[:n],
        "<=": LEVELS[: n + 1],
    }
    if op not in kept:
        raise ValueError(f"operator {op!r} is not supported for levels")
    if not kept[op]:
        return level.isNull() & level.isNotNull()
    return level.isin(*kept[op])


def normal_level(level: Column) -> Column:
    """Upper-cased level, or null when it is not one of the six."""
    upper = F.upper(level)
    return F.when(upper.isin(*LEVELS), upper)
