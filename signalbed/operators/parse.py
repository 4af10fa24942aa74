"""Raw log lines to log entries, with built-in expressions only.

Five line formats are tried in a fixed order: JSON, key=value pairs, the Spring
Boot console line, syslog, plain text. Each later format is looked at only when
the earlier ones gave nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalbed.functions.times import parse_time

# The spellings under which a line may carry each field, in the order they are tried.
ALIASES = {
    "level": ("level", "severity", "log.level"),
    "message": ("message", "msg", "@message"),
    "timestamp": ("timestamp", "@timestamp", "time"),
    "logger_name": ("logger", "logger_name", "loggername"),
    "thread_name": ("thread", "thread_name", "threadname"),
    "service_name": ("service", "service.name", "servicename"),
    "correlation_id": ("correlation_id", "correlationid", "x-correlation-id"),
    "trace_id": ("trace_id", "traceid"),
    "span_id": ("span_id", "spanid"),
    "host_name": ("host", "hostname"),
    "exception": ("exception", "error"),
    "stack_trace": ("stack_trace", "stacktrace", "exception.stacktrace"),
}

# Line patterns.
KEY_VALUE = r'(\w+)=("[^"]*"|\S+)'
SPRING_BOOT = (
    r"(?s)^(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}\.?\d*)\s+(TRACE|DEBUG|INFO|WARN|ERROR|FATAL)\s+"
    r"(?:\[([^]]*)]\s+)?(\d+)\s+---\s+\[\s*([^]]+)]\s+(\S+)\s*:\s*(.*)$"
)
SYSLOG = (
    r"(?s)^(?:<(\d{1,3})>)?(\w{3}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2})\s+(\S+)\s+"
    r"(\S+?)(?:\[(\d+)])?:\s*(.*)$"
)
# Level of each syslog severity, 0 to 7.
SYSLOG_LEVELS = ("FATAL", "FATAL", "FATAL", "ERROR", "WARN", "INFO", "INFO", "DEBUG")

PARSED = (
    "level", "message", "timestamp", "service_name", "correlation_id", "trace_id", "span_id",
    "logger_name", "thread_name", "exception_class", "exception_message", "stack_trace",
    "custom_fields", "host_name",
)

# SQL literals: characters up to the blank, and a mark no trimmed line starts with.
_BLANKS = "'" + "".join(f"\\u{code:04x}" for code in range(33)) + "'"
_MARK = "\\u0001"


def _trimmed(text: str) -> str:
    return f"btrim({text}, {_BLANKS})"


def _json_field(name: str) -> str:
    """Exact key first, then the first key that matches in any case."""
    exact = ", ".join(f"j.`{alias}`" for alias in ALIASES[name])
    places = ", ".join(f"nullif(array_position(_json_lower, '{alias}'), 0)" for alias in ALIASES[name])
    return f"coalesce({exact}, CASE WHEN _mixed THEN get(_json_values, int(least({places})) - 1) END)"


def _pair_field(name: str) -> str:
    """A missing alias has place 0, and ``get`` gives null for -1."""
    places = [f"get(_pair_values, int(array_position(_pair_keys, '{alias}')) - 1)" for alias in ALIASES[name]]
    return f"coalesce({', '.join(places)})"


def _split(pattern: str, count: int) -> str:
    """An empty text and the groups when the line matches, anything else when not.

    One replacement finds all groups, with a mark between them; a line that
    holds the mark itself is searched group by group.
    """
    groups = _MARK.join(f"${n}" for n in range(1, count + 1))
    at_once = f"split(regexp_replace(_line, r'{pattern}', '{_MARK}{groups}'), '{_MARK}', {count + 1})"
    each = ", ".join(f"regexp_extract(_line, r'{pattern}', {n})" for n in range(1, count + 1))
    return f"""CASE WHEN NOT contains(_line, '{_MARK}') THEN {at_once}
        WHEN _line RLIKE r'{pattern}' THEN array('', {each}) ELSE array(_line) END"""


def _split_ok(parts: str, count: int) -> str:
    return f"coalesce(size({parts}) = {count + 1} AND get({parts}, 0) = '', false)"


def _bound(rows: DataFrame, **named: str) -> DataFrame:
    """Add columns that are computed once and then only read.

    ``inline`` of one row keeps the optimizer from copying these long
    expressions into every later use and into filters above.
    """
    fields = ", ".join(f"'{name}', {value}" for name, value in named.items())
    return rows.selectExpr("*", f"inline(array(named_struct({fields})))")


def parse_raw_logs(df: DataFrame, raw: str = "raw", default_service: Column | None = None) -> DataFrame:
    """Add the parsed fields and ``log_format`` to every row of ``df``."""
    kept = [name for name in df.columns if name not in PARSED]
    default = F.lit(None).cast("string") if default_service is None else default_service
    rows = _bound(df.withColumn("_default", default), _line=f"coalesce({_trimmed(raw)}, '')")
    rows = rows.select(*kept, "_default", "_line")

    rows = _bound(rows, _map="CASE WHEN startswith(_line, '{') THEN from_json(_line, 'map<string,string>') END")
    rows = _bound(rows, _present="map_filter(_map, (k, v) -> v IS NOT NULL)")
    rows = _bound(rows, _json_values="map_values(_present)", _json_lower="transform(map_keys(_present), k -> lower(k))",
                  _mixed="map_keys(_present) <> transform(map_keys(_present), k -> lower(k))")
    schema = ", ".join(f"`{alias}` string" for group in ALIASES.values() for alias in group)
    fields = ", ".join(f"'_json_{name}', {_json_field(name)}" for name in ALIASES)
    # Lines that are no JSON skip the fields as a whole.
    rows = rows.selectExpr("*", f"""inline(transform(array(CASE WHEN _map IS NOT NULL THEN from_json(_line, '{schema}') END),
        j -> CASE WHEN j IS NOT NULL THEN named_struct({fields}) END))""")
    rows = rows.select(*kept, "_default", "_line", "_map", *[f"_json_{name}" for name in ALIASES])

    is_json = "coalesce(_json_level, _json_message) IS NOT NULL"
    # Reversed, so that the first hit is the last pair of that name.
    rows = _bound(rows, _pairs=f"""CASE WHEN NOT ({is_json}) AND contains(_line, '=')
        THEN reverse(regexp_extract_all(_line, r'{KEY_VALUE}', 0)) END""")
    value = "substring(p, instr(p, '=') + 1)"
    unquoted = f"CASE WHEN {value} LIKE '\"%\"' THEN substring({value}, 2, length({value}) - 2) ELSE {value} END"
    rows = _bound(rows, _pair_keys="transform(_pairs, p -> lower(substring_index(p, '=', 1)))",
                  _pair_values=f"transform(_pairs, p -> {unquoted})")
    rows = _bound(rows, _form=f"CASE WHEN {is_json} THEN 'json' WHEN size(array_distinct(_pair_keys)) >= 2 THEN 'key_value' END")
    rows = _bound(rows, _spring=f"CASE WHEN _form IS NULL THEN {_split(SPRING_BOOT, 7)} END")
    rows = _bound(rows, _syslog=f"CASE WHEN _form IS NULL AND NOT ({_split_ok('_spring', 7)}) THEN {_split(SYSLOG, 6)} END")
    rows = _bound(
        rows,
        log_format=f"""CASE WHEN _form IS NOT NULL THEN _form WHEN {_split_ok('_spring', 7)} THEN 'spring_boot'
            WHEN {_split_ok('_syslog', 6)} THEN 'syslog' ELSE 'plain' END""",
        _extras=f"CASE WHEN _form = 'json' THEN {_extras()} END",
    )

    rows = _bound(rows, **{f"_{name}": _field(name) for name in PARSED})
    rows = rows.select(*kept, "_default", "log_format", *[f"_{name}" for name in PARSED]).withColumn("_at", parse_time(F.col("_timestamp")))
    final = {
        "message": "_message", "timestamp": "_at",
        "service_name": """CASE WHEN log_format = 'plain' OR trim(_service_name) <> '' THEN _service_name
            WHEN trim(_default) <> '' THEN _default ELSE 'unknown' END""",
    }
    rows = _bound(rows, **{name: final.get(name, f"_{name}") for name in PARSED})
    return rows.select(*kept, *PARSED, "log_format")


def _field(name: str) -> str:
    """A field as each line format gives it."""
    thrown_class = "instr(_json_exception, ':') > 1"
    special = {
        "json": {
            "level": "coalesce(_json_level, 'INFO')",
            "message": "coalesce(_json_message, _line)",
            "exception_class": f"CASE WHEN {thrown_class} THEN {_trimmed('substring_index(_json_exception, chr(58), 1)')} END",
            "exception_message": f"CASE WHEN {thrown_class} THEN {_trimmed('substring(_json_exception, instr(_json_exception, chr(58)) + 1)')} ELSE _json_exception END",
            "custom_fields": "CASE WHEN size(_extras) > 0 THEN to_json(_extras) END",
        },
        "key_value": {
            "level": f"coalesce({_pair_field('level')}, 'INFO')",
            "message": f"coalesce({_pair_field('message')}, _line)",
            "stack_trace": "NULL",
        },
        "spring_boot": {
            "timestamp": "_spring[1]", "level": "_spring[2]", "logger_name": "_spring[6]",
            "thread_name": _trimmed("_spring[5]"), "message": _trimmed("_spring[7]"),
            **{field: "nullif(" + _trimmed(f"get(split(_spring[3], ','), {n})") + ", '')"
               for n, field in enumerate(("service_name", "trace_id", "span_id"))},
        },
        "syslog": {
            "level": f"coalesce(get(array({', '.join(repr(level) for level in SYSLOG_LEVELS)}), try_cast(_syslog[1] AS INT) & 7), 'INFO')",
            "host_name": "_syslog[3]", "service_name": "_syslog[4]", "message": _trimmed("_syslog[6]"),
        },
        "plain": {
            "level": "'INFO'", "message": "CASE WHEN _line = '' THEN '(empty)' ELSE _line END", "service_name": "_default",
        },
    }
    if name in ALIASES:
        special["json"].setdefault(name, f"_json_{name}")
        special["key_value"].setdefault(name, _pair_field(name))
    cases = " ".join(f"WHEN '{form}' THEN {given[name]}" for form, given in special.items() if name in given)
    return f"string(CASE log_format {cases} END)"


def _extras() -> str:
    """JSON keys that stand for no field, with null as the text ``null``."""
    known = ", ".join(f"'{alias}'" for group in ALIASES.values() for alias in group)
    return f"transform_values(map_filter(_map, (k, v) -> lower(k) NOT IN ({known})), (k, v) -> coalesce(v, 'null'))"


def reject_reasons(rules: list[tuple[Column, str]]) -> Column:
    """The texts of all rules whose test holds, as an array."""
    return F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
