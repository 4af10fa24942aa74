"""Traps: pattern, frequency and absence rules over log entries.

Rules are data: a table with one row per trap (:data:`TRAP_TABLE`), or a list
of dicts with the same names. Pattern rules are filed in an index by a piece of
text that their matches must hold, so the tests that an entry costs grow with
its matches, not with the rules; counting rules are joined by what they count.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbed.functions import grams
from signalbed.functions.levels import LEVELS, level_compare, parse_level
from signalbed.functions.ordered import previous, running_total
from signalbed.functions.times import SECOND, instant, micros
from signalbed.operators.parse import reject_reasons
from signalbed.session import cut_lineage

# The fields a condition may look at, and their other spelling.
TRAP_FIELDS = (
    "message", "logger_name", "thread_name", "exception_class", "exception_message", "stack_trace",
    "service_name", "host_name", "ip_address", "correlation_id", "custom_fields", "level",
)
CONDITION_TYPES = ("REGEX", "KEYWORD", "FREQUENCY_THRESHOLD", "ABSENCE")
#: A trap and its conditions as a row.
TRAP_TABLE = """trap_id string, team_id bigint, trap_type string, is_active boolean, conditions array<struct<
    condition_type: string, field: string, pattern: string, log_level: string, service_name: string, threshold: bigint,
    window_seconds: bigint>>"""
CONDITION_FIELDS = ("condition_type", "field", "pattern", "log_level", "service_name", "threshold", "window_seconds")

Condition = Mapping[str, object]


def _snake(name: str) -> str:
    return "".join(f"_{c.lower()}" if c.isupper() else c for c in name)


def trap_field(name: str | None) -> Column | None:
    """The column of a field in snake_case or camelCase, None when unknown."""
    column = _snake(name) if name else None
    return F.col(column) if column in TRAP_FIELDS else None


def usable_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether the pattern compiles in the engine that will run it."""
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, PySparkException):
        return False
    return True


def _matches(condition: Condition, spark: SparkSession) -> Column:
    kind, pattern = condition["condition_type"], condition.get("pattern")
    if kind not in ("REGEX", "KEYWORD"):
        return F.lit(True)
    field = trap_field(condition.get("field"))
    if field is None or pattern is None:
        return F.lit(False)
    if kind == "KEYWORD":
        return F.contains(F.lower(field), F.lit(pattern.lower()))
    return field.rlike(pattern) if usable_pattern(spark, pattern) else F.lit(False)


def pattern_predicate(spark: SparkSession, conditions: Iterable[Condition]) -> Column:
    """One rule as a column: AND over the conditions; service, level at or above, then regex or keyword. None: true."""
    parts = [F.lit(True)]
    for condition in conditions:
        if (condition.get("service_name") or "").strip():
            parts.append(F.col("service_name") == condition["service_name"])
        if condition.get("log_level"):
            parts.append(level_compare(F.col("level"), ">=", condition["log_level"]))
        parts.append(_matches(condition, spark))
    return F.coalesce(reduce(Column.__and__, parts), F.lit(False))


def trap_table(spark: SparkSession, traps: DataFrame | Iterable[Mapping]) -> DataFrame:
    """The traps as a table; a list of dicts becomes one."""
    if isinstance(traps, DataFrame):
        return traps.select("trap_id", "team_id", "trap_type", "is_active", "conditions")
    rows = [
        (t["trap_id"], t["team_id"], t["trap_type"], t["is_active"],
         [tuple(c.get(name) for name in CONDITION_FIELDS) for c in t["conditions"]])
        for t in traps
    ]
    return spark.createDataFrame(rows, TRAP_TABLE).coalesce(1)  # a list is small: what is grouped of it needs no shuffle


def _active(spark: SparkSession, traps: DataFrame | Iterable[Mapping], kind: str) -> DataFrame:
    return trap_table(spark, traps).where(F.col("is_active") & (F.col("trap_type") == kind)).drop("is_active", "trap_type")


def compiles(pattern: Column) -> Column:
    """Whether a pattern compiles in the engine that runs it, decided in the task that holds it; null compiles."""
    tried = F.try_reflect(F.lit("org.apache.commons.lang3.RegExUtils"), F.lit("removeAll"), F.lit(""), pattern)
    return pattern.isNull() | tried.isNotNull()


def _prepared(rules: DataFrame) -> DataFrame:
    """Conditions in the form that :func:`_holds` reads: known field names, lower-case keywords, levels as a list.

    A regex that does not compile becomes null and never matches.
    """

    def prepared(c: Column) -> Column:
        snake = F.lower(F.regexp_replace(c["field"], "([A-Z])", "_$1"))
        kind, pattern = c["condition_type"], c["pattern"]
        at_least = F.coalesce(*[
            F.when(F.upper(c["log_level"]) == name, F.array(*[F.lit(x) for x in LEVELS[i:]])) for i, name in enumerate(LEVELS)
        ], F.array().cast("array<string>"))
        return F.struct(
            kind.isin("REGEX", "KEYWORD").alias("tests"),
            F.when(snake.isin(*TRAP_FIELDS), snake).alias("field"),
            F.when(kind == "KEYWORD", F.lower(pattern)).alias("keyword"),
            F.when((kind == "REGEX") & compiles(pattern), pattern).alias("regex"),
            F.when(F.trim(c["service_name"]) != "", c["service_name"]).alias("service"),
            F.when(F.length(c["log_level"]) > 0, at_least).alias("levels"),
        )

    return rules.select("trap_id", "team_id", F.transform("conditions", prepared).alias("conditions"))


#: Most rules whose index is broadcast.
BROADCAST_RULES = 50_000


def required_literal(regex: Column) -> Column:
    """The longest run of plain ASCII that every match of the pattern holds, in lower case; null where none is certain.

    Only patterns without groups, alternatives and escapes that stand for a
    number or a name are looked into; ``(?i)`` may come first.
    """
    body = F.regexp_replace(regex, r"^\(\?i\)", "")
    plain = ~F.rlike(body, F.lit(r"[|()]|\\[A-Za-z0-9&&[^dDwWsSbBtnr]]"))
    broken = F.regexp_replace(body, r"\\.", "\u0000")
    broken = F.regexp_replace(broken, r"\[\^?[^\[\]]*\]", "\u0000")
    plain &= ~F.rlike(broken, F.lit(r"[\[\]]"))
    broken = F.regexp_replace(broken, r"(?s).\{[^}]*\}|.[?*]", "\u0000")
    runs = F.split(broken, r"[^\x20-\x7e]+|[.^$+{}?*\\]+")
    longest = F.array_max(F.transform(runs, lambda run: F.struct(F.length(run).alias("size"), F.lower(run).alias("run"))))
    return F.when(plain & (longest["size"] >= min(grams.SIZES)), longest["run"])


def rule_index(rules: DataFrame) -> DataFrame:
    """(team_id, _field, _gram, _needle, trap_id, conditions): one row per prepared rule.

    A text that fulfils a condition must hold the condition's needle, its
    keyword or the literal of its pattern, and so each gram of it. A rule is
    filed under the gram that the fewest rules of its team have, of the longest
    needle where several are as rare. Grams grow with their needles, so that
    many rules need not share few grams. Rules without a needle are filed under
    the gram 0 of no field. A trap that is listed twice is one.
    """
    needles = rules.select("team_id", "trap_id", "conditions", F.explode_outer("conditions").alias("c")).select(
        "team_id", "trap_id", "conditions", F.coalesce("c.field", F.lit("")).alias("_field"),
        F.when(F.col("c.field").isNotNull(), F.coalesce("c.keyword", required_literal(F.col("c.regex")))).alias("_needle"))
    filed = needles.withColumn("_grams", grams.needle_grams("_needle")).withColumn("_gram", F.explode_outer("_grams")).drop("_grams")
    # Counted apart from the rules: many may share a gram, and a count needs none of them whole.
    key = ["team_id", "_field", "_gram"]
    filed = filed.join(filed.groupBy(*key).agg(F.count("*").alias("_rules")), key, "left")
    rarity = F.when(F.col("_gram").isNotNull(), F.struct("_rules", -F.length("_needle"), "_field", "_gram", "_needle"))
    seeds = filed.groupBy("team_id", "trap_id", F.xxhash64("conditions").alias("_rule")).agg(
        F.first("conditions").alias("conditions"), F.min_by(F.struct("_field", "_gram", "_needle"), rarity).alias("_seed"))
    return seeds.select(
        "team_id", F.coalesce("_seed._field", F.lit("")).alias("_field"), F.coalesce("_seed._gram", F.lit(0)).alias("_gram"),
        F.coalesce("_seed._needle", F.lit("")).alias("_needle"), "trap_id", "conditions")


def _holds(c: Column) -> Column:
    """Whether a prepared condition holds for the entry around it."""
    text = F.coalesce(*[F.when(c["field"] == name, F.col(name)) for name in TRAP_FIELDS])
    hit = F.when(c["keyword"].isNotNull(), F.contains(F.lower(text), c["keyword"])).when(
        c["regex"].isNotNull(), F.rlike(text, c["regex"])).otherwise(F.lit(False))
    return F.coalesce(
        (c["service"].isNull() | (F.col("service_name") == c["service"]))
        & (c["levels"].isNull() | F.array_contains(c["levels"], F.col("level")))
        & (~c["tests"] | hit), F.lit(False),
    )


def _with_fields(entries: DataFrame) -> DataFrame:
    missing = [name for name in (*TRAP_FIELDS, "service_name", "level") if name not in entries.columns]
    return entries.withColumns({name: F.lit(None).cast("string") for name in missing}) if missing else entries


def _in_field(field: str, numbers: Column) -> Column:
    return F.transform(numbers, lambda gram: F.struct(F.lit(field).alias("_field"), gram.alias("_gram")))


def pattern_hits(entries: DataFrame, traps: DataFrame | Sequence[Mapping]) -> DataFrame:
    """One row per entry and active pattern trap of its team that fires; no traps give no rows.

    Entries meet the rules over :func:`rule_index`: each entry asks once for
    those grams of the fields that rules look at which a filter of all filed
    grams knows, and only rules filed under one of them are tested, first by
    their needle, then by all their conditions.
    """
    spark = entries.sparkSession
    index = rule_index(_prepared(_active(spark, traps, "PATTERN")))
    # As far as it is known to be small the index is broadcast; beyond that both sides are shuffled, never the entries sent out.
    few = index.limit(BROADCAST_RULES + 1).collect()
    small = len(few) <= BROADCAST_RULES
    index = spark.createDataFrame(few, index.schema).coalesce(1) if small else cut_lineage(index)
    looked = index.groupBy("_field").agg(F.count(F.lit(1)).alias("n"), F.collect_set(grams.size_of(F.col("_needle"))).alias("sizes")).collect()
    sizes = {r["_field"]: r["sizes"] for r in looked if r["_field"]}
    rows = _with_fields(entries)
    asked = [F.array(F.struct(F.lit("").alias("_field"), F.lit(0).cast("long").alias("_gram")))] if len(sizes) < len(looked) else []
    if sizes:
        wanted = grams.gram_filter(index.where("_field <> ''").select("_gram"), sum(r["n"] for r in looked))
        rows = rows.withColumns({f"_asked_{name}": grams.asked_grams(F.lower(name), wanted, sizes[name]) for name in sizes})
        asked += [_in_field(name, F.col(f"_asked_{name}")) for name in sizes]
    none = F.expr("CAST(array() AS array<struct<_field: string, _gram: bigint>>)")
    rows = rows.withColumn("_of", F.explode(F.concat(none, *asked))).select(*rows.columns, "_of.*")
    near = rows.join(F.broadcast(index) if small else index.hint("shuffle_merge"), ["team_id", "_field", "_gram"])
    text = F.coalesce(*[F.when(F.col("_field") == name, F.lower(name)) for name in sizes], F.lit(""))
    return near.where(F.contains(text, "_needle")).where(F.forall("conditions", _holds)).select(*entries.columns, "trap_id")


def counted_rows(condition: Condition) -> Column:
    """Service and exact level restrict a count only when both are given."""
    if condition.get("service_name") and condition.get("log_level"):
        same = (F.col("service_name") == condition["service_name"]) & (F.col("level") == parse_level(condition["log_level"]))
        return F.coalesce(same, F.lit(False))
    return F.lit(True)


def _sliding(times: DataFrame, keys: Sequence[str], width: Column) -> DataFrame:
    """(keys, at, window_count) of ``times`` (keys, at, n): the sum of n in [at - width, at].

    The count is a difference of two running totals, so a busy key is spread
    over its seconds instead of filling one window.
    """
    edges = F.explode(F.array(
        F.struct(F.col("at"), F.lit(1).alias("upper"), F.col("n"), width.alias("width")),
        F.struct((F.col("at") - width).alias("at"), F.lit(0).alias("upper"), F.lit(0).cast("long").alias("n"), width.alias("width")),
    )).alias("e")
    # A lower edge comes before the entries of its own microsecond: they are inside the window.
    rows = times.select(*keys, edges).select(*keys, "e.*")
    totals = running_total(rows, list(keys), "at", "n", "total", tie=["upper"])
    moment = F.when(F.col("upper") == 1, F.col("at")).otherwise(F.col("at") + F.col("width"))
    signed = F.when(F.col("upper") == 1, F.col("total")).otherwise(-F.col("total"))
    return totals.groupBy(*keys, moment.alias("at")).agg(F.sum(signed).alias("window_count"))


def window_counts(entries: DataFrame, condition: Condition, keys: Sequence[str] = ("team_id",)) -> DataFrame:
    """(keys, at, window_count): counted entries in [at - window, at] for every time that has an entry."""
    times = entries.groupBy(*keys, micros(F.col("timestamp")).alias("at")).agg(
        F.count_if(counted_rows(condition)).alias("n")
    )
    return _sliding(times, keys, F.lit(int(condition["window_seconds"]) * SECOND))


def _counting(rules: DataFrame, kind: str) -> DataFrame:
    """(trap_id, team_id, condition, threshold, window_seconds, service, level) of the conditions of a kind.

    Service and level are null unless both are given: only then do they restrict a count.
    """
    rows = rules.select("trap_id", "team_id", F.posexplode("conditions").alias("condition", "c")).where(F.col("c.condition_type") == kind)
    both = (F.length("c.service_name") > 0) & (F.length("c.log_level") > 0)
    level = F.upper("c.log_level")
    return rows.select(
        "trap_id", "team_id", "condition", "c.threshold", "c.window_seconds", F.when(both, F.col("c.service_name")).alias("service"),
        F.when(both, F.when(level.isin(*LEVELS), level).otherwise(F.lit(""))).alias("own_level"),
    )


def frequency_hits(entries: DataFrame, traps: DataFrame | Sequence[Mapping]) -> DataFrame:
    """One row per entry and active frequency trap of its team whose thresholds are all reached.

    Entries are counted per team, service, level and moment first; these counts
    meet the counting rules of their team, each distinct rule once. A condition
    without threshold or window never holds.
    """
    rules = _active(entries.sparkSession, traps, "FREQUENCY")
    conditions = _counting(rules, "FREQUENCY_THRESHOLD")
    needed = rules.select("trap_id", "team_id", F.size(F.filter(
        "conditions", lambda c: c["condition_type"] == "FREQUENCY_THRESHOLD")).alias("needed"))
    what = ["team_id", "window_seconds", "service", "own_level"]
    usable = conditions.where("threshold IS NOT NULL AND window_seconds IS NOT NULL").withColumn("key", F.to_json(F.struct(*what), {"ignoreNullFields": "false"}))
    counting = usable.select(*what, "key").distinct()
    moments = entries.groupBy("team_id", "service_name", "level", micros(F.col("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("service").isNull() | F.coalesce((F.col("service_name") == F.col("service")) & (F.col("level") == F.col("own_level")), F.lit(False))
    times = moments.join(counting, "team_id").groupBy("key", "window_seconds", "at").agg(F.sum(F.when(own, F.col("n")).otherwise(0)).alias("n"))
    counts = _sliding(times, ["key"], F.col("window_seconds") * F.lit(SECOND))
    reached = (
        counts.join(usable.select("key", "trap_id", "threshold"), "key").where("window_count >= threshold")
        .groupBy("trap_id", "at").agg(F.count(F.lit(1)).alias("held"))
    )
    fired = reached.join(needed, "trap_id").where("held = needed").select("trap_id", "team_id", F.col("at").alias("_at"))
    rows = entries.withColumn("_at", micros(F.col("timestamp"))).join(fired, ["team_id", "_at"])
    always = entries.join(needed.where("needed = 0").select("trap_id", "team_id"), "team_id")
    return rows.select(*entries.columns, "trap_id").unionByName(always.select(*entries.columns, "trap_id"))


def trap_hits(entries: DataFrame, traps: DataFrame | Sequence[Mapping]) -> DataFrame:
    return pattern_hits(entries, traps).unionByName(frequency_hits(entries, traps))


def absences(entries: DataFrame, traps: DataFrame | Sequence[Mapping], as_of) -> DataFrame:
    """(team_id, trap_id, condition, seen, absent) of every absence condition at ``as_of``; no rules give no rows."""
    rules = _counting(_active(entries.sparkSession, traps, "ABSENCE"), "ABSENCE").where("window_seconds IS NOT NULL")
    end = instant(as_of)
    longest = rules.agg(F.max("window_seconds")).first()[0] or 0  # a literal, so that the scan is cut to it
    recent = entries.where((F.col("timestamp") <= end) & (F.col("timestamp") >= end - F.make_dt_interval(secs=F.lit(longest))))
    moments = recent.groupBy("team_id", "service_name", "level", micros(F.col("timestamp")).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    own = F.col("service").isNull() | F.coalesce((F.col("service_name") == F.col("service")) & (F.col("level") == F.col("own_level")), F.lit(False))
    since = micros(end) - F.col("window_seconds") * F.lit(SECOND)
    key = ["team_id", "trap_id", "condition"]
    found = moments.join(rules, "team_id").where(own & (F.col("at") >= since)).groupBy(*key).agg(F.sum("n").alias("_seen"))
    seen = F.coalesce("_seen", F.lit(0))
    return rules.select(*key).join(found, key, "left").select(*key, seen.alias("seen"), (seen == 0).alias("absent"))


def absence_gaps(entries: DataFrame, traps: DataFrame | Sequence[Mapping], start, end) -> DataFrame:
    """(team_id, trap_id, condition, absent_from, absent_until, still_absent): when absence conditions held in [start, end].

    A condition holds at every time whose window up to that time has no counted
    entry: from one microsecond after the window of the last entry has passed
    until the next entry. A gap that has begun before ``start`` begins there;
    one that goes on at ``end`` is still absent and has no end. Conditions that
    count the same entries share one series of moments, scanned once whatever
    their windows; the scan starts the longest window before ``start``.
    """
    rules = _counting(_active(entries.sparkSession, traps, "ABSENCE"), "ABSENCE").where("window_seconds IS NOT NULL")
    rules = rules.withColumn("width", F.col("window_seconds") * F.lit(SECOND))
    longest = rules.agg(F.max("window_seconds")).first()[0] or 0  # a literal, so that the scan is cut to it
    first, last = instant(start), instant(end)
    near = entries.where((F.col("timestamp") <= last) & (F.col("timestamp") >= first - F.make_dt_interval(secs=F.lit(longest))))
    moments = near.select("team_id", "service_name", "level", micros(F.col("timestamp")).alias("at")).distinct()
    whole, own = F.col("service").isNull(), F.col("service").isNotNull()
    what = ["team_id", "service", "own_level"]
    watched = rules.select(*what).distinct()
    by_team = moments.join(watched.where(whole), "team_id").select(*what, "at")
    by_service = moments.withColumnsRenamed({"service_name": "service", "level": "own_level"}).join(watched.where(own), what).select(*what, "at")
    # A moment before all that was read, and one after the end, bound every series, one without entries too.
    edges = watched.withColumn("at", F.explode(F.array(micros(first) - F.lit(longest * SECOND + 1), micros(last) + 1)))
    key = F.to_json(F.struct(*what), {"ignoreNullFields": "false"}).alias("key")
    points = by_team.unionByName(by_service).unionByName(edges).select(key, "at").distinct()
    steps = previous(points, ["key"], "at", []).where("before IS NOT NULL").select("key", F.col("before.at").alias("seen"), F.col("at").alias("next"))
    gaps = steps.join(rules.select(key, "team_id", "trap_id", "condition", "width"), "key")
    begins = F.greatest(F.col("seen") + F.col("width") + 1, micros(first))
    gaps = gaps.withColumn("begins", begins).where(F.col("begins") < F.col("next"))
    open_ = F.col("next") > micros(last)
    return gaps.select(
        "team_id", "trap_id", "condition", F.timestamp_micros("begins").alias("absent_from"),
        F.when(~open_, F.timestamp_micros("next")).alias("absent_until"), open_.alias("still_absent"))


def trap_statistics(hits: DataFrame) -> DataFrame:
    return hits.groupBy("trap_id").agg(
        F.count(F.lit(1)).alias("trigger_count"), F.max("timestamp").alias("last_triggered_at")
    )


def _window_of(entries: DataFrame, team_id, start, end) -> DataFrame:
    return entries.where(
        (F.col("team_id") == F.lit(team_id)) & (F.col("timestamp") >= instant(start)) & (F.col("timestamp") <= instant(end))
    )


def back_test(entries: DataFrame, conditions: Sequence[Condition], team_id, start, end) -> DataFrame:
    """How many entries of the range would have matched."""
    rows = _window_of(entries, team_id, start, end)
    hit = F.count_if(pattern_predicate(entries.sparkSession, conditions))
    total = F.count(F.lit(1))
    return rows.agg(hit.alias("match_count"), total.alias("total_evaluated")).select(
        "match_count", "total_evaluated",
        F.when(F.col("total_evaluated") > 0, F.col("match_count") * 100.0 / F.col("total_evaluated")).otherwise(0.0).alias("match_percentage"),
    )


def back_test_samples(entries: DataFrame, conditions: Sequence[Condition], team_id, start, end) -> DataFrame:
    """Ids of all matches; page them with :func:`signalbed.operators.query.newest_page`."""
    rows = _window_of(entries, team_id, start, end).where(pattern_predicate(entries.sparkSession, conditions))
    return rows.select("id", "timestamp")


def condition_reject_reasons(conditions: DataFrame) -> DataFrame:
    """Rule rows with what is wrong with them. Patterns are checked by :func:`usable_pattern`."""
    kind, level = F.upper("condition_type"), F.upper("log_level")
    rules = [
        (~F.coalesce(kind.isin(*CONDITION_TYPES), F.lit(False)), "unknown condition type"),
        ((kind == "FREQUENCY_THRESHOLD") & F.col("threshold").isNull(), "threshold is missing"),
        ((kind == "FREQUENCY_THRESHOLD") & F.col("window_seconds").isNull(), "window is missing"),
        ((kind == "ABSENCE") & F.col("window_seconds").isNull(), "window is missing"),
        (level.isNotNull() & ~level.isin(*LEVELS), "unknown log level"),
    ]
    return conditions.withColumn("reasons", reject_reasons(rules))


def policy_reject_reasons(policies: DataFrame) -> DataFrame:
    action = F.upper("action")
    rules = [
        (~F.coalesce(action.isin("PURGE", "ARCHIVE"), F.lit(False)), "unknown action"),
        ((action == "ARCHIVE") & (F.trim(F.coalesce("archive_destination", F.lit(""))) == ""), "archive destination is missing"),
        (~F.coalesce(F.col("retention_days").between(1, 365), F.lit(False)), "retention days out of range"),
    ]
    return policies.withColumn("reasons", reject_reasons(rules))
