"""Retention: what the policies remove, storage usage, purge and archive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalbed.functions.levels import LEVELS, level_ordinal
from signalbed.functions.times import instant, utc_day
from signalbed.session import cut_lineage
from signalbed.sources.folders import children, remove

MIN_DAYS, MAX_DAYS = 1, 365


def _cutoff(as_of, days: Column) -> Column:
    return instant(as_of) - F.make_dt_interval(days=days)


def policy_cutoffs(policies: DataFrame, as_of) -> DataFrame:
    """(team_id, level, source_name, cutoff): per level a policy covers, the latest cutoff.

    A policy on a level covers that level and all below, one without a level
    covers every level. ``source_name`` is null where all sources are meant.
    """
    top = F.coalesce(level_ordinal(F.upper("log_level")), F.lit(len(LEVELS) - 1))
    levels = F.slice(F.array(*[F.lit(name) for name in LEVELS]), 1, top + 1)
    covered = policies.where("is_active").select(
        "team_id", "source_name", F.explode(levels).alias("level"), _cutoff(as_of, F.col("retention_days")).alias("cutoff")
    )
    return covered.groupBy("team_id", "level", "source_name").agg(F.max("cutoff").alias("cutoff"))


def with_expiry(entries: DataFrame, policies: DataFrame, as_of, source: str = "service_name") -> DataFrame:
    """Entries with ``expired``. Two equi joins on the cutoffs; each entry stays one row."""
    cutoffs = policy_cutoffs(policies, as_of)
    general = cutoffs.where("source_name IS NULL").select("team_id", "level", F.col("cutoff").alias("_all"))
    special = cutoffs.where("source_name IS NOT NULL").select(
        "team_id", "level", F.col("source_name").alias(source), F.col("cutoff").alias("_own")
    )
    rows = entries.join(general, ["team_id", "level"], "left")
    rows = rows.join(special, ["team_id", "level", source], "left")
    expired = F.coalesce(F.col("timestamp") < F.greatest("_all", "_own"), F.lit(False))
    return rows.withColumn("expired", expired).drop("_all", "_own")


def expired_logs(entries: DataFrame, policies: DataFrame, as_of, source: str = "service_name") -> DataFrame:
    """The entries that some policy removes.

    No policy reaches beyond the shortest of them; that bound is a literal, so
    the scan leaves out day folders and row groups.
    """
    shortest = policies.where("is_active").agg(F.min("retention_days")).first()[0]
    if shortest is None:
        return entries.where(F.lit(False))
    old = entries.where(F.col("timestamp") < _cutoff(as_of, F.lit(int(shortest))))
    return with_expiry(old, policies, as_of, source).where("expired").drop("expired")


def kept_logs(entries: DataFrame, policies: DataFrame, as_of, source: str = "service_name") -> DataFrame:
    return with_expiry(entries, policies, as_of, source).where("NOT expired").drop("expired")


def policy_hits(entries: DataFrame, policies: DataFrame, as_of, source: str = "service_name") -> DataFrame:
    """How many entries each active policy alone would remove.

    Entries are counted per (team, level, source, day) first, so the policies
    meet counts, never single entries.
    """
    cutoffs = policies.where("is_active").select(
        "policy_id", "team_id", "source_name",
        F.explode(F.slice(F.array(*[F.lit(name) for name in LEVELS]), 1,
                          F.coalesce(level_ordinal(F.upper("log_level")), F.lit(len(LEVELS) - 1)) + 1)).alias("level"),
        _cutoff(as_of, F.col("retention_days")).alias("cutoff"),
    )
    # The cutoffs of all policies share the time of day of ``as_of``, so days that
    # start at that time lie wholly before or after each cutoff.
    shift = F.unix_micros(instant(as_of))
    day = F.floor((F.unix_micros("timestamp") - shift) / F.lit(86_400_000_000))
    counts = entries.groupBy("team_id", "level", F.col(source).alias("_source"), day.alias("_day")).agg(F.count(F.lit(1)).alias("n"))
    last_day = F.floor((F.unix_micros("cutoff") - shift) / F.lit(86_400_000_000))
    pairs = counts.join(cutoffs.withColumn("_cut", last_day), ["team_id", "level"])
    hit = pairs.where((F.col("_day") < F.col("_cut")) & (F.col("source_name").isNull() | (F.col("source_name") == F.col("_source"))))
    found = hit.groupBy("policy_id").agg(F.sum("n").alias("removed"))
    return policies.where("is_active").select("policy_id").join(found, "policy_id", "left").select(
        "policy_id", F.coalesce("removed", F.lit(0)).alias("removed")
    )


def _checked_days(days: int) -> int:
    if not MIN_DAYS <= days <= MAX_DAYS:
        raise ValueError("retention days must be between 1 and 365")
    return days


def purge_before(rows: DataFrame, column: str, as_of, days: int) -> tuple[DataFrame, DataFrame]:
    """(kept, removed): rows strictly older than ``days`` go."""
    old = F.col(column) < _cutoff(as_of, F.lit(_checked_days(days)))
    return rows.where(~old), rows.where(old)


def global_purge_counts(entries: DataFrame, series: DataFrame, spans: DataFrame, as_of, days: int) -> DataFrame:
    cutoff = _cutoff(as_of, F.lit(_checked_days(days)))

    def one(rows: DataFrame, column: str, name: str) -> DataFrame:
        old = F.col(column) < cutoff
        return rows.agg(F.count_if(old).alias("removed"), F.count_if(~old).alias("kept")).select(F.lit(name).alias("fact"), "removed", "kept")

    return one(entries, "timestamp", "log_entries").unionByName(one(series, "timestamp", "metric_series")).unionByName(
        one(spans, "start_time", "trace_spans")
    )


def storage_usage(entries: DataFrame, series: DataFrame, spans: DataFrame, policies: DataFrame) -> DataFrame:
    """Counts in all, by service and by level, with oldest and newest entry; one scan of the logs."""
    pairs = entries.groupBy("service_name", "level").agg(
        F.count(F.lit(1)).alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")
    )
    logs = pairs.groupingSets([[], ["service_name"], ["level"]], "service_name", "level").agg(
        F.grouping_id().alias("g"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("lo").alias("oldest"), F.max("hi").alias("newest")
    ).select(
        F.when(F.col("g") == 3, "log_entries").when(F.col("g") == 1, "service").otherwise("level").alias("part"),
        F.coalesce("service_name", "level", F.lit("all")).alias("name"), "n", "oldest", "newest",
    )
    none = F.lit(None).cast("timestamp")

    def total(rows: DataFrame, part: str) -> DataFrame:
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), F.lit("all").alias("name"), "n",
                                                             none.alias("oldest"), none.alias("newest"))

    return (
        logs.unionByName(total(series, "metric_series")).unionByName(total(spans, "trace_spans"))
        .unionByName(total(policies.where("is_active"), "active_policies"))
    )


def archive_routes(entries: DataFrame, policies: DataFrame, as_of, source: str = "service_name") -> DataFrame:
    """The entries that ARCHIVE policies remove, once for each ``archive_destination`` they go to.

    Cutoffs are joined by team, level and source. A policy of one source only
    adds what a general policy with the same destination leaves.
    """
    archives = policies.where("is_active AND upper(action) = 'ARCHIVE' AND archive_destination IS NOT NULL")
    levels = F.slice(F.array(*[F.lit(name) for name in LEVELS]), 1, F.coalesce(level_ordinal(F.upper("log_level")), F.lit(len(LEVELS) - 1)) + 1)
    cutoffs = archives.select(
        "team_id", "source_name", "archive_destination", F.explode(levels).alias("level"), _cutoff(as_of, F.col("retention_days")).alias("cutoff"))
    cutoffs = cutoffs.groupBy("team_id", "level", "source_name", "archive_destination").agg(F.max("cutoff").alias("cutoff"))
    general = cutoffs.where("source_name IS NULL").select("team_id", "level", "archive_destination", F.col("cutoff").alias("_all"))
    special = cutoffs.where("source_name IS NOT NULL").withColumnRenamed("source_name", source).join(
        general, ["team_id", "level", "archive_destination"], "left")
    # Entries meet all their routes in one join: a general route is one of every source.
    by_source = special.select("team_id", "level", source, F.struct("archive_destination", "cutoff", "_all").alias("route"))
    by_source = by_source.groupBy("team_id", "level", source).agg(F.collect_list("route").alias("_own"))
    every = general.select("team_id", "level", F.struct("archive_destination", F.col("_all").alias("cutoff"), F.lit(None).cast("timestamp").alias("_all")).alias("route"))
    every = every.groupBy("team_id", "level").agg(F.collect_list("route").alias("_general"))
    rows = entries.join(every, ["team_id", "level"], "left").join(by_source, ["team_id", "level", source], "left")
    none = F.array().cast(every.schema["_general"].dataType)
    routes = F.explode(F.concat(F.coalesce("_general", none), F.coalesce("_own", none)))
    rows = rows.withColumn("_route", routes).where(
        (F.col("timestamp") < F.col("_route.cutoff")) & (F.col("_route._all").isNull() | (F.col("timestamp") >= F.col("_route._all"))))
    return rows.select(*entries.columns, "_route.archive_destination")


def _replace_parts(rows: DataFrame, folder: str, *by: str) -> None:
    """Write the partitions that ``rows`` have and leave all others as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(folder)


def apply_policies(
    spark: SparkSession, folder: str, policies: DataFrame, as_of, archive_folder: str, source: str = "service_name"
) -> dict[str, Sequence[str]]:
    """Archive and remove what the policies say from the days below ``folder`` (see :mod:`signalbed.sources.sinks`).

    Only days that can hold expired entries are read, and only days that do are
    written. The archive is ``archive_destination=.../day=.../run=...``, all
    destinations in one pass. It is written before anything is removed, and a
    run that is repeated replaces its own parts by the same rows, so it may be
    started again after any failure.
    """
    shortest = policies.where("is_active").agg(F.min("retention_days")).first()[0]
    if shortest is None or not children(spark, folder):
        return {"changed": [], "emptied": []}
    bound = _cutoff(as_of, F.lit(int(shortest)))
    stored = spark.read.parquet(folder).where(F.col("day") <= utc_day(bound))
    expired = F.count_if("expired")
    by_day = with_expiry(stored, policies, as_of, source).groupBy("day").agg(expired.alias("expired"))
    hit = [row["day"] for row in by_day.where("expired > 0").collect()]  # one row per day
    if not hit:
        return {"changed": [], "emptied": []}
    rows = spark.read.parquet(folder).where(F.col("day").isin(hit))
    routed = archive_routes(rows, policies, as_of, source).withColumn("run", F.unix_micros(instant(as_of)))
    _replace_parts(routed, archive_folder, "archive_destination", "day", "run")
    kept = cut_lineage(kept_logs(rows, policies, as_of, source))
    _replace_parts(kept, folder, "day")
    left = {row[0] for row in kept.select("day").distinct().collect()}
    for day in set(hit) - left:
        remove(spark, f"{folder}/day={day}")
    return {"changed": sorted(map(str, hit)), "emptied": sorted(map(str, set(hit) - left))}


def archive(rows: DataFrame, folder: str, by: str = "timestamp") -> None:
    """Append rows below ``folder``, one directory per day."""
    rows.withColumn("day", utc_day(F.col(by))).write.mode("append").partitionBy("day").parquet(folder)


def run_policies(entries: DataFrame, policies: DataFrame, as_of, target: str, source: str = "service_name") -> dict[str, Sequence[str]]:
    """Archive what ARCHIVE policies remove, then write what stays to ``target``.

    ``target`` must not be the folder ``entries`` is read from. Archives come
    first: when a later step fails, nothing is lost.
    """
    archives = policies.where("is_active AND upper(action) = 'ARCHIVE'")
    folders = [row[0] for row in archives.select("archive_destination").distinct().collect()]
    for folder in folders:
        own = archives.where(F.col("archive_destination") == folder)
        archive(expired_logs(entries, own, as_of, source), folder)
    kept_logs(entries, policies, as_of, source).withColumn("day", utc_day(F.col("timestamp"))).write.mode("overwrite").partitionBy("day").parquet(target)
    return {"archived": folders, "kept": [target]}
