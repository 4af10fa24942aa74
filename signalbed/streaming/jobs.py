"""The same operators on streams, in event time with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from signalbed.operators.alerts import fan_out, outbox, throttle, to_history
from signalbed.operators.ingest import ingest_logs, parse_topic_lines, topic_records
from signalbed.operators.traces import TRACE
from signalbed.operators.traps import counted_rows, pattern_hits
from signalbed.sources.folders import children, remove


def ingest(records: DataFrame) -> DataFrame:
    """Topic records to stored entries; a record that cannot be used is left out."""
    return ingest_logs(parse_topic_lines(topic_records(records)), F.current_timestamp())[0]


def pattern_stream(entries: DataFrame, traps: Sequence[Mapping]) -> DataFrame:
    return pattern_hits(entries, traps)


def frequency_windows(entries: DataFrame, condition: Mapping, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Sliding windows in which a team reaches the threshold."""
    width = f"{int(condition['window_seconds'])} seconds"
    counted = entries.where(counted_rows(condition)).withWatermark("timestamp", late)
    windows = counted.groupBy("team_id", F.window("timestamp", width, slide or width)).agg(F.count(F.lit(1)).alias("n"))
    return windows.where(F.col("n") >= condition["threshold"]).select("team_id", "window.start", "window.end", "n")


def metric_rollup(series: DataFrame, resolution: int = 60, late: str = "10 minutes") -> DataFrame:
    """Tumbling mean, count and range of every metric."""
    rows = series.withWatermark("timestamp", late)
    return rows.groupBy("metric_id", F.window("timestamp", f"{resolution} seconds")).agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max")
    ).select("metric_id", F.col("window.start").alias("bucket"), "value", "n", "min", "max")


def trace_sessions(spans: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """A trace is complete when nothing was added for ``gap``.

    Sessions are merged before the shuffle too, so a large trace arrives as a few rows.
    """
    spans.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    rows = spans.withWatermark("start_time", late)
    return rows.groupBy(TRACE, F.session_window("start_time", gap)).agg(
        F.count(F.lit(1)).alias("span_count"), F.bool_or(F.col("status") == "ERROR").alias("has_errors"),
        F.max(F.coalesce("end_time", "start_time")).alias("end_time"),
    ).select(TRACE, F.col("session_window.start").alias("start_time"), "end_time", "span_count", "has_errors")


def trap_statistics_stream(hits: DataFrame) -> DataFrame:
    """Trigger count and last time per trap, for update or complete mode."""
    return hits.groupBy("trap_id").agg(F.count(F.lit(1)).alias("trigger_count"), F.max("timestamp").alias("last_triggered_at"))


def _newest_per_batch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Only the newest time of a key matters: combine before the shuffle."""
    for pdf in batches:
        yield pdf.groupby("key", as_index=False)["timestamp"].max()


def absence_stream(
    entries: DataFrame, key: str, window_seconds: int, late: str = "10 minutes", condition: Mapping | None = None
) -> DataFrame:
    """(key, last_seen, absent_since) once the watermark is ``window_seconds`` past the last row of a key.

    With a ``condition``, only the rows that its service and level ask for count.
    """
    entries = entries if condition is None else entries.where(counted_rows(condition))
    width = window_seconds * 1000

    def watch(key_value: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({
                "key": [key_value[0]], "last_seen": [pd.Timestamp(last, unit="ms", tz="UTC")],
                "absent_since": [pd.Timestamp(last + width, unit="ms", tz="UTC")],
            })
            return
        newest = max(int(pdf["timestamp"].max().timestamp() * 1000) for pdf in batches)
        if state.exists:
            newest = max(newest, state.get[0])
        state.update((newest,))
        state.setTimeoutTimestamp(max(newest + width, state.getCurrentWatermarkMs() + 1))

    seen = entries.select(F.col(key).cast("string").alias("key"), "timestamp")
    reduced = seen.mapInPandas(_newest_per_batch, "key string, timestamp timestamp")
    return reduced.withWatermark("timestamp", late).groupBy("key").applyInPandasWithState(
        watch, "key string, last_seen timestamp, absent_since timestamp", "last bigint", "append",
        GroupStateTimeout.EventTimeTimeout,
    )


def alert_writer(rules: DataFrame, traps: DataFrame, channels: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: hits to throttled alerts and their outbox.

    The state is a table with the last alert of every rule. A batch starts from
    the newest state, whatever stream has written it, so a stream that is begun
    anew fires nothing twice; a batch that runs again starts from the state
    before its own and writes the same. Two states are kept. Alerts go to
    ``folder/alerts`` and messages to ``folder/outbox``, by stream and batch;
    states go to ``folder/last``.
    """

    def write(hits: DataFrame, batch: int) -> None:
        spark = hits.sparkSession
        stream = spark.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"
        empty = spark.createDataFrame([], "rule_id string, created_at timestamp")
        states = _states(spark, f"{folder}/last")
        mine = [n for n, name in states if name.endswith(f".{stream}.{batch}")]
        number = mine[-1] if mine else (states[-1][0] + 1 if states else 0)
        earlier = [name for n, name in states if n < number]
        before = spark.read.schema(empty.schema).parquet(f"{folder}/last/{earlier[-1]}") if earlier else empty
        part = f"stream={stream}/batch={batch}"
        alerts = to_history(throttle(fan_out(hits, rules), before))
        alerts.write.mode("overwrite").parquet(f"{folder}/alerts/{part}")
        stored = spark.read.schema(alerts.schema).parquet(f"{folder}/alerts/{part}")
        outbox(stored, channels, traps).write.mode("overwrite").parquet(f"{folder}/outbox/{part}")
        newest = before.unionByName(stored.select("rule_id", "created_at")).groupBy("rule_id").agg(F.max("created_at").alias("created_at"))
        # The state comes last: without it the batch counts as not run.
        newest.write.mode("overwrite").parquet(f"{folder}/last/{number:012d}.{stream}.{batch}")
        for _, name in _states(spark, f"{folder}/last")[:-2]:
            remove(spark, f"{folder}/last/{name}")

    return write


def _states(spark: SparkSession, folder: str) -> list[tuple[int, str]]:
    """(number, name) of the finished states, oldest first."""
    found = [name for name in children(spark, folder) if children(spark, f"{folder}/{name}").count("_SUCCESS")]
    return sorted((int(name.split(".")[0]), name) for name in found)
