"""The stream jobs over a file source, against the batch results."""

import datetime as dt

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from signalbed.operators import alerts, ingest, traps
from signalbed.plans import parsing
from signalbed.sources import tables as t
from signalbed.streaming import jobs, replay

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def stream(spark, tmp_path):
    """Writes rows in time order to several files and reads them as a stream, one file per batch."""

    def make(rows, order, parts=4):
        folder = f"{tmp_path}/in-{order}"
        staged = rows.withColumn("_part", F.ntile(parts).over(Window.orderBy(order)))
        for n in range(1, parts + 1):
            staged.where(F.col("_part") == n).drop("_part").coalesce(1).write.mode("append").parquet(folder)
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)

    return make


def run(df, tmp_path, mode="append", name="out"):
    writer = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/cp-{name}")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return df.sparkSession.table(name)


def test_ingest_stream(spark, tmp_path, stream):
    records = parsing._topic(spark, FOLDER)
    got = run(jobs.ingest(stream(records, "id")), tmp_path, name="ingested")
    want, _ = ingest.ingest_logs(ingest.parse_topic_lines(ingest.topic_records(records)), "2024-02-01")
    assert sorted(r.message for r in got.collect()) == sorted(r.message for r in want.collect())


def test_pattern_stream_and_statistics(spark, tmp_path, stream):
    rows = t.log_entries(spark, FOLDER)
    hits = jobs.pattern_stream(stream(rows, "id"), t.trap_rules())
    got = run(jobs.trap_statistics_stream(hits), tmp_path, "complete", "stats")
    want = traps.trap_statistics(traps.pattern_hits(rows, t.trap_rules()))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_rollup_stream_closed_windows(spark, tmp_path, stream):
    rows = t.metric_series(spark, FOLDER)
    got = run(jobs.metric_rollup(stream(rows, "timestamp"), 3600, "1 hour"), tmp_path, name="rollup")
    closed = {tuple(r) for r in got.collect()}
    want = {tuple(r) for r in jobs.metric_rollup(rows, 3600).collect()}
    assert len(closed) > 0.9 * len(want) and closed <= want


def test_frequency_windows(spark, tmp_path, stream):
    rows = t.log_entries(spark, FOLDER)
    condition = {"window_seconds": 86400, "threshold": 12}
    got = {tuple(r) for r in run(jobs.frequency_windows(stream(rows, "timestamp"), condition), tmp_path, name="windows").collect()}
    want = {tuple(r) for r in jobs.frequency_windows(rows, condition).collect()}
    # Closed are the windows that end before the watermark, ten minutes before the newest counted row.
    watermark = rows.agg(F.max("timestamp")).first()[0] - dt.timedelta(minutes=10)
    assert got == {w for w in want if w[2] <= watermark} and got


def test_sessions(spark, tmp_path, stream):
    rows = t.trace_spans(spark, FOLDER)
    got = run(jobs.trace_sessions(stream(rows, "start_time"), "6 hours"), tmp_path, name="sessions").collect()
    want = {(r.correlation_id, r.span_count) for r in rows.groupBy("correlation_id").agg(F.count(F.lit(1)).alias("span_count")).collect()}
    watermark = rows.agg(F.max("start_time")).first()[0] - dt.timedelta(minutes=10)
    ends = {r.correlation_id: r.end for r in rows.groupBy("correlation_id").agg(F.max("start_time").alias("end")).collect()}
    closed = {w for w in want if ends[w[0]] + dt.timedelta(hours=6) <= watermark}
    whole = {(c, n) for c, n in closed if sum(1 for r in got if r.correlation_id == c) == 1}
    sizes = {(r.correlation_id, r.span_count) for r in got}
    assert whole <= sizes and len(whole) > 100
    totals = {c: sum(r.span_count for r in got if r.correlation_id == c) for c, _ in closed}
    assert all(totals[c] == n for c, n in closed)


def test_absence_stream(spark, tmp_path, stream):
    rows = t.log_entries(spark, FOLDER).where("NOT (service_name = 'svc-2' AND timestamp > '2024-01-10')").select("service_name", "timestamp")
    got = run(jobs.absence_stream(stream(rows, "timestamp", 8), "service_name", 5 * 86400), tmp_path, name="absent").collect()
    last = rows.where("service_name = 'svc-2'").agg(F.max("timestamp")).first()[0]
    assert [r.key for r in got] == ["svc-2"]
    assert abs((got[0].last_seen - last).total_seconds()) < 0.001


def test_alert_writer_equals_batch(spark, tmp_path, stream):
    rows = t.log_entries(spark, FOLDER)
    rules = t.alert_rules(spark)
    names = spark.createDataFrame([(x["trap_id"], x["name"]) for x in t.trap_rules()], "trap_id string, name string")
    out = f"{tmp_path}/alerts"
    write = jobs.alert_writer(rules, names, t.alert_channels(spark), out)
    hits = jobs.pattern_stream(stream(rows, "timestamp", 3), t.trap_rules())
    query = hits.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    stored = spark.read.option("basePath", f"{out}/alerts").parquet(f"{out}/alerts")
    want = alerts.to_history(alerts.throttle(alerts.fan_out(traps.pattern_hits(rows, t.trap_rules()), rules)))
    assert sorted(r.id for r in stored.collect()) == sorted(r.id for r in want.collect())
    assert spark.read.parquet(f"{out}/outbox").select("alert_id").distinct().count() == stored.count()


@pytest.fixture
def shuffled(spark, tmp_path):
    """Rows in a disorder of up to six hours, in several files, one per batch; they are never later than the watermark of a day."""

    def make(rows, order, parts=6):
        folder = f"{tmp_path}/shuffled-{order}"
        moved = rows.withColumn("_arrival", F.unix_micros(order) + F.pmod(F.xxhash64(F.col("id")), F.lit(6 * 3_600_000_000)))
        staged = moved.withColumn("_part", F.ntile(parts).over(Window.orderBy("_arrival"))).drop("_arrival")
        for n in range(1, parts + 1):
            staged.where(F.col("_part") == n).drop("_part").repartition(3).write.mode("overwrite").parquet(f"{folder}/n={n}")
        files = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).option("latestFirst", "false")
        return files.parquet(f"{folder}/n=*")

    return make


def _closed(rows, time, newest):
    """Rows the watermark has passed, a day and a millisecond before the newest."""
    return [r for r in rows if (r[time] - newest).total_seconds() < -86_400.001]


FREQUENT = [
    {"trap_id": "busy", "team_id": 1, "trap_type": "FREQUENCY", "is_active": True, "conditions": [
        {"condition_type": "FREQUENCY_THRESHOLD", "threshold": 14, "window_seconds": 86400},
        {"condition_type": "FREQUENCY_THRESHOLD", "threshold": 2, "window_seconds": 43200, "service_name": "svc-1", "log_level": "INFO"}]},
    {"trap_id": "one", "team_id": 2, "trap_type": "FREQUENCY", "is_active": True, "conditions": [
        {"condition_type": "FREQUENCY_THRESHOLD", "threshold": 1, "window_seconds": 7200, "service_name": "svc-2", "log_level": "ERROR"}]},
    {"trap_id": "any", "team_id": 0, "trap_type": "FREQUENCY", "is_active": True, "conditions": []},
    {"trap_id": "never", "team_id": 0, "trap_type": "FREQUENCY", "is_active": True, "conditions": [
        {"condition_type": "FREQUENCY_THRESHOLD", "threshold": None, "window_seconds": 7200}]},
    {"trap_id": "off", "team_id": 0, "trap_type": "FREQUENCY", "is_active": False, "conditions": [
        {"condition_type": "FREQUENCY_THRESHOLD", "threshold": 1, "window_seconds": 7200}]},
]


def test_frequency_stream_equals_batch(spark, tmp_path, shuffled):
    rows = t.log_entries(spark, FOLDER)
    newest = rows.agg(F.max("timestamp")).first()[0]
    got = run(replay.frequency_stream(shuffled(rows, "timestamp"), FREQUENT, "1 day"), tmp_path, name="frequent").collect()
    want = traps.frequency_hits(rows, FREQUENT).select("id", "trap_id", "timestamp").collect()
    always = [tuple(r) for r in want if r.trap_id == "any"]
    want = sorted([tuple(r) for r in _closed([r for r in want if r.trap_id != "any"], "timestamp", newest)] + always)
    assert {"busy", "one", "any"} == {trap for _, trap, _ in want}
    assert sorted(map(tuple, got)) == want


def test_throttle_stream_equals_batch(spark, tmp_path, shuffled):
    rows = t.log_entries(spark, FOLDER)
    rules = t.alert_rules(spark)
    fires = alerts.fan_out(traps.pattern_hits(rows, t.trap_rules()), rules)
    newest = fires.where("throttle_minutes > 0").agg(F.max("fired_at")).first()[0]
    hits = jobs.pattern_stream(shuffled(rows, "timestamp"), t.trap_rules())
    got = run(replay.throttle_stream(alerts.fan_out(hits, rules), "1 day"), tmp_path, name="throttled").collect()
    kept = alerts.throttle(fires).collect()
    want = [r for r in kept if r.throttle_minutes <= 0] + _closed([r for r in kept if r.throttle_minutes > 0], "fired_at", newest)
    columns = fires.columns
    assert len(want) < fires.count()
    assert sorted(tuple(r[c] for c in columns) for r in got) == sorted(tuple(r[c] for c in columns) for r in want)


def test_absence_stream_equals_gaps(spark, tmp_path, shuffled):
    rows = t.log_entries(spark, FOLDER).where("NOT (service_name = 'svc-2' AND timestamp > '2024-01-10')")
    rules = [{"trap_id": f"gap-{n}", "team_id": team, "trap_type": "ABSENCE", "is_active": True, "conditions": [
        {"condition_type": "ABSENCE", "window_seconds": width, "service_name": service, "log_level": level}]}
        for n, (team, width, service, level) in enumerate(
            [(0, 7200, None, None), (1, 86400, "svc-1", "INFO"), (2, 3 * 86400, "svc-2", "DEBUG"), (1, 3600, "nobody", "INFO"), (7, 60, None, None)])]
    start = "2023-12-31 12:00:00"
    newest = rows.agg(F.max("timestamp")).first()[0]
    got = run(replay.absence_rule_stream(shuffled(rows, "timestamp"), rules, start, "1 day"), tmp_path, name="gaps").collect()
    gaps = traps.absence_gaps(rows, rules, start, "2025-01-01").collect()
    told = [(r.trap_id, r.absent_from, None) for r in _closed(gaps, "absent_from", newest)]
    ended = [(r.trap_id, r.absent_from, r.absent_until) for r in _closed([r for r in gaps if r.absent_until], "absent_until", newest)]
    assert {"gap-3", "gap-4"} <= {trap for trap, _, _ in told}
    assert sorted(((r.trap_id, r.absent_from, r.absent_until) for r in got), key=str) == sorted(told + ended, key=str)


def test_alert_writer_begun_anew_fires_nothing_twice(spark, tmp_path):
    """The same entries through a second stream with its own checkpoint: every rule with a throttle time stays silent inside it."""
    rows = t.log_entries(spark, FOLDER)
    rules = t.alert_rules(spark).where("throttle_minutes > 0")
    names = spark.createDataFrame([(x["trap_id"], x["name"]) for x in t.trap_rules()], "trap_id string, name string")
    out = f"{tmp_path}/alerts"
    write = jobs.alert_writer(rules, names, t.alert_channels(spark), out)
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    for n in range(2):
        hits = jobs.pattern_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), t.trap_rules())
        query = hits.writeStream.foreachBatch(write).option("checkpointLocation", f"{tmp_path}/cp-{n}").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    stored = spark.read.option("basePath", f"{out}/alerts").parquet(f"{out}/alerts")
    want = alerts.throttle(alerts.fan_out(traps.pattern_hits(rows, t.trap_rules()), rules))
    assert stored.count() == want.count() > 0
    states = spark.read.option("basePath", f"{out}/last").parquet(f"{out}/last/*").select(F.input_file_name().alias("f")).distinct().collect()
    assert 0 < len({r.f.split("/")[-2] for r in states}) <= 2
    # A batch that runs again starts from the state before its own and writes the same.
    again = traps.pattern_hits(rows, t.trap_rules())
    jobs.alert_writer(rules, names, t.alert_channels(spark), f"{tmp_path}/twice")(again, 0)
    first = spark.read.parquet(f"{tmp_path}/twice/alerts").count()
    jobs.alert_writer(rules, names, t.alert_channels(spark), f"{tmp_path}/twice")(again, 0)
    assert spark.read.parquet(f"{tmp_path}/twice/alerts").count() == first == want.count()


def _busy(spark, n, seconds):
    """``n`` entries of one team, all at different times of so many seconds."""
    start = int(dt.datetime(2024, 1, 5, tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    return spark.range(n).select(
        "id", F.lit(0).cast("long").alias("team_id"), F.lit("svc-1").alias("service_name"), F.lit("ERROR").alias("level"),
        F.timestamp_micros(F.lit(start) + F.col("id") * (seconds * 1_000_000 // n)).alias("timestamp"),
        F.concat(F.lit("connection to the store was lost, timeout after try "), F.col("id")).alias("message"))


def test_absence_rules_are_not_sent_all_entries(spark, monkeypatch):
    sent, whole = [], replay.replay
    monkeypatch.setattr(replay, "replay", lambda rows, *more: sent.append(rows) or whole(rows, *more))
    rules = [{"trap_id": "quiet", "team_id": 0, "trap_type": "ABSENCE", "is_active": True, "conditions": [{"condition_type": "ABSENCE", "window_seconds": 600}]}]
    replay.absence_rule_stream(_busy(spark, 20_000, 7200), rules, "2024-01-01")
    # The first and the last of each of 12 cells; wakes are one a task.
    points = [r.timestamp for r in sent[0].where("item = 'seen'").collect()]
    edges = _busy(spark, 20_000, 7200).groupBy(F.expr("unix_micros(timestamp) div 600000000")).agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).collect()
    assert sorted(points) == sorted(t for r in edges for t in (r.a, r.b)) and len(points) == 24


def test_waiting_fires_are_packed(spark, tmp_path):
    fires = _busy(spark, 20_000, 7200).select(
        F.lit("mail").alias("rule_id"), F.col("id").alias("entry_id"), F.col("timestamp").alias("fired_at"), "message", F.lit(10).alias("throttle_minutes"))
    fires.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = replay.throttle_stream(spark.readStream.schema(fires.schema).parquet(f"{tmp_path}/in"))
    query = stream.writeStream.format("memory").queryName("packed").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    held = max(s["memoryUsedBytes"] for p in query.recentProgress for s in p["stateOperators"])
    texts = fires.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    assert held < texts / 4
    newest = fires.agg(F.max("fired_at")).first()[0]
    kept = [r for r in fires.collect() if r.entry_id % (20_000 // 12 + 1) == 0]  # the first at least ten minutes after the one before
    want = [tuple(r) for r in kept if (newest - r.fired_at).total_seconds() > 600.001]
    assert sorted(map(tuple, spark.table("packed").collect())) == want and len(want) > 8
