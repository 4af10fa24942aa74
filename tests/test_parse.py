import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from signalbed.functions.times import parse_time
from signalbed.operators.ingest import parse_topic_lines, topic_records
from signalbed.operators.parse import parse_raw_logs


def parsed(spark, raw, default=None):
    df = spark.createDataFrame([(raw, default)], "raw string, service string")
    return parse_raw_logs(df, "raw", F.col("service")).first().asDict()


def fields(row, *names):
    return tuple(row[name] for name in names)


def test_json_with_exception_and_extras(spark):
    row = parsed(spark, json.dumps({
        "level": "ERROR", "message": "boom", "exception": "shop.StockError: none left", "logger": "a.B", "port": 80, "note": None,
        "nested": {"a": 1},
    }))
    assert fields(row, "log_format", "level", "message", "exception_class", "exception_message", "logger_name") == (
        "json", "ERROR", "boom", "shop.StockError", "none left", "a.B")
    assert json.loads(row["custom_fields"]) == {"port": "80", "note": "null", "nested": '{"a":1}'}
    assert row["service_name"] == "unknown"


def test_json_exact_key_before_other_case(spark):
    row = parsed(spark, '{"LEVEL":"INFO","level":"WARN","MSG":"m","Host":"h1","hostname":"h2"}')
    assert fields(row, "level", "message", "host_name") == ("WARN", "m", "h2")
    assert parsed(spark, '{"Host":"h1","HostName":"h2","msg":"m"}')["host_name"] == "h1"


def test_json_exception_without_class(spark):
    row = parsed(spark, '{"message":"m","error":"just text"}')
    assert fields(row, "level", "exception_class", "exception_message") == ("INFO", None, "just text")


def test_json_without_level_and_message_is_not_json(spark):
    assert parsed(spark, '{"a":1}')["log_format"] == "plain"
    assert parsed(spark, '{"level":"INFO", broken')["log_format"] == "plain"


def test_key_value(spark):
    row = parsed(spark, 'Level=WARN msg="two words" service=api level=ERROR host=h1 time=1705312245', "dflt")
    assert fields(row, "log_format", "level", "message", "service_name", "host_name") == (
        "key_value", "ERROR", "two words", "api", "h1")
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 9, 50, 45)
    assert parsed(spark, "a=1 a=2 hello")["log_format"] == "plain"
    assert parsed(spark, 'msg=b="c" host="h=1" level=warn')["message"] == 'b="c"'


def test_spring_boot(spark):
    row = parsed(spark, "2024-01-15 10:30:45.123  INFO [billing,t9,s4] 312 --- [ pool-2] o.q.Ledger  : Posted\n14 rows")
    assert fields(row, "log_format", "level", "service_name", "trace_id", "span_id", "thread_name", "logger_name", "message") == (
        "spring_boot", "INFO", "billing", "t9", "s4", "pool-2", "o.q.Ledger", "Posted\n14 rows")
    assert row["timestamp"] == dt.datetime(2024, 1, 15, 10, 30, 45, 123000)
    row = parsed(spark, "2024-01-15T10:30:45.123 ERROR 1 --- [exec-1] a.B : x", "dflt")
    assert fields(row, "service_name", "trace_id", "message") == ("dflt", None, "x")


def test_spring_line_with_pairs_is_key_value(spark):
    assert parsed(spark, "2024-01-15 10:30:45.123 INFO 1 --- [main] a.B : x=1 y=2")["log_format"] == "key_value"


def test_syslog(spark):
    row = parsed(spark, "<14>Mar  3 06:07:08 edge-7 relay[88]: cache warmed in 12 ms")
    assert fields(row, "log_format", "level", "service_name", "host_name", "message", "timestamp") == (
        "syslog", "INFO", "relay", "edge-7", "cache warmed in 12 ms", None)
    assert parsed(spark, "<11>Jan 15 10:30:45 h app: x")["level"] == "ERROR"
    assert parsed(spark, "Jan  5 10:30:45 h app: x")["level"] == "INFO"


@pytest.mark.parametrize("raw,message", [(None, "(empty)"), ("  \t", "(empty)"), (" hello \n", "hello")])
def test_plain(spark, raw, message):
    row = parsed(spark, raw, "svc")
    assert fields(row, "log_format", "level", "message", "service_name") == ("plain", "INFO", message, "svc")


@pytest.mark.parametrize("text,expected", [
    ("1705312245123", dt.datetime(2024, 1, 15, 9, 50, 45, 123000)),
    ("1705312245", dt.datetime(2024, 1, 15, 9, 50, 45)),
    ("2024-01-15T10:30:45Z", dt.datetime(2024, 1, 15, 10, 30, 45)),
    ("2024-01-15T10:30:45.123456+02:00", dt.datetime(2024, 1, 15, 8, 30, 45, 123456)),
    ("2024-01-15 10:30:45.123", dt.datetime(2024, 1, 15, 10, 30, 45, 123000)),
    ("2024-01-15 10:30:45", dt.datetime(2024, 1, 15, 10, 30, 45)),
    ("2024-01-15T10:30:45.123", dt.datetime(2024, 1, 15, 10, 30, 45, 123000)),
    ("2024-01-15", None), ("soon", None), ("", None), ("99999999999999999999", None),
])
def test_time(spark, text, expected):
    assert spark.createDataFrame([(text,)], "t string").select(parse_time(F.col("t"))).first()[0] == expected


TEAM = "11111111-2222-3333-4444-555555555555"


def test_topic_records(spark):
    rows = [
        ('{"level":"error","message":"m","serviceName":"s","ipAddress":"1.2.3.4"}', "k", TEAM),
        ('{"severity":"WARN","msg":"raw json"}', "k", TEAM),
        ("plain words", None, TEAM),
        ('{"level":"INFO","message":"bad time","timestamp":"yesterday"}', " ", TEAM),
        (" ", "k", TEAM), (None, "k", TEAM), ("x", "k", None), ("x", "k", "team-1"),
    ]
    df = spark.createDataFrame(rows, "value string, key string, team string").select(
        "value", "key", F.when(F.col("team").isNotNull(), F.array(F.struct(F.lit("X-Team-Id").alias("key"), F.col("team").cast("binary").alias("value")))).alias("headers"))
    found = {r["message"]: r for r in parse_topic_lines(topic_records(df)).collect()}
    assert set(found) == {"m", "raw json", "plain words", "bad time"}
    assert fields(found["m"], "log_format", "level", "service_name", "ip_address", "team_id") == ("structured", "error", "s", "1.2.3.4", TEAM)
    assert fields(found["raw json"], "log_format", "service_name") == ("json", "k")
    assert fields(found["plain words"], "log_format", "service_name") == ("plain", "unknown")
    assert fields(found["bad time"], "log_format", "service_name") == ("json", "unknown")
