"""The log topic. Needs Spark's Kafka package on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DEFAULT_TOPIC = "logs"


def read_log_topic(spark: SparkSession, servers: str, topic: str = DEFAULT_TOPIC, starting: str = "latest", **options: str) -> DataFrame:
    """Records as a stream of (value, key, headers); ``starting`` is earliest or latest."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("includeHeaders", "true")
    )
    return reader.options(**options).load().select("value", "key", "headers", "topic", "partition", "offset")
