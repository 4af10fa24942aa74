"""Names in a folder, and removing one, wherever Spark keeps it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def children(spark: SparkSession, folder: str) -> list[str]:
    """Sorted names directly below ``folder``; none where it does not exist."""
    system, path = _open(spark, folder)
    return sorted(entry.getPath().getName() for entry in system.listStatus(path)) if system.exists(path) else []


def remove(spark: SparkSession, folder: str) -> None:
    system, path = _open(spark, folder)
    system.delete(path, True)
