"""Run a registered query on Spark and its check on DuckDB, and compare all rows."""

from __future__ import annotations

import datetime as dt
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _cell(value):
    """The value with its kind, so that 3 and 3.0 and Decimal(3) differ."""
    if isinstance(value, float):
        return "float", "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, dt.datetime):
        return "time", value.isoformat()
    return type(value).__name__, str(value)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    cursor = con.execute(sql)
    columns = [column[0] for column in cursor.description]
    return sorted(columns), rows_of(columns, cursor.fetchall())
