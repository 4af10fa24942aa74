"""Every registered query against its SQL check on the whole small tables."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import connect, duck_rows, spark_rows

FOLDER = "/root/testdata/sf0.001"
QUERIES, CHECKS = entry_points.queries(), entry_points.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, FOLDER))
    if name not in CHECKS:
        assert rows
        return
    assert (columns, rows) == duck_rows(con, CHECKS[name])


def test_checks_belong_to_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
