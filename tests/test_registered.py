"""Every registered query against its SQL in an independent engine."""

import pytest
from compare import connect, oracle_rows, spark_rows

import __spark_entry__ as driver
from tradewind.registry.queries import REGISTERED as QUERIES

SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in QUERIES}


@pytest.fixture(scope="module")
def connection(folder):
    with connect(folder) as open_connection:
        yield open_connection


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, folder, connection):
    columns, rows = spark_rows(QUERIES[name](spark, folder))
    wanted_columns, wanted_rows = oracle_rows(connection, SQL[name])
    assert columns == wanted_columns
    assert rows == wanted_rows


def test_entry_has_rows(spark):
    assert driver.entry(spark).count() > 0
