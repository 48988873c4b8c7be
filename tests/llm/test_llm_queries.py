"""Every registered query of the subpackage against its SQL, and on empty tables."""

import duckdb
import pytest
from compare import connect, oracle_rows, spark_rows

from tradewind.llm.queries import ORACLES, QUERIES

TABLES = ["documents", "benchmark", "pages", "labels", "conversations"]


@pytest.fixture(scope="module")
def given(folder):
    with connect(folder) as connection:
        yield connection


@pytest.fixture(scope="module")
def mixed(messy):
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{messy}/{table}.parquet')")
        yield connection


def test_one_query_for_each_operator():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(name, spark, folder, given):
    assert spark_rows(QUERIES[name](spark, folder)) == oracle_rows(given, ORACLES[name])


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql_on_messy_tables(name, spark, messy, mixed):
    assert spark_rows(QUERIES[name](spark, messy)) == oracle_rows(mixed, ORACLES[name])


@pytest.mark.parametrize("name", list(QUERIES))
def test_empty_tables_give_no_rows(name, spark, empty):
    assert QUERIES[name](spark, empty).count() == 0
