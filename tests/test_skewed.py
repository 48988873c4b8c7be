"""The registered queries against their SQL on uneven data: a third of the rows on one key,
a third of the vectors and documents copies of one, and keys that are missing."""

import duckdb
import pytest
from compare import TABLES, connect, oracle_rows, spark_rows

import __spark_entry__ as driver
from tradewind.registry.queries import REGISTERED

CHANGES = {
    "orders": """
        SELECT * REPLACE (
            CASE WHEN o_orderkey % 3 = 0 THEN 7 WHEN o_orderkey % 11 = 0 THEN NULL
                ELSE o_custkey END AS o_custkey,
            CASE WHEN o_orderkey % 3 = 1 THEN TIMESTAMP '1997-03-05' ELSE o_orderdate END
                AS o_orderdate)
        FROM t""",
    "lineitem": """
        SELECT * REPLACE (
            CASE WHEN l_suppkey % 3 = 0 THEN 5 WHEN l_suppkey % 7 = 0 THEN NULL
                ELSE l_partkey END AS l_partkey,
            CASE WHEN l_linenumber < 3 THEN 12 ELSE l_orderkey END AS l_orderkey)
        FROM t""",
    "conversations": """
        SELECT CASE WHEN conv_id % 3 = 0 THEN 0 ELSE conv_id END AS conv_id,
            row_number() OVER (ORDER BY conv_id, turn) AS turn, role, text FROM t""",
    "events": """
        SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 1 ELSE user_id END AS user_id)
        FROM t""",
    "documents": """
        SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN (SELECT min(text) FROM t) ELSE text END
            AS text) FROM t""",
    "embeddings": """
        SELECT * REPLACE (CASE WHEN vec_id % 3 = 0
            THEN (SELECT embedding FROM t WHERE vec_id = 1) ELSE embedding END AS embedding)
        FROM t""",
}


@pytest.fixture(scope="module")
def uneven(folder, tmp_path_factory):
    target = tmp_path_factory.mktemp("uneven")
    for table in TABLES:
        select = CHANGES.get(table, "SELECT * FROM t")
        with duckdb.connect() as connection:
            connection.execute(
                f"CREATE VIEW t AS SELECT * FROM read_parquet('{folder}/{table}.parquet')"
            )
            connection.execute(f"COPY ({select}) TO '{target}/{table}.parquet' (FORMAT parquet)")
    return str(target)


@pytest.fixture(scope="module")
def connection(uneven):
    with connect(uneven) as open_connection:
        yield open_connection


@pytest.mark.parametrize("name", list(REGISTERED))
def test_query_matches_sql(name, spark, uneven, connection):
    columns, rows = spark_rows(driver.queries()[name](spark, uneven))
    wanted_columns, wanted_rows = oracle_rows(connection, driver.oracle_sql()[name])
    assert columns == wanted_columns
    assert rows == wanted_rows


def test_large_dimensions_give_the_same(spark, uneven, connection):
    """The same facts when customers and products are too large to be broadcast."""
    names = ["fct_orders", "fct_order_items", "kpi_measures"]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = {name: spark_rows(driver.queries()[name](spark, uneven)) for name in names}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == {name: oracle_rows(connection, driver.oracle_sql()[name]) for name in names}
