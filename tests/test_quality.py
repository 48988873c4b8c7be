"""Checks on frames with known failures."""

from tradewind.operators import quality


def test_report(spark):
    parent = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k int")
    child = spark.createDataFrame([(1,), (3,), (3,), (4,), (None,)], "k int")
    tables = {"p": parent, "c": child}
    checks = [
        *quality.keys("p", "k"), *quality.required("c", "k"), quality.refers("c", "k", "p"),
    ]
    extra = {"own": parent.where("k > 1"), "fine": parent.where("k > 9")}
    rows = {r.check_name: (r.failures, r.status) for r in
            quality.run_checks(tables, checks, extra).collect()}
    assert rows == {
        "not_null_p_k": (1, "fail"),
        "unique_p_k": (1, "fail"),
        "not_null_c_k": (1, "fail"),
        "relationship_c_k_to_p": (3, "fail"),
        "own": (2, "fail"),
        "fine": (0, "pass"),
    }


def test_parity_of_empty_tables(spark):
    some, none = spark.range(3), spark.range(0)
    assert quality.row_parity({"a": (none, none), "b": (some, some)}).count() == 0
    row = quality.row_parity({"a": (some, none)}).collect()[0]
    assert (row.table_name, row.raw_count, row.stg_count) == ("a", 3, 0)


def test_recency(spark):
    old = spark.sql("SELECT TIMESTAMP_NTZ'2018-07-31 23:59:59' AS t")
    new = spark.sql("SELECT TIMESTAMP_NTZ'2018-08-01 00:00:00' AS t")
    assert quality.recency(old, "t", "2018-08-01").count() == 1
    assert quality.recency(new, "t", "2018-08-01").count() == 0
