"""What the plans must look like to hold at a thousand times the data."""

import ast
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tradewind.operators import analytics, joins, numbering, ranking
from tradewind.plans import kpis, marts
from tradewind.plans.warehouse import Warehouse
from tradewind.registry.queries import REGISTERED

PACKAGE = Path(__file__).resolve().parent.parent / "tradewind"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the facts share one key, a tenth have none."""
    facts = spark.range(30_000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, 7)
        .when(F.col("id") % 10 == 1, None)
        .otherwise(F.col("id") % 1000)
        .cast("int")
        .alias("k"),
    )
    dim = spark.range(2000).select(F.col("id").cast("int").alias("k"), (F.col("id") * 2).alias("v"))
    return facts, dim.where("k <> 8").unionByName(dim.where("k = 9"))


def test_lookup_reads_and_shuffles_the_facts_once(hot, spark):
    """Hot key and rows without a key are spread over tasks by the adaptive plan."""
    facts, dim = hot
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.shuffle.partitions": "16",
    }
    old = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        joined = joins.lookup(facts.repartition(8), dim, "k")
        joined.collect()
        text = plan(joined)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    final = text.split("== Initial Plan ==")[0]
    assert "skew=true" in final
    assert final.count("hashpartitioning(k") == 2
    assert "skewed" in final
    assert joined.count() == 30_000 + facts.where("k = 9").count()


def test_unused_details_are_not_joined(spark, folder):
    """Monthly KPIs need the payments, not the order lines."""
    text = plan(Warehouse(spark, folder).kpi_monthly)
    assert "l_orderkey" not in text and "lineitem" not in text
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text


def test_range_reaches_the_scan(spark, folder):
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    w = Warehouse(spark, folder)
    text = plan(kpis.orders_of_months(w.orders, "1997-01-15", "1997-06-30"))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(o_orderdate,1997-02-01T00:00" in text
    assert "LessThan(o_orderdate,1997-07-01T00:00" in text


def test_top_n_is_taken_per_task(spark, folder):
    assert "TakeOrderedAndProject" in plan(kpis.recent_orders(Warehouse(spark, folder).order_totals))


def test_groups_are_cut_before_the_shuffle(spark, folder):
    turns = Warehouse(spark, folder).table("conversations")
    text = plan(ranking.first_per_group(turns, ["conv_id"], [F.desc("turn")], 6))
    assert text.index("WindowGroupLimit") < text.index("Exchange") < text.rindex("WindowGroupLimit")


def test_distinct_counts_do_not_expand(spark, folder):
    w = Warehouse(spark, folder)
    assert "Expand" not in plan(marts.sales_by_category(w.fct_order_items))
    assert "Expand" not in plan(REGISTERED["kpi_measures"](spark, folder))


def test_drill_down_reads_its_input_once(spark, folder):
    assert plan(REGISTERED["drill_down_counts"](spark, folder)).count("FileScan") == 1


def test_correlation_multiplies_no_rows(spark, folder):
    text = plan(REGISTERED["correlations"](spark, folder))
    assert text.count("FileScan") == 1
    assert text.index("Generate") < text.index("Aggregate")


def test_check_report_shares_its_passes(spark, folder):
    """One NULL scan per table, one per (table, key) of the four keys, and one for recency. The
    places of customers and sellers take two more scans each time."""
    text = plan(REGISTERED["dq_report"](spark, folder))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert sum("l_orderkey" in s or "l_partkey" in s or "l_suppkey" in s for s in scans) == 4
    assert len(scans) == 24 and "LeftAnti" not in text


def test_default_embedding_stays_in_the_jvm(spark, folder):
    text = plan(REGISTERED["embed_documents"](spark, folder))
    assert "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", list(REGISTERED))
def test_no_query_multiplies_tables(name, spark, folder):
    text = plan(REGISTERED[name](spark, folder))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    python = [line for line in text.splitlines() if "EvalPython" in line or "MapInArrow" in line]
    if name not in {"vector_topk", "vector_topk_filtered", "vector_topk_bulk", "context_pack"}:
        assert python == []


def test_rows_reach_the_driver_in_few_places():
    calls = {}
    for path in PACKAGE.rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            if isinstance(node, ast.Call) and isinstance(node.func, ast.Attribute):
                if node.func.attr in {"collect", "toPandas", "localCheckpoint", "crossJoin"}:
                    calls.setdefault(path.name, []).append(node.func.attr)
    assert calls == {
        "ranking.py": ["collect"],  # the bounded result
        "build_all.py": ["collect"],  # names of failed checks
    }


def test_charts_number_rows_where_they_are(spark):
    """No window over all rows, and numbers without gaps over many ranges."""
    df = spark.range(5000).selectExpr("id % 700 AS v", "concat('n', id % 7) AS name").repartition(9)
    for made in (analytics.series(df, order_by=["v"]), analytics.series(df, "top"), analytics.figure(df)):
        first_of_spec = re.findall(r"windowspecdefinition\((\w+)#\d+L?, ", plan(made))
        assert first_of_spec and set(first_of_spec) <= {"_range", "_group"}
    rows = numbering.row_numbers(df, ["v"]).collect()
    assert sorted(r.idx for r in rows) == list(range(1, 5001))
    assert [r.v for r in sorted(rows, key=lambda r: r.idx)] == sorted(r.v for r in rows)
    backwards = numbering.row_numbers(df, [F.desc("v")]).collect()
    assert [r.v for r in sorted(backwards, key=lambda r: r.idx)] == sorted((r.v for r in rows), reverse=True)
    assert numbering.row_numbers(df.limit(0), ["v"]).count() == 0


def test_numbering_adds_up_many_groups_of_ranges(spark, monkeypatch):
    monkeypatch.setattr(numbering, "RANGES", 2)
    rows = numbering.row_numbers(spark.range(900).repartition(11), ["id"]).collect()
    assert all(r.idx == r.id + 1 for r in rows) and len(rows) == 900
