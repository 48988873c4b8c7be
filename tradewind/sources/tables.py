"""Table layers: raw, staging, marts, serving, uploads."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

LAYERS = ["raw", "staging", "marts", "serving"]
UPLOADS = "uploads"
READABLE = {"marts", "serving"}

# Public name of each serving view and the mart behind it.
SERVING = {
    "kpi_overview": "kpi_overview",
    "kpi_monthly_sales": "kpi_monthly_sales",
    "fct_sales_by_category": "fct_sales_by_category",
    "delivery_performance_monthly": "delivery_performance_monthly",
}

REQUIRED_SERVING = [
    "serving.kpi_overview",
    "serving.kpi_monthly_sales",
    "serving.fct_sales_by_category",
]

# Nodes of an explained plan that read something, but for rows in the text itself, and a table there.
_SOURCE = re.compile(r"(?!LocalRelation|OneRowRelation)(\w*Relation|LogicalRDD|InMemory\w*|\w*Scan\w*)\b")
_TABLE = re.compile(r"Relation spark_catalog\.(?P<layer>\w+)\.\w+\[")


class IncompleteLayerError(RuntimeError):
    """Required objects are missing."""


def ensure_namespaces(spark: SparkSession, names: list[str] | None = None) -> None:
    for name in names or [*LAYERS, UPLOADS]:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {name}")


def write_version(df: DataFrame, name: str, partition_by: list[str] | None = None) -> str:
    """Write the new content of ``name`` as a parquet table of its own and return that table's
    name. What ``name`` shows does not change.

    For a partitioned table rows of one partition are brought together first, and AQE splits
    the large partitions again, so that files have a useful size either way."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    writer = df.write.format("parquet")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    version = f"{name}__{uuid.uuid4().hex}"
    writer.saveAsTable(version)
    return version


def switch(spark: SparkSession, name: str, version: str) -> DataFrame:
    """Let ``name``, a view, show a complete version. The version it showed before stays for
    readers that have it open; older ones are dropped. A version that is just being written
    by another run is not among them: only versions that ``name`` has shown are."""
    shown = _shown(spark, name)
    if not shown and spark.catalog.tableExists(name):
        if spark.catalog.getTable(name).tableType != "VIEW":
            spark.sql(f"DROP TABLE {name}")
    kept = [version, *[v for v in shown if v != version]][:2]
    marks = ",".join(v.rpartition(".")[2] for v in kept)
    spark.sql(
        f"CREATE OR REPLACE VIEW {name} TBLPROPERTIES ('versions' = '{marks}') "
        f"AS SELECT * FROM {version}"
    )
    for old in shown:
        if old not in kept:
            spark.sql(f"DROP TABLE IF EXISTS {old}")
    return spark.table(name)


def _shown(spark: SparkSession, name: str) -> list[str]:
    """The versions that the view ``name`` shows now and showed before; none if it is no such
    view."""
    if not spark.catalog.tableExists(name):
        return []
    rows = spark.sql(f"SHOW TBLPROPERTIES {name}").where("key = 'versions'").take(1)
    layer = name.rpartition(".")[0]
    found = rows[0]["value"].split(",") if rows else []
    return [f"{layer}.{v}" if layer else v for v in found]


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Replace the content of ``name`` and return it. The written table cuts the lineage. The new
    content is written beside the old and then shown in its place, so readers and a run that
    breaks off never see half of it."""
    return switch(df.sparkSession, name, write_version(df, name, partition_by))


def register_view(df: DataFrame, name: str) -> DataFrame:
    """Lazy session view; layers are part of the name with an underscore."""
    df.createOrReplaceTempView(name.replace(".", "_"))
    return df


def publish_serving(spark: SparkSession) -> None:
    """Catalog views that pass the KPI marts through under their public names."""
    for public, mart in SERVING.items():
        spark.sql(f"CREATE OR REPLACE VIEW serving.{public} AS SELECT * FROM marts.{mart}")


def require_objects(spark: SparkSession, names: list[str] | None = None) -> None:
    wanted = REQUIRED_SERVING if names is None else names
    missing = [name for name in wanted if not spark.catalog.tableExists(name)]
    if missing:
        raise IncompleteLayerError(f"layer is incomplete, missing: {', '.join(missing)}")


def read_curated(spark: SparkSession, name: str) -> DataFrame:
    """A table of the curated layers; its name must carry the layer."""
    layer, _, table = name.partition(".")
    if not table:
        raise PermissionError(f"name the layer: {name}")
    if layer.lower() not in READABLE:
        raise PermissionError(f"layer {layer} is not readable, only {sorted(READABLE)}")
    return spark.table(name)


def run_query(spark: SparkSession, text: str, **args) -> DataFrame:
    """Query text with bound parameters, never spliced into the text."""
    return spark.sql(text, args=args)


def query_curated(spark: SparkSession, text: str, **args) -> DataFrame:
    """One query over the curated layers, with bound parameters.

    The text stands in a subquery, where no command can, and is explained before it runs: every
    table that its analysed plan reads, through views, named sub-queries or subqueries as well, must
    lie in a curated layer. Files by path, and session views over files or frames, are refused."""
    query = f"SELECT * FROM (\n{text}\n)"
    told = spark.sql(f"EXPLAIN EXTENDED {query}", args=args).first()[0]
    analysed = told.partition("== Analyzed Logical Plan ==")[2].partition("== Optimized Logical Plan ==")[0]
    for line in analysed.splitlines():
        node = line.lstrip(" :+-")
        if not _SOURCE.match(node):
            continue
        table = _TABLE.match(node)
        if not table or table["layer"].lower() not in READABLE:
            raise PermissionError(f"only {sorted(READABLE)} are readable, not {node[:80]}")
    found = spark.sql(query, args=args)
    if not analysed:
        raise PermissionError("the query could not be explained")
    return found
