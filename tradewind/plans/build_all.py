"""The ordered build: load, stage, materialize, check, publish, index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.operators import catalog, quality, vectors
from tradewind.plans import marts
from tradewind.plans.staging import MODELS, stage
from tradewind.sources.raw import load_all
from tradewind.sources.specs import SOURCES
from tradewind.sources.tables import (
    ensure_namespaces,
    materialize,
    publish_serving,
    require_objects,
    switch,
    write_version,
)

# A latest order before this day means a stale delivery; tables compared by count.
RECENT_SINCE = "2018-08-01"
PARITY_TABLES = [
    "customers", "orders", "order_items", "order_payments", "products", "sellers",
    "order_reviews",
]
INDEXED_LAYERS = ["marts", "serving"]
BY_MONTH = ["order_month"]


class FailedChecksError(RuntimeError):
    """Some data checks returned rows."""


@dataclass(frozen=True)
class Build:
    run_id: str
    checks: DataFrame


def publish_staging(spark: SparkSession, raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Staging stays lazy: frames for this build, to be read through the raw tables."""
    staged = {name: stage(name, raw.__getitem__) for name in MODELS}
    for name, df in staged.items():
        df.createOrReplaceTempView(f"staging_{name}")
    return staged


def build_marts(
    staged: dict[str, DataFrame], unique_orders: bool
) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Write dimensions, facts and KPIs in the order they depend on each other. Each is
    read back from its table, so nothing is computed twice and a lost executor costs no
    more than the stage at hand. Order facts are stored by month, which range queries on
    the month then read in part. ``unique_orders`` says that order ids can be relied on.
    Returns the frames and their tables by name; what the marts show does not change yet."""
    tables: dict[str, DataFrame] = {}
    versions: dict[str, str] = {}

    def keep(name: str, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        versions[name] = write_version(df, f"marts.{name}", partition_by)
        tables[name] = df.sparkSession.table(versions[name])
        return tables[name]

    customers = keep("dim_customers", marts.dim_customers(staged["stg_customers"]))
    products = keep("dim_products", marts.dim_products(staged["stg_products"]))
    keep("dim_sellers", marts.dim_sellers(staged["stg_sellers"]))
    payments = keep("fct_payments", marts.fct_payments(staged["stg_order_payments"]))
    items = keep("fct_order_items", marts.fct_order_items(staged["stg_order_items"], products))
    orders = keep(
        "fct_orders",
        marts.fct_orders(staged["stg_orders"], customers, staged["stg_order_items"], payments),
        BY_MONTH,
    )
    delivery = keep("fct_delivery_performance", marts.fct_delivery(orders), BY_MONTH)
    keep("fct_sales_by_category", marts.sales_by_category(items))
    keep("kpi_monthly_sales", marts.kpi_monthly(orders))
    keep("delivery_performance_monthly", marts.delivery_monthly(delivery))
    keep("kpi_overview", marts.kpi_overview(orders, None if unique_orders else delivery))
    return tables, versions


def check_report(
    raw: dict[str, DataFrame], staged: dict[str, DataFrame], tables: dict[str, DataFrame]
) -> DataFrame:
    pairs = {name: (raw[name], staged[f"stg_{name}"]) for name in PARITY_TABLES}
    return quality.run_checks(
        {**staged, **tables},
        [*quality.STAGING_CHECKS, *quality.MART_CHECKS],
        {
            "raw_recency": quality.recency(
                staged["stg_orders"], "order_purchase_ts", RECENT_SINCE
            ),
            "rowcount_staging_matches_raw": quality.row_parity(pairs),
        },
    )


def build_index(
    spark: SparkSession,
    staged: dict[str, DataFrame],
    provider: vectors.EmbeddingProvider | None = None,
) -> None:
    """Documents of the tables and of the glossary, embedded and stored. Without a provider the
    vectors are those of the hashing one, made without Python workers."""
    inventory = catalog.column_inventory(spark, INDEXED_LAYERS, {"staging": staged})
    for name, documents in (
        ("schema_index", catalog.table_documents(inventory)),
        ("glossary_index", catalog.glossary_documents(spark)),
    ):
        if provider is None:
            dim = vectors.HashingProvider().dim
            embedded = vectors.embed_words(documents, documents.columns, "document", dim)
            embedded = embedded.withColumn("embedding", F.col("embedding").cast("array<float>"))
        else:
            dim = provider.dim
            embedded = vectors.embed(documents, "document", provider)
        vectors.store_vectors(embedded, f"marts.{name}", dim)


def build_all(
    spark: SparkSession,
    source: str,
    prefix: str = "",
    provider: vectors.EmbeddingProvider | None = None,
    strict: bool = True,
) -> Build:
    """Run every step. The new marts are written beside the old and checked there; with
    ``strict`` a failed check stops before any of them is shown."""
    ensure_namespaces(spark)
    run_id = load_all(spark, source, prefix)
    raw = {spec.table: spark.table(f"raw.{spec.table}") for spec in SOURCES}
    staged = publish_staging(spark, raw)
    tables, versions = build_marts(staged, unique_orders=strict)
    report = materialize(check_report(raw, staged, tables), "marts.check_report")
    failed = [row.check_name for row in report.where("status = 'fail'").collect()]
    if failed and strict:
        raise FailedChecksError(f"data checks failed: {', '.join(sorted(failed))}")
    for name, version in versions.items():
        switch(spark, f"marts.{name}", version)
    publish_serving(spark)
    require_objects(spark)
    build_index(spark, staged, provider)
    return Build(run_id, report)
