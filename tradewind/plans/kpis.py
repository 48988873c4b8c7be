"""Business queries over the marts."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date
from functools import reduce
from operator import and_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions.columns import quotient
from tradewind.operators.ranking import between_optional, newest, top_by
from tradewind.sources.tables import read_curated

MONTHLY_COLUMNS = ["month", "total_orders", "delivered_orders", "gmv", "avg_order_value"]
CATEGORY_COLUMNS = ["category_name_en", "total_orders", "total_revenue", "avg_item_value"]


def recent_orders(orders: DataFrame, n: int = 100) -> DataFrame:
    """Newest orders of ``fct_orders``; equal times are ordered by order id."""
    wanted = orders.select(
        "order_id", "customer_id", "order_status", "order_purchase_ts", "payment_total"
    )
    return newest(wanted, "order_purchase_ts", n, "order_id")


def top_categories(categories: DataFrame, n: int = 8) -> DataFrame:
    """Categories of highest revenue; 20 and 10 are the usual reports, 8 the dashboard's."""
    if n < 1:
        raise ValueError(f"number of categories must be positive: {n}")
    return top_by(
        categories.select(*CATEGORY_COLUMNS), "total_revenue", n, "category_name_en"
    )


def latest_months(monthly: DataFrame, n: int = 3) -> DataFrame:
    """Rows of the last ``n`` calendar months up to the latest month, oldest first.

    The latest month is a one-row scalar subquery; a window over all rows would do the same
    in one task."""
    latest = monthly.agg(F.max("month").alias("month"))
    since = F.add_months(latest.scalar(), 1 - n)
    return monthly.select(*MONTHLY_COLUMNS).where(F.col("month") >= since).orderBy("month")


def monthly_sales(
    monthly: DataFrame, low: date | str | None = None, high: date | str | None = None
) -> DataFrame:
    """Monthly series ascending. Bounds compare with the first day of the month, so a start
    inside January leaves January out."""
    return between_optional(monthly.select(*MONTHLY_COLUMNS), "month", low, high).orderBy("month")


def orders_of_months(
    orders: DataFrame,
    low: date | str | None,
    high: date | str | None,
    time: str = "order_purchase_ts",
) -> DataFrame:
    """The orders whose month :func:`monthly_sales` would keep, as a condition on the raw
    time. That one reaches the file scan, a condition on the computed month does not."""
    if low is not None:
        day = date.fromisoformat(str(low))
        first = day if day.day == 1 else _month_after(day)
        orders = orders.where(F.col(time) >= F.lit(str(first)).cast("timestamp_ntz"))
    if high is not None:
        end = _month_after(date.fromisoformat(str(high)))
        orders = orders.where(F.col(time) < F.lit(str(end)).cast("timestamp_ntz"))
    return orders


def _month_after(day: date) -> date:
    return date(day.year + day.month // 12, day.month % 12 + 1, 1)


def delivery_series(delivery: DataFrame) -> DataFrame:
    return delivery.select(
        "order_month", "avg_delivery_delay_days", "late_delivery_rate"
    ).orderBy("order_month")


def overview(kpis: DataFrame) -> DataFrame:
    return kpis.select(
        "total_orders", "delivered_orders", "delivered_order_rate", "gmv", "avg_order_value"
    )


@dataclass
class KpiSummary:
    """``overview`` covers all time, ``series`` the asked months, ``series_row_count`` is a
    one-row frame with their number."""

    overview: DataFrame
    series: DataFrame
    series_row_count: DataFrame


def kpi_summary(
    kpis: DataFrame,
    monthly: DataFrame,
    low: date | str | None = None,
    high: date | str | None = None,
) -> KpiSummary:
    series = monthly_sales(monthly, low, high)
    return KpiSummary(
        kpis.select(
            "total_orders",
            "delivered_orders",
            "delivered_order_rate",
            "gmv",
            "avg_order_value",
            "avg_delivery_delay_days",
        ),
        series,
        series.agg(F.count("*").alias("series_row_count")),
    )


@dataclass
class Dashboard:
    summary: KpiSummary
    top_categories: DataFrame | None
    warnings: list[str] = field(default_factory=list)


def dashboard(
    spark: SparkSession,
    low: date | str | None = None,
    high: date | str | None = None,
    n: int = 8,
) -> Dashboard:
    """KPI summary and top categories of the serving layer. A missing category table is a
    warning, not an error."""
    summary = kpi_summary(
        read_curated(spark, "serving.kpi_overview"),
        read_curated(spark, "serving.kpi_monthly_sales"),
        low,
        high,
    )
    try:
        categories = top_categories(read_curated(spark, "serving.fct_sales_by_category"), n)
    except AnalysisException as error:
        return Dashboard(summary, None, [f"Top categories unavailable: {error}"])
    return Dashboard(summary, categories)


MEASURES = ["gmv", "orders", "customers", "aov", "aov_delivered"]


def kpi(df: DataFrame, *names: str, by: list[str] | None = None) -> DataFrame:
    """Ad-hoc measures over payments joined to their orders, in total or per key.

    ``aov`` divides by all orders, ``aov_delivered`` by the delivered ones, as the glossary words
    it. Payments are summed per order first, which gives the sum and both order counts without
    multiplying rows; distinct customers come from a second, narrow aggregation where asked for."""
    unknown = [name for name in names if name not in MEASURES]
    if unknown:
        raise ValueError(f"unknown measures {unknown}; there are {sorted(MEASURES)}")
    keys = by or []
    per_order = df.groupBy(*keys, "order_id").agg(
        F.sum("payment_value").alias("_paid"),
        F.bool_or(F.col("order_status") == "delivered").alias("_delivered"),
    )
    known = F.col("order_id").isNotNull()
    totals = per_order.groupBy(*keys).agg(
        F.sum("_paid").cast("decimal(24,2)").alias("gmv"),
        F.count("order_id").alias("orders"),
        F.count_if(known & F.col("_delivered")).alias("_delivered"),
    )
    if "customers" in names:
        people = df.select(*keys, "customer_unique_id").distinct()
        counted = F.count("customer_unique_id").alias("customers")
        if keys:
            people = people.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(counted)
            same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
            totals = totals.join(people, same)
        else:
            totals = totals.withColumn("customers", people.agg(counted).scalar())
    measures = {
        "aov": quotient(F.col("gmv"), F.col("orders"), 2).cast("decimal(14,2)"),
        "aov_delivered": quotient(F.col("gmv"), F.col("_delivered"), 2).cast("decimal(14,2)"),
    }
    return totals.select(*keys, *[measures.get(name, F.col(name)).alias(name) for name in names])
