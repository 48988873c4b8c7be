"""Dimensions, facts and KPI marts over staged frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.columns import first_of_month, mean2, quotient, rate
from tradewind.operators.joins import lookup

MONEY = "decimal(14,2)"
# Totals over many orders: as wide as a sum of MONEY gets, so no volume overflows them.
TOTAL = "decimal(24,2)"


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(
        "customer_id",
        "customer_unique_id",
        "customer_zip_code_prefix",
        "customer_city",
        "customer_state",
    )


def dim_products(products: DataFrame) -> DataFrame:
    return products.select(
        "product_id",
        "product_category_name",
        "product_category_name_en",
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def dim_sellers(sellers: DataFrame) -> DataFrame:
    return sellers.select("seller_id", "seller_zip_code_prefix", "seller_city", "seller_state")


def fct_payments(payments: DataFrame) -> DataFrame:
    return payments.select(
        "order_id",
        "payment_sequential",
        "payment_type",
        "payment_installments",
        "payment_value",
    )


def fct_order_items(items: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with the category of their product."""
    category = products.select(
        "product_id", F.col("product_category_name_en").alias("category_name_en")
    )
    return lookup(items, category, "product_id").select(
        "order_id",
        "order_item_id",
        "product_id",
        "category_name_en",
        "seller_id",
        "shipping_limit_ts",
        "price",
        "freight_value",
        (F.col("price") + F.col("freight_value")).alias("gross_item_value"),
    )


def order_totals(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """Orders with their dates and the totals of their items and payments.

    Both details are summed per order before they are joined, so several items and several
    payments do not multiply each other. The three sides meet on ``order_id`` in one
    partitioning: orders are shuffled once."""
    item_sums = items.groupBy("order_id").agg(
        F.count("*").alias("item_count"),
        F.sum("price").alias("item_total"),
        F.sum("freight_value").alias("freight_total"),
    )
    payment_sums = payments.groupBy("order_id").agg(
        F.sum("payment_value").alias("payment_total")
    )

    def total(name: str):
        return F.coalesce(F.col(name), F.lit(0)).cast(MONEY)

    return (
        orders.join(item_sums, "order_id", "left")
        .join(payment_sums, "order_id", "left")
        .withColumns({
            "order_purchase_date": F.to_date("order_purchase_ts"),
            "order_month": first_of_month("order_purchase_ts"),
            "is_delivered": F.col("order_delivered_customer_ts").isNotNull(),
            "item_total": total("item_total"),
            "freight_total": total("freight_total"),
            "payment_total": total("payment_total"),
        })
    )


def fct_orders(
    orders: DataFrame, customers: DataFrame, items: DataFrame, payments: DataFrame
) -> DataFrame:
    """One row per order. ``item_count`` stays NULL without items; the totals are 0.00."""
    person = customers.select("customer_id", "customer_unique_id")
    return order_totals(lookup(orders, person, "customer_id"), items, payments).select(
        "order_id",
        "customer_id",
        "customer_unique_id",
        "order_status",
        "order_purchase_ts",
        "order_purchase_date",
        "order_month",
        "order_approved_ts",
        "order_delivered_carrier_ts",
        "order_delivered_customer_ts",
        "order_estimated_delivery_ts",
        "is_delivered",
        "item_count",
        "item_total",
        "freight_total",
        "payment_total",
    )


def delivery_delay_days():
    """Whole days from the estimate to the delivery, negative when early."""
    return F.datediff("order_delivered_customer_ts", "order_estimated_delivery_ts")


def fct_delivery(orders: DataFrame) -> DataFrame:
    """Orders whose status says delivered. A missing delivery time has no delay and is not
    late."""
    delivered = F.to_date("order_delivered_customer_ts")
    estimated = F.to_date("order_estimated_delivery_ts")
    return orders.where(F.col("order_status") == "delivered").select(
        "order_id",
        "order_month",
        "order_purchase_date",
        estimated.alias("estimated_delivery_date"),
        delivered.alias("delivered_customer_date"),
        delivery_delay_days().alias("delivery_delay_days"),
        F.when(delivered > estimated, 1).otherwise(0).alias("is_late_delivery"),
    )


def sales_by_category(items: DataFrame) -> DataFrame:
    """Distinct orders, revenue and mean price per category of ``fct_order_items``."""
    return (
        items.groupBy(F.coalesce("category_name_en", F.lit("unknown")).alias("category_name_en"))
        .agg(
            F.count_distinct("order_id").alias("total_orders"),
            F.sum("price").cast(TOTAL).alias("total_revenue"),
            mean2("price").alias("avg_item_value"),
        )
    )


def kpi_monthly(orders: DataFrame) -> DataFrame:
    """Orders, delivered orders, GMV and mean order value per month of ``fct_orders``.
    Sort it where it is read."""
    return orders.groupBy(F.col("order_month").alias("month")).agg(
        F.count("*").alias("total_orders"),
        F.count_if("is_delivered").alias("delivered_orders"),
        F.sum("payment_total").cast(TOTAL).alias("gmv"),
        mean2("payment_total").alias("avg_order_value"),
    )


def delivery_monthly(delivery: DataFrame) -> DataFrame:
    late = F.sum("is_late_delivery")
    return delivery.groupBy("order_month").agg(
        mean2("delivery_delay_days").alias("avg_delivery_delay_days"),
        rate(late, F.count("is_late_delivery")).alias("late_delivery_rate"),
    )


def kpi_overview(orders: DataFrame, delivery: DataFrame | None = None) -> DataFrame:
    """One row of totals, also over no orders.

    The measures are those of orders left join deliveries on ``order_id``. The delivery fact
    is a filter of the order fact, so while ``order_id`` is unique, which the build checks
    before it publishes, no join is needed. With ``delivery`` given nothing is assumed: both
    facts are summed per order first, so that copies of an order are counted as the join
    would count them and never become rows."""
    if delivery is None:
        counted = (F.col("order_status") == "delivered") & F.col("order_id").isNotNull()
        delay = F.when(counted, delivery_delay_days())
        delivered = F.count_if("is_delivered")
        return orders.withColumn("delay", delay).agg(
            F.count("*").alias("total_orders"),
            delivered.alias("delivered_orders"),
            rate(delivered, F.count("*")).alias("delivered_order_rate"),
            F.sum("payment_total").cast(TOTAL).alias("gmv"),
            mean2("payment_total").alias("avg_order_value"),
            mean2("delay").alias("avg_delivery_delay_days"),
        )

    per_order = orders.groupBy("order_id").agg(
        F.count("*").alias("n"),
        F.count_if("is_delivered").alias("n_delivered"),
        F.count("payment_total").alias("n_paid"),
        F.sum("payment_total").alias("paid"),
    )
    per_delivery = delivery.groupBy("order_id").agg(
        F.count("*").alias("matches"),
        F.count("delivery_delay_days").alias("n_delays"),
        F.sum("delivery_delay_days").alias("delay"),
    )
    # An order row appears once per match, and once without any.
    times = F.greatest(F.coalesce("matches", F.lit(1)), F.lit(1))
    rows = F.sum(F.col("n") * times)
    delivered = F.sum(F.col("n_delivered") * times)
    gmv = F.sum(F.col("paid") * times).cast(TOTAL)
    delays = F.sum(F.col("delay") * F.col("n")).cast(TOTAL)
    return per_order.join(per_delivery, "order_id", "left").agg(
        F.coalesce(rows, F.lit(0)).alias("total_orders"),
        F.coalesce(delivered, F.lit(0)).alias("delivered_orders"),
        rate(delivered, rows).alias("delivered_order_rate"),
        gmv.alias("gmv"),
        quotient(gmv, F.sum(F.col("n_paid") * times), 2).cast(MONEY).alias("avg_order_value"),
        quotient(delays, F.sum(F.col("n_delays") * F.col("n")), 2)
        .cast(MONEY)
        .alias("avg_delivery_delay_days"),
    )
