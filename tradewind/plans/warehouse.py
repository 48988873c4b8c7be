"""The driver's tables under the names and grain of the commerce model.

Ids keep their bigint type: the model only compares and groups them, and eight bytes cost
less in a shuffle than text. Columns the tables lack are computed from their rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.plans import marts, staging

PRICE = "decimal(12,2)"

# Declared, so that building a plan reads no file.
SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def order_status() -> Column:
    code = F.col("o_orderstatus")
    return F.when(code == "F", "delivered").when(code == "O", "shipped").otherwise("processing")


def delivered_at() -> Column:
    """Delivery up to 90 days after the order, by the cents of its price. Some delivered
    orders have no time, and some shipped ones have one."""
    days = F.pmod((F.col("o_totalprice") * 100).cast("bigint"), F.lit(91)).cast("int")
    there = ((F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") != "5-LOW")) | (
        (F.col("o_orderstatus") == "O") & (F.col("o_orderpriority") == "1-URGENT")
    )
    return F.when(there, F.col("o_orderdate") + F.make_dt_interval(days))


class Warehouse:
    """Staged frames and marts over one folder of parquet tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def orders(self) -> DataFrame:
        return self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("customer_id"),
            order_status().alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_ts"),
            F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate")).alias("order_approved_ts"),
            delivered_at().alias("order_delivered_carrier_ts"),
            delivered_at().alias("order_delivered_customer_ts"),
            (F.col("o_orderdate") + F.expr("INTERVAL 45 DAYS")).alias(
                "order_estimated_delivery_ts"
            ),
        )

    @cached_property
    def items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast(PRICE)
        freight = F.round(price * F.col("l_tax").cast("decimal(4,2)"), 2).cast(PRICE)
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_ts"),
            price.alias("price"),
            freight.alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        """One to three payments per order, the later ones by voucher; the last pays what the
        others left of the price."""
        count = F.pmod(F.col("o_orderkey"), F.lit(3)).cast("int") + 1
        parts = self.table("orders").select(
            F.col("o_orderkey").alias("order_id"),
            "o_orderpriority",
            (F.col("o_totalprice").cast(PRICE) * 100).cast("bigint").alias("cents"),
            count.alias("n"),
            F.explode(F.sequence(F.lit(1), count)).alias("payment_sequential"),
        )
        number = F.col("payment_sequential")
        share = F.floor(F.col("cents") / F.col("n")).cast("bigint")
        paid = F.when(number < F.col("n"), share).otherwise(
            F.col("cents") - share * (F.col("n") - 1)
        )
        return parts.select(
            "order_id",
            "payment_sequential",
            F.when(number == 1, F.col("o_orderpriority")).otherwise("voucher").alias(
                "payment_type"
            ),
            (F.pmod(F.col("order_id") + number, F.lit(12)) + 1).cast("int").alias(
                "payment_installments"
            ),
            (paid.cast("decimal(12,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(PRICE).alias(
                "payment_value"
            ),
        )

    @cached_property
    def customers(self) -> DataFrame:
        """The order-scoped id and the person; ``placed_customers`` adds the place."""
        return self.table("customer").select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_unique_id"),
            F.col("c_nationkey").alias("customer_zip_code_prefix"),
        )

    @cached_property
    def places(self) -> DataFrame:
        return (
            self.table("nation")
            .join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
            .select(
                F.col("n_nationkey").alias("zip"),
                F.lower("n_name").alias("city"),
                F.upper("r_name").alias("state"),
            )
        )

    @cached_property
    def placed_customers(self) -> DataFrame:
        zip_code = F.col("customer_zip_code_prefix")
        return self.customers.join(self.places, zip_code == F.col("zip"), "left").select(
            "customer_id",
            "customer_unique_id",
            "customer_zip_code_prefix",
            F.col("city").alias("customer_city"),
            F.col("state").alias("customer_state"),
        )

    @cached_property
    def placed_sellers(self) -> DataFrame:
        sellers = self.table("supplier")
        return sellers.join(self.places, F.col("s_nationkey") == F.col("zip"), "left").select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_nationkey").alias("seller_zip_code_prefix"),
            F.col("city").alias("seller_city"),
            F.col("state").alias("seller_state"),
        )

    @cached_property
    def products(self) -> DataFrame:
        """One category has no translation and is therefore ``unknown``."""
        category = F.col("p_type")
        return self.table("part").select(
            F.col("p_partkey").alias("product_id"),
            category.alias("product_category_name"),
            F.when(category != "LARGE", F.lower(category))
            .otherwise("unknown")
            .alias("product_category_name_en"),
            F.length("p_name").alias("product_name_length"),
            F.length("p_brand").alias("product_description_length"),
            F.col("p_size").alias("product_photos_qty"),
            F.col("p_retailprice").cast(PRICE).alias("product_weight_g"),
            F.col("p_size").cast(PRICE).alias("product_length_cm"),
            F.col("p_size").cast(PRICE).alias("product_height_cm"),
            F.col("p_size").cast(PRICE).alias("product_width_cm"),
        )

    @cached_property
    def fct_orders(self) -> DataFrame:
        return marts.fct_orders(self.orders, self.customers, self.items, self.payments)

    @cached_property
    def order_totals(self) -> DataFrame:
        """``fct_orders`` without the person, for measures that do not ask for it."""
        return marts.order_totals(self.orders, self.items, self.payments)

    @cached_property
    def fct_order_items(self) -> DataFrame:
        return marts.fct_order_items(self.items, self.products)

    @cached_property
    def fct_delivery(self) -> DataFrame:
        return marts.fct_delivery(self.order_totals)

    @cached_property
    def sales_by_category(self) -> DataFrame:
        return marts.sales_by_category(self.fct_order_items)

    @cached_property
    def kpi_monthly(self) -> DataFrame:
        return marts.kpi_monthly(self.order_totals)

    @cached_property
    def delivery_monthly(self) -> DataFrame:
        return marts.delivery_monthly(self.fct_delivery)

    @cached_property
    def kpi_overview(self) -> DataFrame:
        return marts.kpi_overview(self.order_totals)

    # The same tables as text, with padding, mixed case and blanks, as source files have them.

    def raw(self, table: str) -> DataFrame:
        return getattr(self, f"raw_{table}")

    def staged(self, name: str) -> DataFrame:
        return staging.stage(name, self.raw)

    @cached_property
    def raw_orders(self) -> DataFrame:
        orders = self.orders

        def text(name: str) -> Column:
            return F.coalesce(F.col(name).cast("string"), F.lit(""))

        return orders.select(
            F.concat(F.lit(" "), text("order_id"), F.lit("  ")).alias("order_id"),
            F.concat(text("customer_id"), F.lit(" ")).alias("customer_id"),
            F.concat(F.lit("  "), F.col("order_status")).alias("order_status"),
            text("order_purchase_ts").alias("order_purchase_timestamp"),
            text("order_approved_ts").alias("order_approved_at"),
            text("order_delivered_carrier_ts").alias("order_delivered_carrier_date"),
            text("order_delivered_customer_ts").alias("order_delivered_customer_date"),
            text("order_estimated_delivery_ts").alias("order_estimated_delivery_date"),
        )

    @cached_property
    def raw_order_items(self) -> DataFrame:
        return self.items.select(
            F.concat(F.lit(" "), F.col("order_id").cast("string")).alias("order_id"),
            F.col("order_item_id").cast("string").alias("order_item_id"),
            F.concat(F.col("product_id").cast("string"), F.lit(" ")).alias("product_id"),
            F.col("seller_id").cast("string").alias("seller_id"),
            F.col("shipping_limit_ts").cast("string").alias("shipping_limit_date"),
            F.when(F.col("order_item_id") == 7, "")
            .otherwise(F.col("price").cast("string"))
            .alias("price"),
            F.col("freight_value").cast("string").alias("freight_value"),
        )

    @cached_property
    def raw_order_payments(self) -> DataFrame:
        return self.payments.select(
            F.col("order_id").cast("string").alias("order_id"),
            F.col("payment_sequential").cast("string").alias("payment_sequential"),
            F.concat(F.lit(" "), F.col("payment_type"), F.lit(" ")).alias("payment_type"),
            F.when(F.col("payment_installments") == 7, "")
            .otherwise(F.col("payment_installments").cast("string"))
            .alias("payment_installments"),
            F.col("payment_value").cast("string").alias("payment_value"),
        )

    @cached_property
    def raw_order_reviews(self) -> DataFrame:
        """Labelled documents as reviews: the text is the message."""
        documents = self.table("documents").join(self.table("labels"), "doc_id", "left")
        score = F.coalesce((F.col("quality") + 4).cast("string"), F.lit(""))
        return documents.select(
            F.concat(F.lit(" r"), F.col("doc_id").cast("string")).alias("review_id"),
            F.concat(F.col("doc_id").cast("string"), F.lit(" ")).alias("order_id"),
            score.alias("review_score"),
            F.when(F.col("lang") != "en", F.col("lang"))
            .otherwise("")
            .alias("review_comment_title"),
            F.col("text").alias("review_comment_message"),
            F.lit("2018-01-02 03:04:05").alias("review_creation_date"),
            F.when(F.col("toxic") == 1, "2018-02-03 00:00:00").otherwise("").alias(
                "review_answer_timestamp"
            ),
        )

    @cached_property
    def raw_customers(self) -> DataFrame:
        return self.placed_customers.select(
            F.col("customer_id").cast("string").alias("customer_id"),
            F.concat(F.lit(" "), F.col("customer_unique_id")).alias("customer_unique_id"),
            F.when(F.col("customer_zip_code_prefix") == 0, "")
            .otherwise(F.col("customer_zip_code_prefix").cast("string"))
            .alias("customer_zip_code_prefix"),
            F.concat(F.lit(" "), F.initcap("customer_city")).alias("customer_city"),
            F.concat(F.lower("customer_state"), F.lit(" ")).alias("customer_state"),
        )

    @cached_property
    def raw_sellers(self) -> DataFrame:
        return self.placed_sellers.select(
            F.concat(F.col("seller_id").cast("string"), F.lit(" ")).alias("seller_id"),
            F.when(F.col("seller_zip_code_prefix") == 0, "")
            .otherwise(F.col("seller_zip_code_prefix").cast("string"))
            .alias("seller_zip_code_prefix"),
            F.upper("seller_city").alias("seller_city"),
            F.concat(F.lit(" "), F.lower("seller_state")).alias("seller_state"),
        )

    @cached_property
    def raw_geolocation(self) -> DataFrame:
        """One point per customer, by balance."""
        points = self.table("customer").select("c_nationkey", "c_acctbal")
        places = self.places.select(
            "zip", F.col("city").alias("customer_city"), F.col("state").alias("customer_state")
        )
        return points.join(places, F.col("c_nationkey") == F.col("zip"), "left").select(
            F.col("c_nationkey").cast("string").alias("geolocation_zip_code_prefix"),
            F.col("c_acctbal").cast("string").alias("geolocation_lat"),
            F.when(F.col("c_acctbal") < 0, "")
            .otherwise(F.col("c_acctbal").cast("string"))
            .alias("geolocation_lng"),
            F.concat(F.lit(" "), F.upper("customer_city")).alias("geolocation_city"),
            F.lower("customer_state").alias("geolocation_state"),
        )

    @cached_property
    def raw_product_category_translation(self) -> DataFrame:
        """Five of the six categories."""
        names = self.table("part").where(F.col("p_type") != "LARGE").select("p_type").distinct()
        return names.select(
            F.concat(F.lit(" "), F.col("p_type")).alias("product_category_name"),
            F.concat(F.lower("p_type"), F.lit(" ")).alias("product_category_name_english"),
        )

    @cached_property
    def raw_products(self) -> DataFrame:
        products = self.products

        def text(name: str) -> Column:
            return F.col(name).cast("string")

        return products.select(
            F.concat(F.lit(" "), text("product_id")).alias("product_id"),
            F.concat(F.col("product_category_name"), F.lit("  ")).alias("product_category_name"),
            text("product_name_length").alias("product_name_lenght"),
            F.when(F.col("product_photos_qty") == 1, "")
            .otherwise(text("product_description_length"))
            .alias("product_description_lenght"),
            text("product_photos_qty").alias("product_photos_qty"),
            text("product_weight_g").alias("product_weight_g"),
            text("product_length_cm").alias("product_length_cm"),
            text("product_height_cm").alias("product_height_cm"),
            F.when(F.col("product_photos_qty") == 2, "")
            .otherwise(text("product_width_cm"))
            .alias("product_width_cm"),
        )
