"""Staging: all-text raw frames to typed, cleaned frames, one to one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.functions.columns import blank_to_null, clean_text, typed
from tradewind.operators.joins import lookup

MONEY = "decimal(12,2)"
TIME = "timestamp_ntz"


def stg_customers(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("customer_id").alias("customer_id"),
        clean_text("customer_unique_id").alias("customer_unique_id"),
        typed("customer_zip_code_prefix", "int").alias("customer_zip_code_prefix"),
        clean_text("customer_city", "lower").alias("customer_city"),
        clean_text("customer_state", "upper").alias("customer_state"),
    )


def stg_geolocation(raw: DataFrame) -> DataFrame:
    return raw.select(
        typed("geolocation_zip_code_prefix", "int").alias("geolocation_zip_code_prefix"),
        typed("geolocation_lat", "double").alias("geolocation_lat"),
        typed("geolocation_lng", "double").alias("geolocation_lng"),
        clean_text("geolocation_city", "lower").alias("geolocation_city"),
        clean_text("geolocation_state", "upper").alias("geolocation_state"),
    )


def stg_order_items(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("order_id").alias("order_id"),
        typed("order_item_id", "int").alias("order_item_id"),
        clean_text("product_id").alias("product_id"),
        clean_text("seller_id").alias("seller_id"),
        typed("shipping_limit_date", TIME).alias("shipping_limit_ts"),
        typed("price", MONEY).alias("price"),
        typed("freight_value", MONEY).alias("freight_value"),
    )


def stg_order_payments(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("order_id").alias("order_id"),
        typed("payment_sequential", "int").alias("payment_sequential"),
        clean_text("payment_type").alias("payment_type"),
        typed("payment_installments", "int").alias("payment_installments"),
        typed("payment_value", MONEY).alias("payment_value"),
    )


def stg_order_reviews(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("review_id").alias("review_id"),
        clean_text("order_id").alias("order_id"),
        typed("review_score", "int").alias("review_score"),
        blank_to_null("review_comment_title").alias("review_comment_title"),
        blank_to_null("review_comment_message").alias("review_comment_message"),
        typed("review_creation_date", TIME).alias("review_creation_ts"),
        typed("review_answer_timestamp", TIME).alias("review_answer_ts"),
    )


def stg_orders(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("order_id").alias("order_id"),
        clean_text("customer_id").alias("customer_id"),
        clean_text("order_status").alias("order_status"),
        typed("order_purchase_timestamp", TIME).alias("order_purchase_ts"),
        typed("order_approved_at", TIME).alias("order_approved_ts"),
        typed("order_delivered_carrier_date", TIME).alias("order_delivered_carrier_ts"),
        typed("order_delivered_customer_date", TIME).alias("order_delivered_customer_ts"),
        typed("order_estimated_delivery_date", TIME).alias("order_estimated_delivery_ts"),
    )


def stg_translation(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("product_category_name").alias("product_category_name"),
        clean_text("product_category_name_english").alias("product_category_name_english"),
    )


def stg_products(raw: DataFrame, translation: DataFrame) -> DataFrame:
    """``translation`` is the staged translation; a category without one is ``unknown``."""
    products = raw.select(
        clean_text("product_id").alias("product_id"),
        clean_text("product_category_name").alias("product_category_name"),
        typed("product_name_lenght", "int").alias("product_name_length"),
        typed("product_description_lenght", "int").alias("product_description_length"),
        typed("product_photos_qty", "int").alias("product_photos_qty"),
        typed("product_weight_g", MONEY).alias("product_weight_g"),
        typed("product_length_cm", MONEY).alias("product_length_cm"),
        typed("product_height_cm", MONEY).alias("product_height_cm"),
        typed("product_width_cm", MONEY).alias("product_width_cm"),
    )
    english = F.coalesce("product_category_name_english", F.lit("unknown"))
    return lookup(products, translation, "product_category_name").select(
        "product_id",
        "product_category_name",
        english.alias("product_category_name_en"),
        "product_name_length",
        "product_description_length",
        "product_photos_qty",
        "product_weight_g",
        "product_length_cm",
        "product_height_cm",
        "product_width_cm",
    )


def stg_sellers(raw: DataFrame) -> DataFrame:
    return raw.select(
        clean_text("seller_id").alias("seller_id"),
        typed("seller_zip_code_prefix", "int").alias("seller_zip_code_prefix"),
        clean_text("seller_city", "lower").alias("seller_city"),
        clean_text("seller_state", "upper").alias("seller_state"),
    )


# Staged table, the raw table it comes from and its model; products also need translations.
MODELS = {
    "stg_customers": ("customers", stg_customers),
    "stg_geolocation": ("geolocation", stg_geolocation),
    "stg_order_items": ("order_items", stg_order_items),
    "stg_order_payments": ("order_payments", stg_order_payments),
    "stg_order_reviews": ("order_reviews", stg_order_reviews),
    "stg_orders": ("orders", stg_orders),
    "stg_product_category_translation": ("product_category_translation", stg_translation),
    "stg_products": ("products", stg_products),
    "stg_sellers": ("sellers", stg_sellers),
}


def stage(name: str, raw: Callable[[str], DataFrame]) -> DataFrame:
    """One staged frame; ``raw`` gives a raw table by name."""
    source, model = MODELS[name]
    if name == "stg_products":
        return stg_products(raw(source), stage("stg_product_category_translation", raw))
    return model(raw(source))
