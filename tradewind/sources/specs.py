"""The nine source files: name, table and columns, all text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import StringType, StructField, StructType


@dataclass(frozen=True)
class SourceSpec:
    """``file_name`` is the end of the file's name; deliveries may put a prefix before it. Cells of
    a ``multiline`` source may run over line ends: one task then streams through each file, so
    large deliveries of it come as several files. All other files are split at line ends."""

    file_name: str
    table: str
    columns: tuple[str, ...]
    prefixed: bool = True
    multiline: bool = False

    @property
    def schema(self) -> StructType:
        return StructType([StructField(name, StringType()) for name in self.columns])

    def path(self, directory: str, prefix: str = "") -> str:
        name = f"{prefix}{self.file_name}" if self.prefixed else self.file_name
        return f"{directory.rstrip('/')}/{name}"


# File names, table names and column names in file order. The two "lenght"
# columns are spelled as in the files.
SOURCES = [
    SourceSpec(
        "customers_dataset.csv",
        "customers",
        (
            "customer_id",
            "customer_unique_id",
            "customer_zip_code_prefix",
            "customer_city",
            "customer_state",
        ),
    ),
    SourceSpec(
        "geolocation_dataset.csv",
        "geolocation",
        (
            "geolocation_zip_code_prefix",
            "geolocation_lat",
            "geolocation_lng",
            "geolocation_city",
            "geolocation_state",
        ),
    ),
    SourceSpec(
        "order_items_dataset.csv",
        "order_items",
        (
            "order_id",
            "order_item_id",
            "product_id",
            "seller_id",
            "shipping_limit_date",
            "price",
            "freight_value",
        ),
    ),
    SourceSpec(
        "order_payments_dataset.csv",
        "order_payments",
        (
            "order_id",
            "payment_sequential",
            "payment_type",
            "payment_installments",
            "payment_value",
        ),
    ),
    SourceSpec(
        "order_reviews_dataset.csv",
        "order_reviews",
        (
            "review_id",
            "order_id",
            "review_score",
            "review_comment_title",
            "review_comment_message",
            "review_creation_date",
            "review_answer_timestamp",
        ),
        multiline=True,
    ),
    SourceSpec(
        "orders_dataset.csv",
        "orders",
        (
            "order_id",
            "customer_id",
            "order_status",
            "order_purchase_timestamp",
            "order_approved_at",
            "order_delivered_carrier_date",
            "order_delivered_customer_date",
            "order_estimated_delivery_date",
        ),
    ),
    SourceSpec(
        "products_dataset.csv",
        "products",
        (
            "product_id",
            "product_category_name",
            "product_name_lenght",
            "product_description_lenght",
            "product_photos_qty",
            "product_weight_g",
            "product_length_cm",
            "product_height_cm",
            "product_width_cm",
        ),
    ),
    SourceSpec(
        "sellers_dataset.csv",
        "sellers",
        (
            "seller_id",
            "seller_zip_code_prefix",
            "seller_city",
            "seller_state",
        ),
    ),
    SourceSpec(
        "product_category_name_translation.csv",
        "product_category_translation",
        ("product_category_name", "product_category_name_english"),
        prefixed=False,
    ),
]
