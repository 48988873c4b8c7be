"""Declared data checks. A check is a query, and every row it returns is a failure."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows. NULL is no key."""
    return (
        df.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count("*").alias("n_rows"))
        .where(F.col("n_rows") > 1)
    )


def relationship(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child keys absent from the parent, with their number of rows. NULL is no key.

    Both sides are reduced to distinct keys on the map side first, so a key that a third of
    the rows share is one row in the join."""
    children = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("_key"))
        .agg(F.count("*").alias("n_rows"))
    )
    parents = parent.select(F.col(key).alias("_key")).distinct()
    return children.join(parents, "_key", "left_anti").select(
        F.col("_key").alias(column), "n_rows"
    )


def row_parity(pairs: Mapping[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Tables whose raw and staged row counts differ."""

    def counts(name: str, raw: DataFrame, staged: DataFrame) -> DataFrame:
        sides = union_all([
            raw.agg(F.count("*").alias("raw_count"), F.lit(0).cast("bigint").alias("stg_count")),
            staged.agg(F.lit(0).cast("bigint").alias("raw_count"), F.count("*").alias("stg_count")),
        ])
        return sides.agg(
            F.sum("raw_count").alias("raw_count"), F.sum("stg_count").alias("stg_count")
        ).select(F.lit(name).alias("table_name"), "raw_count", "stg_count")

    frames = [counts(name, raw, staged) for name, (raw, staged) in pairs.items()]
    return union_all(frames).where(F.col("raw_count") != F.col("stg_count"))


def recency(df: DataFrame, column: Column | str, minimum: str) -> DataFrame:
    """One row with the latest time if it lies before ``minimum``."""
    latest = F.max(column).alias("max_ts")
    return df.agg(latest).where(F.col("max_ts") < F.lit(minimum).cast("timestamp_ntz"))


@dataclass(frozen=True)
class Check:
    """``not_null`` and ``unique`` of a column, or ``relationship`` of it to a parent key."""

    kind: str
    table: str
    column: str
    parent: str | None = None
    key: str | None = None

    @property
    def name(self) -> str:
        target = f"_to_{self.parent}" if self.parent else ""
        return f"{self.kind}_{self.table}_{self.column}{target}"


def keys(table: str, *columns: str) -> list[Check]:
    kinds = ("not_null", "unique")
    return [Check(kind, table, name) for name in columns for kind in kinds]


def required(table: str, *columns: str) -> list[Check]:
    return [Check("not_null", table, name) for name in columns]


def refers(table: str, column: str, parent: str) -> Check:
    return Check("relationship", table, column, parent, column)


# The rules of the staged tables and of the marts.
STAGING_CHECKS = [
    *keys("stg_customers", "customer_id"),
    *required("stg_customers", "customer_unique_id"),
    *keys("stg_orders", "order_id"),
    *required("stg_orders", "customer_id"),
    refers("stg_orders", "customer_id", "stg_customers"),
    *required("stg_order_items", "order_id"),
    refers("stg_order_items", "order_id", "stg_orders"),
    refers("stg_order_items", "product_id", "stg_products"),
    refers("stg_order_items", "seller_id", "stg_sellers"),
    *keys("stg_products", "product_id"),
    *keys("stg_sellers", "seller_id"),
    *required("stg_order_payments", "order_id"),
    refers("stg_order_payments", "order_id", "stg_orders"),
    *required("stg_order_reviews", "order_id"),
    refers("stg_order_reviews", "order_id", "stg_orders"),
]

MART_CHECKS = [
    *keys("dim_products", "product_id"),
    *keys("dim_customers", "customer_id"),
    *keys("dim_sellers", "seller_id"),
    *keys("fct_orders", "order_id"),
    refers("fct_orders", "customer_id", "dim_customers"),
    refers("fct_payments", "order_id", "fct_orders"),
    *required("fct_order_items", "order_id", "product_id", "seller_id"),
    refers("fct_order_items", "order_id", "fct_orders"),
    refers("fct_order_items", "product_id", "dim_products"),
    refers("fct_order_items", "seller_id", "dim_sellers"),
    *required("fct_sales_by_category", "category_name_en"),
    *keys("kpi_monthly_sales", "month"),
]


def _null_counts(df: DataFrame, checks: list[Check]) -> DataFrame:
    """All NULL checks of one table in one scan."""
    counted = df.agg(*[
        F.count_if(F.col(c.column).isNull()).alias(c.column) for c in checks
    ])
    rows = F.array(*[
        F.struct(F.lit(c.name).alias("check_name"), F.col(c.column).alias("failures"))
        for c in checks
    ])
    return counted.select(F.inline(rows))


def _key_failures(
    tables: Mapping[str, DataFrame], parent: tuple[str, str], checks: list[Check]
) -> DataFrame:
    """All checks around one key in one aggregation: the rows of the key's own table and of each
    table that refers to it are counted per key side by side. A key that many rows share is one
    row per task; each (table, key) is read once."""
    sides = [parent, *dict.fromkeys((c.table, c.column) for c in checks if c.kind != "unique")]
    sides = list(dict.fromkeys(sides))
    rows = union_all([
        tables[table].where(F.col(column).isNotNull()).select(
            F.col(column).alias("key"),
            *[F.lit(int(k == at)).cast("bigint").alias(f"n{k}") for k in range(len(sides))],
        )
        for at, (table, column) in enumerate(sides)
    ])
    counts = rows.groupBy("key").agg(*[F.sum(f"n{k}").alias(f"n{k}") for k in range(len(sides))])

    def failures(check: Check) -> Column:
        n = F.col(f"n{sides.index((check.table, check.column))}")
        if check.kind == "unique":
            return F.count_if(n > 1)
        return F.coalesce(F.sum(F.when(F.col("n0") == 0, n)), F.lit(0))

    totals = counts.agg(*[failures(c).cast("bigint").alias(f"f{i}") for i, c in enumerate(checks)])
    return totals.select(F.inline(F.array(*[
        F.struct(F.lit(c.name).alias("check_name"), F.col(f"f{i}").alias("failures"))
        for i, c in enumerate(checks)
    ])))


def run_checks(
    tables: Mapping[str, DataFrame],
    checks: list[Check],
    extra: Mapping[str, DataFrame] | None = None,
) -> DataFrame:
    """One row per check: check_name, failures, status. ``extra`` are check queries whose
    rows are failures. Checks of tables that are not given are an error.

    There is one pass for the NULLs of a table and one aggregation per key with everything that
    refers to it."""
    nulls: dict[str, list[Check]] = {}
    keys_: dict[tuple[str, str], list[Check]] = {}
    for check in checks:
        if check.kind == "not_null":
            nulls.setdefault(check.table, []).append(check)
        elif check.kind == "relationship":
            keys_.setdefault((check.parent, check.key), []).append(check)
    for check in checks:
        if check.kind == "unique":
            own = (check.table, check.column)
            # A foreign key is counted with the key it refers to.
            home = next(
                (k for k, group in keys_.items() if any((c.table, c.column) == own for c in group)),
                own,
            )
            keys_.setdefault(own if own in keys_ else home, []).append(check)
    frames = [_key_failures(tables, parent, group) for parent, group in keys_.items()]
    frames += [_null_counts(tables[table], group) for table, group in nulls.items()]
    for name, query in (extra or {}).items():
        counted = query.agg(F.count("*").alias("failures"))
        frames.append(counted.select(F.lit(name).alias("check_name"), "failures"))
    status = F.when(F.col("failures") == 0, "pass").otherwise("fail")
    return union_all(frames).withColumn("status", status)
