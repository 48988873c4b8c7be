"""Search over a column inventory, and documents that describe tables and terms."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradewind.functions import wordlists as words
from tradewind.functions.columns import stable_id
from tradewind.sources.tables import LAYERS

INVENTORY = (
    "table_schema string, table_name string, column_name string, ordinal_position int, "
    "data_type string, is_nullable boolean"
)

# Tables that hold the content of a stored collection; the collection itself is a view.
VERSION = re.compile("__[0-9a-f]{32}$")


def column_inventory(
    spark: SparkSession,
    layers: list[str] | None = None,
    lazy: Mapping[str, Mapping[str, DataFrame]] | None = None,
) -> DataFrame:
    """All columns of the layers' tables, from the catalog's metadata. ``lazy`` adds layers
    that exist as frames only, as staging does: layer to table name to frame."""
    rows = [
        (layer, table.name, column.name, position, column.dataType, column.nullable)
        for layer in layers or LAYERS
        if spark.catalog.databaseExists(layer)
        for table in spark.catalog.listTables(layer)
        if not table.isTemporary and not VERSION.search(table.name)
        for position, column in enumerate(
            spark.catalog.listColumns(f"{layer}.{table.name}"), start=1
        )
    ]
    rows += [
        (layer, table, field.name, position, field.dataType.simpleString(), field.nullable)
        for layer, tables in (lazy or {}).items()
        for table, df in tables.items()
        for position, field in enumerate(df.schema.fields, start=1)
    ]
    return spark.createDataFrame(rows, INVENTORY)


def search_schema(
    inventory: DataFrame, keyword: str, layers: list[str] | None = None, n: int | None = None
) -> DataFrame:
    """Columns whose table or name contains the keyword in any case, in catalog order: all of
    them, or the first ``n``."""
    pattern = f"%{keyword}%"
    found = (
        inventory.where(F.col("table_schema").isin(layers or LAYERS))
        .where(F.col("table_name").ilike(pattern) | F.col("column_name").ilike(pattern))
        .orderBy("table_schema", "table_name", "ordinal_position")
    )
    columns = ["table_schema", "table_name", "column_name", "data_type"]
    return (found if n is None else found.limit(n)).select(*columns)


def table_documents(inventory: DataFrame) -> DataFrame:
    """One document per table: id, names, columns, types and the text to embed. A group is
    one table's columns, which the catalog bounds."""
    columns = F.array_sort(F.collect_list(F.struct(
        F.col("ordinal_position"), F.col("column_name"), F.col("data_type")
    )))
    full_name = F.concat_ws(".", "table_schema", "table_name")
    lines = F.transform("cols", lambda c: F.format_string("- %s (%s)", c.column_name, c.data_type))
    types = F.map_from_entries(
        F.transform("cols", lambda c: F.struct(c.column_name, c.data_type))
    )
    return (
        inventory.groupBy("table_schema", "table_name")
        .agg(columns.alias("cols"))
        .select(
            stable_id(full_name).alias("id"),
            "table_schema",
            "table_name",
            full_name.alias("fully_qualified"),
            F.col("cols.column_name").alias("columns"),
            types.alias("column_types"),
            F.concat(
                F.lit("Table: "), full_name, F.lit("\nColumns:\n"), F.array_join(lines, "\n")
            ).alias("document"),
        )
    )


def glossary_documents(spark: SparkSession, glossary: list[tuple] | None = None) -> DataFrame:
    entries = words.GLOSSARY if glossary is None else glossary
    terms = spark.createDataFrame(
        entries, "key string, term string, definition string, formula string, source_table string"
    )
    document = F.format_string(
        "Term: %s (%s)\nDefinition: %s\nFormula: %s\nSource: %s",
        "term", "key", "definition", "formula", "source_table",
    )
    return terms.select(
        stable_id(F.concat(F.lit("glossary::"), "key")).alias("id"),
        "*",
        document.alias("document"),
    )
