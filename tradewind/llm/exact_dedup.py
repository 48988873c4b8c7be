"""Exact duplicates with a heavy-hitter split, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradewind.llm.stored import stored

# The characters that do not count when texts are compared: space, tab to carriage return.
IGNORED = " \t\n\x0b\x0c\r"
# Counters of the Misra-Gries sketch, and how many of its digests are split off at most.
# Both bound the broadcast: a winner takes about 100 bytes.
TRACKED = 4096
HEAVY = 1024


def text_digest(text: Column) -> Column:
    """SHA-256 of the text without white space, lower-case hex; a null is an empty text."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), IGNORED, ""), 256)


def _winners(rows: DataFrame) -> DataFrame:
    """Per digest the row that stays and the size of the group; combines on the map side."""
    order = F.struct((-F.col("n")).alias("n"), F.col("id").isNull().alias("no_id"), "id", "row")
    best = rows.groupBy("digest").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return best.select(
        "digest",
        F.col("best.id").alias("keep_id"),
        F.col("best.row").alias("keep_row"),
        "group_size",
    )


def heavy_digests(rows: DataFrame, heavy: int = HEAVY, tracked: int = TRACKED) -> DataFrame:
    """At most ``heavy`` digests that may be frequent, from a Misra-Gries sketch with
    ``tracked`` counters: every digest with more than 1/``tracked`` of the rows is tracked."""
    top = rows.agg(F.expr(f"approx_top_k(digest, {heavy}, {tracked})").alias("top"))
    items = top.select(F.explode("top").alias("item"))
    return items.where("item.count > 1").select(F.col("item.item").alias("digest"))


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    heavy: int = HEAVY,
    tracked: int = TRACKED,
) -> DataFrame:
    """One row per input row: its group of equal texts and whether it stays.

    Texts are equal if they are identical without white space. The row with the most code points
    stays, then the one with the smallest id. A sketch finds frequent digests; their groups are
    counted exactly, the winners are broadcast and decide in the map tasks. Only the other
    digests are shuffled row by row, so no hot group meets in one task.

    Null texts are empty texts and equal to each other and to blank ones. A null id loses ties.
    Of repeated rows with the same id exactly one stays. An empty table gives no rows; other
    columns are ignored whatever their names.

    Columns: the id column, keep_id, group_size, kept, text_sha256.
    """
    text = F.col(text_column)
    rows = stored(
        docs.select(
            F.col(id_column).alias("id"),
            F.length(F.coalesce(text, F.lit(""))).alias("n"),
            text_digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "exact-digests",
    )
    suspects = F.broadcast(heavy_digests(rows, heavy, tracked))
    winners = stored(_winners(rows.join(suspects, "digest", "left_semi")), "exact-winners")
    hot = rows.join(F.broadcast(winners), "digest")
    cold = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    decided = hot.unionByName(cold.join(_winners(cold), "digest"))
    return decided.select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH rows AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
        sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
    FROM documents
)
SELECT doc_id,
    first_value(doc_id) OVER best AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size,
    row_number() OVER best = 1 AS kept,
    text_sha256
FROM rows
WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""
