"""Records of CSV files whose cells may run over line ends, found in all parts of a file at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# How cells are read: doubled quotes; a quoted empty cell is an empty text, a bare one is NULL.
CELLS = {"quote": '"', "escape": '"', "nullValue": "\u0001", "emptyValue": ""}
BYTE_ORDER_MARK = "﻿"

# Lines of a block are 2 to this power at most; they are what a task sorts and counts together.
BLOCK_BITS = 10


def _has_odd_quotes(line: Column) -> Column:
    return (F.octet_length(line) - F.octet_length(F.replace(line, F.lit('"'), F.lit("")))) % 2 == 1


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, is_header) for the records of a file, a folder or a glob; the first record of each
    file is its header. Blank lines between records are none.

    Files are read by lines, in as many splits as their size gives, and the lines of a split lie in
    blocks. A line end is inside a cell if an odd number of quotes stands before it: lines with an odd
    number are counted per block, and sums over the blocks and splits before say in which state a block
    starts. The lines of a record are put together by the block and the line that it starts in, so a
    record may lie over any number of blocks and splits, and no task has more of a split than a block
    at a time. ``\\r\\n`` becomes ``\\n``."""
    # Most lines are taken as they are; the pattern decodes the others, each wrong sequence to one U+FFFD.
    plain = F.is_valid_utf8("value") & ~F.contains("value", F.lit("\r"))
    lines = (
        spark.read.option("lineSep", "\n")
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("line"),
            _has_odd_quotes(F.col("value")).cast("int").alias("odd"),
            F.when(plain, F.col("value")).otherwise(F.regexp_replace("value", "\r$", "")).alias("text"),
        )
        .withColumn("block", F.shiftright("line", BLOCK_BITS))
    )
    # A state goes before the lines of its piece, so that it is there when they are counted.
    states = _states(lines)
    nothing = F.lit(None).cast(states.schema["state"].dataType)
    rows = lines.select("block", "split", "line", "odd", "text", nothing.alias("state")).unionByName(
        states.select("*", F.lit(0).alias("odd"), F.lit(None).cast("string").alias("text"))
    )
    is_line = F.col("state").isNull()
    in_block = Window.partitionBy("block").orderBy("line", is_line)
    so_far = in_block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    missing = F.raise_error(F.lit(f"{path} was split in another way when its records were read")).cast("boolean")
    opened = (
        rows.select(
            "*",
            (F.sum("odd").over(so_far) - F.col("odd")).alias("before"),
            F.last("state", ignorenulls=True).over(so_far).alias("piece"),
        )
        .where(is_line)
        .select("block", "split", "line", "odd", "text", "before", "piece")
        .withColumn("inside", F.when(F.col("piece.split") == F.col("split"), F.col("piece.inside")).otherwise(missing))
        .withColumn("is_header", F.coalesce(F.col("line") == F.col("piece.header"), F.lit(False)))
        .withColumn("odds_before", F.col("before") - F.col("piece.base"))
        .withColumn("starts", (F.col("odds_before") + F.col("inside").cast("int")) % 2 == 0)
    )
    # The record of a line in its block: a line alone, or all from one odd line to the next.
    alone = F.col("starts") & (F.col("odd") == 0)
    opening = F.col("before") + F.col("starts").cast("int")
    goes_on = F.col("inside") & (F.col("odds_before") == 0)
    is_last = opening == F.col("piece.base") + F.col("piece.odds")
    stays_open = ~goes_on & ~alone & F.col("piece.ends_inside") & is_last
    opened = opened.select(
        "block",
        "split",
        "line",
        "text",
        "is_header",
        F.when(alone, F.col("line")).otherwise(-opening).alias("number"),
        F.when(goes_on, F.col("piece.open_from")).when(stays_open, F.col("piece.first")).alias("owner"),
    )

    def put_together(pieces: DataFrame, *keys: str) -> DataFrame:
        lines = F.array_sort(F.collect_list(F.struct("split", "line", "text")))
        texts = F.transform(lines, lambda p: p["text"])
        return pieces.groupBy(*keys).agg(
            F.array_join(texts, "\n").alias("record"), F.max("is_header").alias("is_header")
        ).select("record", "is_header")

    # Records that end in their block are put together where its lines are.
    records = put_together(opened.where("owner IS NULL"), "block", "number").unionByName(
        put_together(opened.where("owner IS NOT NULL"), "owner")
    )
    mark = F.lit(BYTE_ORDER_MARK)
    bare = F.when(F.col("is_header") & F.startswith("record", mark), F.substring("record", 2, 2**31 - 1))
    return records.withColumn("record", F.coalesce(bare, "record")).where("record <> ''")


def _states(lines: DataFrame) -> DataFrame:
    """(block, split, line, state) for the piece that each block has of each split, with its first line.
    The state: whether the piece starts and ends inside a cell, its number of odd lines and that of the
    pieces before it in the block, the first line of the piece where the record that is open at its
    start was opened, which is the last before with an odd line, and the header of its file, if there."""
    pieces = lines.groupBy("file", "split", "block").agg(
        F.sum("odd").alias("odds"),
        F.min("line").alias("first"),
        F.min(F.when(F.trim("text") != "", F.col("line"))).alias("filled"),
    )
    last_odd = F.when(F.col("odds") > 0, F.col("first"))
    in_file = Window.partitionBy("file").orderBy("split")
    in_split = Window.partitionBy("file", "split").orderBy("block")
    whole_file = in_file.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def before(within: Window, name: str) -> list[Column]:
        """The odd lines of all earlier rows, and the last piece of them that has any."""
        earlier = within.rowsBetween(Window.unboundedPreceding, -1)
        return [
            F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias(f"before_{name}"),
            F.last("last_odd", ignorenulls=True).over(earlier).alias(f"open_{name}"),
        ]

    splits = (
        pieces.groupBy("file", "split")
        .agg(F.sum("odds").alias("odds"), F.max(last_odd).alias("last_odd"), F.min("filled").alias("filled"))
        .select(
            "file",
            "split",
            *before(in_file, "split"),
            F.first("filled", ignorenulls=True).over(whole_file).alias("header"),
        )
    )
    odds_before = F.col("before_split") + F.col("before_piece")
    earlier_in_block = Window.partitionBy("block").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    state = F.struct(
        "split",
        "first",
        "odds",
        F.coalesce(F.sum("odds").over(earlier_in_block), F.lit(0)).alias("base"),
        (odds_before % 2 == 1).alias("inside"),
        ((odds_before + F.col("odds")) % 2 == 1).alias("ends_inside"),
        F.coalesce("open_piece", "open_split").alias("open_from"),
        F.when(F.col("header") == F.col("filled"), F.col("header")).alias("header"),
    )
    return (
        pieces.withColumn("last_odd", last_odd)
        .select("file", "split", "block", "odds", "first", "filled", *before(in_split, "piece"))
        .join(splits, ["file", "split"])
        .select("block", "split", F.col("first").alias("line"), state.alias("state"))
    )


def cells(record: Column, schema: str, mode: str, **options: str) -> Column:
    """The cells of a record as a struct."""
    return F.from_csv(record, schema, {**CELLS, "mode": mode, **options})


def cell_count(record: Column) -> Column:
    """Number of cells: commas outside of quotes, and one."""
    outside = F.regexp_replace(record, '"[^"]*"', "")
    return F.length(outside) - F.length(F.replace(outside, F.lit(","), F.lit(""))) + 1
