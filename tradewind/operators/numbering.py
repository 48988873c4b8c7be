"""Row numbers over a whole frame without bringing its rows together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradewind.session import shared_folder

# Ranges whose counts are summed in one group.
RANGES = 256


def row_numbers(df: DataFrame, order: Sequence[Column | str], name: str = "idx") -> DataFrame:
    """Adds the place from 1 of each row by ``order``; rows that are equal in it keep the order they
    are read in.

    Rows are sorted into ranges, which are written to the shared folder, so that counting and
    numbering see the same ones. A row's number is the count of all earlier ranges plus its place in
    its own; the counts are running sums in groups of ``RANGES`` and the sums of the groups before.
    No task sees more than a range or a group of counts. An empty frame stays empty."""
    spark = df.sparkSession
    path = shared_folder(spark, "row-numbers")
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    last = F.col("_read")
    ranged = df.withColumn("_read", F.monotonically_increasing_id()).repartitionByRange(*keys, last)
    ranged.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)

    group = F.floor(F.col("_range") / RANGES).alias("_group")
    counts = rows.groupBy("_range", group).agg(F.count("*").alias("_rows"))
    sums = counts.groupBy("_group").agg(F.sum("_rows").alias("n"))
    groups = sums.agg(F.collect_list(F.struct("_group", "n")).alias("groups")).scalar()
    running = Window.partitionBy("_group").orderBy("_range")
    earlier = F.aggregate(
        F.filter("_groups", lambda s: s["_group"] < F.col("_group")),
        F.lit(0).cast("bigint"),
        lambda total, s: total + s["n"],
    )
    offsets = (
        counts.withColumn("_groups", groups)
        .withColumn("_before", F.sum("_rows").over(running) - F.col("_rows") + earlier)
        .select("_range", "_before")
    )
    inside = Window.partitionBy("_range").orderBy(*keys, last)
    numbered = rows.join(F.broadcast(offsets), "_range")
    return numbered.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop(
        "_range", "_before", "_read"
    )
