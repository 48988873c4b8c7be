"""Places of rows in their groups, whatever the size of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradewind.llm.stored import stored


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """Adds ``slot``, the place from 0 in the group by ``order`` (nulls first), and ``n``, the rows of
    the group.

    Rows are sorted into ranges of (groups, order); a row's place is the number of rows of its group
    in earlier ranges plus its place in its own. So no group meets in one task, also if it holds most
    rows or if most rows are equal: equal rows are told apart by a number of their own. ``rows`` must
    not have columns named part_, row_, before_, slot or n."""
    keys = [F.col(c).asc_nulls_first() for c in [*groups, *order]]
    ranged = rows.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(
        *keys, F.col("row_").asc()
    )
    placed = stored(ranged.withColumn("part_", F.spark_partition_id()), "ranges")
    # The groups as columns that are never null, to join on.
    keyed = [F.struct(c).alias(f"{c}_key") for c in groups]
    names = [f"{c}_key" for c in groups]
    earlier = Window.partitionBy(*names).orderBy("part_")
    whole = Window.partitionBy(*names)
    counts = placed.groupBy(*keyed, "part_").agg(F.count("*").alias("rows_"))
    offsets = counts.select(
        *names,
        "part_",
        (F.sum("rows_").over(earlier) - F.col("rows_")).alias("before_"),
        F.sum("rows_").over(whole).alias("n"),
    )
    inside = Window.partitionBy(*names, "part_").orderBy(
        *[F.col(c).asc_nulls_first() for c in order], "row_"
    )
    return (
        placed.select("*", *keyed)
        .join(offsets, [*names, "part_"])
        .withColumn("slot", F.col("before_") + F.row_number().over(inside) - 1)
        .drop(*names, "part_", "row_", "before_")
    )
