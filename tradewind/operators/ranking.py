"""Top rows, last periods, caps: results small enough to read."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tradewind.functions.text import strip_space

DEFAULT_ROWS = 500


@dataclass
class Result:
    """Rows read to the driver, as many as were asked for; a warning if there were more."""

    text: str
    columns: list[str]
    rows: list[Row]
    warnings: list[str] = field(default_factory=list)

    @property
    def row_count(self) -> int:
        return len(self.rows)


def bounded(df: DataFrame, n: int = DEFAULT_ROWS) -> DataFrame:
    """At most ``n`` rows, cut on the outside of the query. Whole results are written."""
    if n < 1:
        raise ValueError(f"row limit must be positive: {n}")
    return df.limit(n)


def bounded_result(df: DataFrame, n: int = DEFAULT_ROWS, text: str = "") -> Result:
    """The one place where rows reach the driver: ``n`` of them, and whether there are more."""
    if n < 1:
        raise ValueError(f"row limit must be positive: {n}")
    rows = bounded(df, n + 1).collect()
    more = [f"only the first {n} rows are shown"] if len(rows) > n else []
    return Result(text, list(df.columns), rows[:n], more)


def newest(df: DataFrame, time: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` latest rows; rows without a time count as newest. ``ties`` order rows of
    the same time so that the choice is the same in every run."""
    return df.orderBy(F.col(time).desc_nulls_first(), *ties).limit(n)


def top_by(df: DataFrame, measure: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.col(measure).desc_nulls_first(), *ties).limit(n)


def last_periods(df: DataFrame, period: str, n: int = 12) -> DataFrame:
    """The last ``n`` periods of a series, oldest first."""
    return df.orderBy(F.col(period).desc()).limit(n).orderBy(period)


def between_optional(
    df: DataFrame, column: str, low: date | str | None, high: date | str | None
) -> DataFrame:
    """Inclusive range; a bound that is not given puts no condition in the plan."""
    if low is not None:
        df = df.where(F.col(column) >= F.lit(str(low)).cast("date"))
    if high is not None:
        df = df.where(F.col(column) <= F.lit(str(high)).cast("date"))
    return df


def first_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """The first ``n`` rows of each group with their rank. Spark keeps only ``n`` rows per
    group in every map task before it shuffles, so a hot group stays small."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def conversation_context(
    df: DataFrame,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    n: int = 6,
    width: int | None = None,
) -> DataFrame:
    """The last ``n`` turns of each conversation as ``ROLE: text`` lines, oldest first.
    Turns without role or text are dropped after the cut to ``n``. Texts stay whole; only a
    caller's ``width`` cuts them, before they are shuffled."""
    said = strip_space(text) if width is None else F.substring(strip_space(text), 1, width)
    turns = df.select(conversation, turn, F.col(role).alias("_role"), said.alias("_said"))
    last = first_per_group(turns, [conversation], [F.col(turn).desc()], n)
    line = F.concat(F.upper("_role"), F.lit(": "), F.col("_said"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(turn), line.alias("line"))))
    return (
        last.where((F.length("_role") > 0) & (F.length("_said") > 0))
        .groupBy(conversation)
        .agg(
            F.count("*").alias("n_turns"),
            F.array_join(ordered["line"], "\n").alias("context"),
        )
    )
