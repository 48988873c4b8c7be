"""Cleaning, casting and exact arithmetic as Column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters of a number in a text cell. Java also reads "1d" and "0x1p3", which are none.
NUMBER_CHARACTERS = "0123456789+-.eE \t\r\n"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str, case: str | None = None) -> Column:
    """Strip spaces on both sides (tabs stay), then fold the case if asked."""
    trimmed = F.trim(col(c))
    if case is None:
        return trimmed
    return {"lower": F.lower, "upper": F.upper}[case](trimmed)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def typed(c: Column | str, data_type: str, strict: bool = True) -> Column:
    """Blank is NULL; a malformed value fails the job, or is NULL when not ``strict``."""
    value = blank_to_null(c)
    return value.cast(data_type) if strict else value.try_cast(data_type)


def first_of_month(c: Column | str) -> Column:
    """First day of the month as a date."""
    return F.trunc(col(c), "MM")


def quotient(numerator: Column, denominator: Column, scale: int) -> Column:
    """Decimal over count, rounded half away from zero; NULL over zero."""
    return F.round(numerator / F.nullif(denominator, F.lit(0)), scale)


def rate(part: Column, whole: Column) -> Column:
    """Share of two counts to four places."""
    return quotient(part.cast("decimal(20,0)"), whole, 4).cast("decimal(9,4)")


def mean2(c: Column | str) -> Column:
    """Average rounded once to two places. ``avg`` of a decimal rounds to six places first,
    so the sum is divided by the count instead."""
    total = F.sum(col(c)).cast("decimal(24,2)")
    return quotient(total, F.count(col(c)), 2).cast("decimal(14,2)")


def as_number(c: Column | str, data_type: str) -> Column:
    """The value as double, or NULL when it is no number, as NaN is none. ``data_type`` is
    the column's type name; only numbers, booleans and number-like text qualify."""
    value = col(c)
    if data_type == "string":
        odd = F.translate(value, NUMBER_CHARACTERS, "")
        return F.when(odd == "", value).try_cast("double")
    if data_type == "boolean":
        return value.cast("int").cast("double")
    if data_type in {"float", "double"}:
        return F.nullif(value.cast("double"), F.lit(float("nan")))
    if is_numeric_type(data_type):
        return value.cast("double")
    return F.lit(None).cast("double")


def is_numeric_type(data_type: str) -> bool:
    return data_type.startswith("decimal") or data_type in {
        "tinyint", "smallint", "int", "bigint", "float", "double",
    }


def as_label(c: Column | str, data_type: str) -> Column:
    """Display text of a key; NULL is its own key called ``None``."""
    text = col(c).cast("string")
    if data_type == "boolean":
        text = F.initcap(text)
    return F.coalesce(text, F.lit("None"))


def stable_id(c: Column | str) -> Column:
    """Id of a text: the first 15 hexadecimal digits of its md5 as a bigint."""
    return F.conv(F.substring(F.md5(col(c)), 1, 15), 16, 10).cast("bigint")
