"""Look-ups of a dimension from a fact whose keys may be very uneven."""

from __future__ import annotations

from pyspark.sql import DataFrame


def lookup(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """``fact`` left join ``dim`` on ``key``, all facts kept.

    A plain join: one scan and one shuffle of the facts at most. Spark ships the dimension to the
    facts if it is below the broadcast threshold; otherwise the adaptive plan cuts the
    partition of a hot key, and that of the rows without a key, into parts of the advisory
    size and gives each the same rows of the dimension."""
    return fact.join(dim, key, "left")
