"""A set of 64-bit hashes as a bitmap of fixed size that tasks filter by.

Members are always found; others pass too, more of them the fuller the bitmap is. So it may only
stand before an exact step, and its size is a parameter that does not depend on the data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# 16 MB.
BITS = 27


def bitmap_of(hashes: DataFrame, column: str, bits: int = BITS):
    """Broadcast bytes of the bitmap; the driver holds 2^bits / 8 bytes at most."""
    # The bitmap functions count from 1.
    place = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    pieces = (
        hashes.select(place.alias("place"))
        .groupBy(F.bitmap_bucket_number("place").alias("piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bytes"))
    )
    whole = np.zeros(1 << (bits - 3), np.uint8)
    for row in pieces.toLocalIterator():
        at = (row["piece"] - 1) * 4096
        whole[at : at + 4096] = np.frombuffer(bytes(row["bytes"]), np.uint8)[: len(whole) - at]
    return hashes.sparkSession.sparkContext.broadcast(whole.tobytes())


def members(bitmap: bytes, hashes: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bitmap, np.uint8)
    place = hashes & np.uint64(len(table) * 8 - 1)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1
