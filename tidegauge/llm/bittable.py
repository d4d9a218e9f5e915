"""A fixed-size bit table: a filter that never loses a wanted key and never grows.

Every wanted key sets one bit out of ``2 ** BITS``.  The table has a proven size (2 MB at
the default), whatever the data, so it may be sent to all tasks; it only lets rows drop
early.  The join that follows decides, so a full table costs time, never rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 24


def slot(key: Column, bits: int = BITS) -> Column:
    """The bit of a long key."""
    return F.pmod(key, F.lit(1 << bits))


def collect_bits(keys: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """The table as 2^bits / 64 longs; Spark ORs the bits, at most that many rows arrive."""
    at = slot(F.col(key), bits)
    words = (
        keys.where(F.col(key).isNotNull())
        .select(F.floor(at / 64).cast("int").alias("w"), F.expr(f"shiftleft(1L, cast(pmod({key}, 64) as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    )
    table = np.zeros((1 << bits) // 64, dtype=np.int64)
    frame = words.toArrow()
    table[frame.column("w").to_numpy()] = frame.column("b").to_numpy()
    return table


def member(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key (int64) may be wanted."""
    at = keys.astype(np.int64) & (len(table) * 64 - 1)
    return (table[at >> 6] >> (at & 63)) & 1 == 1
