"""Bloom filter of bounded size, built by Spark and tested inside tasks.

It only spares work: a hit is looked up in a join afterwards, so a filter too
small for its keys lets more rows through and changes no result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 1 << 23  # 1 MB, whatever the number of keys


def build(keys: DataFrame, column: str, bits: int = BITS) -> np.ndarray:
    """The filter's words; ``column`` holds longs that are already well mixed.

    At most ``bits / 64`` rows come to the driver.
    """
    slots = F.array(F.col(column).bitwiseAND(F.lit(bits - 1)),
                    F.shiftrightunsigned(F.col(column), 32).bitwiseAND(F.lit(bits - 1)))
    rows = (keys.where(F.col(column).isNotNull()).select(F.explode(slots).alias("slot"))
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toPandas())
    words = np.zeros(bits // 64, dtype=np.int64)
    words[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return words.view(np.uint64)


def contains(words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (int64) may be in the filter."""
    keys, mask = keys.astype(np.int64).view(np.uint64), np.uint64(len(words) * 64 - 1)
    found = np.ones(len(keys), dtype=bool)
    for slot in (keys & mask, (keys >> np.uint64(32)) & mask):
        found &= (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
    return found
