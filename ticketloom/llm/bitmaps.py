"""Membership filters of a fixed size, to leave rows out before a shuffle that joins exactly."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 4 MB. A fuller filter passes more rows; what passes is joined exactly.
BITS = 1 << 25


def position(key: str | Column, bits: int = BITS) -> Column:
    """The bit of a key."""
    return F.xxhash64(key).bitwiseAND(F.lit(bits - 1))


def build(keys: DataFrame, key: str, bits: int = BITS, hashed: bool = False) -> np.ndarray:
    """The bits of all keys, gathered as pages of 4 KB on the executors; a hashed key is its own hash."""
    at = F.col(key).bitwiseAND(F.lit(bits - 1)) if hashed else position(key, bits)
    pages = keys.select(at.alias("at")).groupBy(F.shiftright("at", 15).alias("page"))
    rows = pages.agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for row in rows:  # at most bits / 32768 pages
        page = np.frombuffer(row["bits"], np.uint8)
        out[row["page"] * 4096 : row["page"] * 4096 + page.size] = page
    return out


def test(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which of the positions are set."""
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


def mark(rows: DataFrame, key: str, keys: DataFrame, bits: int = BITS) -> DataFrame:
    """``rows`` with a boolean ``_hit``: true wherever the row's key is among ``keys`` (one column of
    that name), and for few others. The filter has at most bits / 32768 pages of 4 KB; nothing is shuffled.
    """
    at = position(key, bits)
    pages = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 15).alias("_page"))
    pages = pages.agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(F.lit(32767))).alias("_bits"))
    out = rows.withColumn("_at", at).withColumn("_page", F.shiftright("_at", 15)).join(F.broadcast(pages), "_page", "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast((_at & 32767) div 8 as int) + 1, 1)), 16, 10) as int)")
    hit = F.coalesce((byte / F.pow(F.lit(2), F.expr("_at % 8"))).cast("int") % 2 == 1, F.lit(False))
    return out.withColumn("_hit", hit & F.col(key).isNotNull()).drop("_at", "_page", "_bits")
