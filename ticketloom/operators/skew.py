"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000


def hot_keys(counts: DataFrame, key: str, n: str, rows_per_salt: int | None = None) -> DataFrame | None:
    """Keys with more rows than a thousandth of the total, and the number of salts they need.

    ``counts`` has one row per key. At most a thousand keys can pass the test, so they may be
    collected and broadcast. None when no key is hot, which one small job finds out.
    """
    total, largest = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    limit = max(-(-total // MAX_HOT_KEYS), rows_per_salt or 1)
    if largest <= limit:
        return None
    salts = F.ceil(F.col(n) / F.lit(limit)).cast("int").alias("_salts")
    found = counts.filter(F.col(n) > limit).select(key, salts)
    return counts.sparkSession.createDataFrame(found.collect(), found.schema)


def skew_join(
    big: DataFrame,
    unique: DataFrame,
    key: str,
    hot: DataFrame | None,
    spread: Column,
    how: str = "inner",
) -> DataFrame:
    """Join ``big`` to ``unique`` (one row per key), spreading the hot keys of ``big`` over salts.

    ``spread`` is any column that varies inside a hot key, normally the row id. Rows of ``unique``
    are repeated only for hot keys, once per salt. Without hot keys this is a plain join. Both sides are
    shuffled: a small file of compressed texts or vectors may be far too large to broadcast.
    """
    if hot is None:
        return big.join(unique.hint("merge"), key, how)
    hot = F.broadcast(hot)
    left = (
        big.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(spread), F.coalesce(F.col("_salts"), F.lit(1))).cast("int"))
        .drop("_salts")
    )
    right = (
        unique.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)))
        .drop("_salts")
    )
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")
