"""Inbox KPIs in one pass over the tickets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ticket_cube(tickets: DataFrame) -> DataFrame:
    """Counts by department, language and flag: a few dozen rows however large the inbox is."""
    return tickets.groupBy("department", "language").agg(
        F.count("*").alias("n"), F.count_if(F.col("needs_human")).alias("n_human")
    )


def counts_by(tickets: DataFrame, column: str) -> DataFrame:
    return tickets.groupBy(column).agg(F.count("*").alias("n"))


def analytics(tickets: DataFrame, overrides: DataFrame) -> DataFrame:
    """Long table (metric, key, value): totals, counts by department and language, rates.

    The grouping sets run on the small cube, so rows are not multiplied before aggregation. A
    missing department or language is a group of its own; its key is NULL. The override count joins
    the cube as one more row, which also keeps the totals present for an empty inbox.
    """
    none = F.lit(None).cast("string")
    zero = F.lit(0).cast("bigint")
    logged = overrides.agg(F.count("*").alias("n_overrides")).select(
        none.alias("department"), none.alias("language"), zero.alias("n"), zero.alias("n_human"), "n_overrides"
    )
    rows = (
        ticket_cube(tickets)
        .withColumn("n_overrides", zero)
        .unionByName(logged)
        .groupingSets([["department"], ["language"], []], "department", "language")
        .agg(
            F.grouping("department").alias("g_dept"),
            F.grouping("language").alias("g_lang"),
            *[F.sum(c).alias(c) for c in ("n", "n_human", "n_overrides")],
        )
        .filter("n > 0 OR (g_dept = 1 AND g_lang = 1)")
    )
    total = (F.col("g_dept") == 1) & (F.col("g_lang") == 1)

    def metric(name: str, key, value):
        return F.struct(F.lit(name).alias("metric"), key.alias("key"), value.cast("double").alias("value"))

    rate = lambda part: F.coalesce(F.round(F.try_divide(part.cast("double"), F.col("n")), 3), F.lit(0.0))
    overall = F.array(
        metric("n_tickets", none, F.col("n")),
        metric("n_overrides", none, F.col("n_overrides")),
        metric("n_needs_human", none, F.col("n_human")),
        metric("override_rate", none, rate(F.col("n_overrides"))),
        metric("needs_human_rate", none, rate(F.col("n_human"))),
    )
    one = lambda name, column: F.array(metric(name, F.col(column), F.col("n")))
    metrics = F.when(total, overall).when(F.col("g_lang") == 1, one("by_department", "department")).otherwise(
        one("by_language", "language")
    )
    return rows.select(F.inline(metrics))
