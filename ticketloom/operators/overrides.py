"""Officer corrections: an append-only log, and the inbox state it implies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.sla import due_at, sla_hours
from ticketloom.operators.skew import hot_keys, skew_join
from ticketloom.taxonomy import TAXONOMY, Taxonomy

AUDIT_COLUMNS = ["id", "ticket_id", "ts", "pred_dept", "pred_urg", "override_dept", "override_urg", "note"]
ID_BLOCK = 100_000


def check_overrides(corrections: DataFrame, tickets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a correction must name an existing ticket. Only ids of the inbox are read."""
    flagged = _with_ticket(corrections, tickets.select(F.col("id").alias("ticket_id")).withColumn("_hit", F.lit(True)))
    return flagged.filter("_hit").drop("_hit"), flagged.filter("_hit IS NULL").drop("_hit")


def _with_ticket(corrections: DataFrame, tickets: DataFrame, rows_per_salt: int | None = None) -> DataFrame:
    """Left join corrections to ``tickets`` (one row per ticket_id).

    If some ticket is hot, the inbox is first cut down to the tickets named at all, and only those
    few are repeated per salt.
    """
    counts = corrections.groupBy("ticket_id").agg(F.count("*").alias("_n"))
    hot = hot_keys(counts, "ticket_id", "_n", rows_per_salt)
    if hot is not None:
        tickets = tickets.join(counts.select("ticket_id"), "ticket_id", "left_semi")
    return skew_join(corrections, tickets, "ticket_id", hot, F.col("id"), "left")


def latest_override(overrides: DataFrame) -> DataFrame:
    """Last correction per ticket. ``max_by`` combines map-side, so hot tickets stay cheap."""
    last = F.max_by(F.struct("override_dept", "override_urg"), "id").alias("last")
    return overrides.groupBy("ticket_id").agg(last).select("ticket_id", "last.*")


def current_state(tickets: DataFrame, overrides: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """Inbox with corrections applied: labels, SLA and due time change, ``needs_human`` does not.

    The due time counts from the ticket's creation, not from the correction.
    """
    last = latest_override(overrides).withColumnRenamed("ticket_id", "id").withColumn("_changed", F.lit(True))
    changed = F.col("_changed").isNotNull()
    urgency = F.when(changed, F.col("override_urg")).otherwise(F.col("urgency"))
    joined = tickets.join(last, "id", "left")
    return joined.withColumns(
        {
            "department": F.when(changed, F.col("override_dept")).otherwise(F.col("department")),
            "urgency": urgency,
            "sla_hours": F.when(changed, sla_hours(F.col("override_urg"), taxonomy)).otherwise(F.col("sla_hours")),
            "due_at": F.when(changed, due_at(F.col("created_at"), F.col("override_urg"), taxonomy)).otherwise(F.col("due_at")),
            "status": F.when(changed, "overridden").otherwise(F.col("status")),
        }
    ).select(*tickets.columns)


def audit_log(
    corrections: DataFrame,
    tickets: DataFrame,
    id_block: int = ID_BLOCK,
    rows_per_salt: int | None = None,
) -> DataFrame:
    """Audit rows for accepted corrections, each with the labels the ticket had just before it.

    The previous correction is found in two steps, because a single window per ticket would put a
    ticket with very many corrections into one task. Correction ids are unique, so a (ticket, id
    block) group never exceeds ``id_block`` rows; the first row of a block takes the last labels of
    the ticket's previous block.
    """
    original = tickets.select(
        F.col("id").alias("ticket_id"), F.col("department").alias("_dept"), F.col("urgency").alias("_urg")
    ).withColumn("_hit", F.lit(True))
    log = (
        _with_ticket(corrections, original, rows_per_salt)
        .filter("_hit")
        .withColumn("_block", F.floor(F.col("id") / id_block))
    )
    in_block = Window.partitionBy("ticket_id", "_block").orderBy("id")
    after = F.struct("override_dept", "override_urg")
    ends = log.groupBy("ticket_id", "_block").agg(F.max_by(after, "id").alias("_end"))
    carry = ends.select(
        "ticket_id",
        "_block",
        F.lag("_end").over(Window.partitionBy("ticket_id").orderBy("_block")).alias("_carry"),
    )
    original_labels = F.struct(F.col("_dept").alias("override_dept"), F.col("_urg").alias("override_urg"))
    before = F.coalesce(F.col("_prev"), F.col("_carry"), original_labels)
    return (
        log.withColumn("_prev", F.lag(after).over(in_block))
        .join(carry, ["ticket_id", "_block"])
        .withColumn("_before", before)
        .withColumn("pred_dept", F.coalesce(F.col("_before")["override_dept"], F.lit("")))
        .withColumn("pred_urg", F.coalesce(F.col("_before")["override_urg"], F.lit("")))
        .select(*AUDIT_COLUMNS)
    )


def list_overrides(overrides: DataFrame, limit: int = 200) -> DataFrame:
    return overrides.orderBy(F.desc("id")).limit(limit)
