"""Service-level columns. The four-entry lookup is a literal map, so no join is needed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ticketloom.taxonomy import DEFAULT_SLA_HOURS, TAXONOMY, Taxonomy

MICROS_PER_MINUTE = 60_000_000


def _lookup(key: Column, table: dict, default: Column) -> Column:
    out = default
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def sla_hours(urgency: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    return _lookup(urgency, taxonomy.sla_hours, F.lit(DEFAULT_SLA_HOURS)).cast("int")


def urgency_label(urgency: Column, taxonomy: Taxonomy = TAXONOMY, default: Column | None = None) -> Column:
    return _lookup(urgency, taxonomy.urgency_label, F.lit("") if default is None else default)


def urgency_display(urgency: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    return F.concat(urgency, F.lit(" ("), urgency_label(urgency, taxonomy), F.lit(")"))


def due_at(created_at: Column, urgency: Column, taxonomy: Taxonomy = TAXONOMY) -> Column:
    return created_at + F.make_dt_interval(hours=sla_hours(urgency, taxonomy))


def sla_remaining_min(due: Column, as_of: Column) -> Column:
    """Whole minutes left, rounded down (negative once overdue); NULL without a due date.

    ``as_of`` is a column so that a report gives the same numbers when it is run again.
    """
    micros = F.unix_micros(due.cast("timestamp")) - F.unix_micros(as_of.cast("timestamp"))
    return F.floor(micros / MICROS_PER_MINUTE)
