"""Gap-free sequential ids for appended rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.session import materialize

ROW_BITS = 33


def _offsets(rows: DataFrame, part: str) -> DataFrame:
    """(part, _offset): rows in the parts before; one row per part."""
    ahead = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    return rows.groupBy(part).agg(F.count("*").alias("_n")).select(part, F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_offset"))


def places_in_order(placed: DataFrame, order_by: list[str]) -> DataFrame:
    """(_file, _row, _m): where each row of a written table lies, and (partition, position) in the order.

    The order columns are sorted without the rest of the rows, and are not kept.
    """
    keys = placed.select("_file", "_row", *[F.col(c) for c in order_by if c not in ("_file", "_row")])
    return keys.orderBy(*order_by).select("_file", "_row", F.monotonically_increasing_id().alias("_m"))


def assign_ids(rows: DataFrame, base: int = 0, order_by: list[str] | None = None, id_col: str = "id") -> DataFrame:
    """Number the rows base+1, base+2, ... without a single-partition window."""
    return number_rows(rows, base, order_by, id_col)[0]


def number_rows(rows: DataFrame, base: int = 0, order_by: list[str] | None = None, id_col: str = "id") -> tuple[DataFrame, int]:
    """The rows as ``assign_ids`` numbers them, and how many they are, which the written table tells without a join.

    The rows are written once, which gives each a fixed place: file and position. Without an order the
    id is that position behind the rows of the files before, and no row moves. With an order only the
    order columns and the places are sorted and written; ids come from the counts of the sorted
    partitions and are joined back by place. The order columns should end in a unique one.
    """
    within = F.col("_m").bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    if order_by and set(rows.columns) <= set(order_by):
        # The rows are nothing but their order columns: the sorted table itself is numbered.
        ordered = materialize(rows.orderBy(*order_by).withColumn("_m", F.monotonically_increasing_id()), "ordered")
        ordered = ordered.withColumn("_part", F.shiftright("_m", ROW_BITS))
        numbered = ordered.join(F.broadcast(_offsets(ordered, "_part")), "_part")
        return numbered.withColumn(id_col, F.lit(base) + F.col("_offset") + within + 1).drop("_m", "_part", "_offset"), ordered.count()
    placed = materialize(rows, "unnumbered").select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))

    def number(position: Column) -> Column:
        return F.lit(base) + F.col("_offset") + position + 1

    if not order_by:
        numbered = placed.join(F.broadcast(_offsets(placed, "_file")), "_file").withColumn(id_col, number(F.col("_row")))
        return numbered.drop("_file", "_row", "_offset"), placed.count()
    sorted_places = materialize(places_in_order(placed, order_by), "places").withColumn("_part", F.shiftright("_m", ROW_BITS))
    ids = sorted_places.join(F.broadcast(_offsets(sorted_places, "_part")), "_part")
    ids = ids.select("_file", "_row", number(within).alias("_id"))
    numbered = placed.join(ids, ["_file", "_row"]).withColumn(id_col, F.col("_id")).drop("_file", "_row", "_id")
    return numbered, sorted_places.count()


def max_id(rows: DataFrame, id_col: str = "id") -> int:
    return rows.agg(F.coalesce(F.max(id_col), F.lit(0))).first()[0]
