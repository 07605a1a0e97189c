"""Inbox and override log as Parquet tables that are written in batches.

Each batch is a partition (writer, batch) and written with dynamic partition overwrite: the same batch
written again replaces only itself, and no other batch is touched. A second small table holds the id
range of every batch. A new range starts behind the largest one; it counts once no other batch turns
out to have claimed the same ids, so of two writers that number at the same moment at least one moves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from ticketloom.operators.ids import number_rows
from ticketloom.operators.inbox import insert_defaults
from ticketloom.operators.overrides import AUDIT_COLUMNS, audit_log, check_overrides, current_state
from ticketloom.taxonomy import TAXONOMY, Taxonomy

RANKED = "array<struct<label:string,p:double>>"
HITS = "array<struct<text:string,department:string,urgency:string,language:string,score:double>>"
# The columns of the two tables.
INBOX_SCHEMA = (
    "id bigint, ext_id string, created_at timestamp, text string, channel string, language string, department string, "
    "urgency string, confidence double, needs_human boolean, source string, reply string, sla_hours int, "
    "due_at timestamp, status string, "
    f"extra struct<department_top3:{RANKED},urgency_top3:{RANKED},rationale:string,similar:{HITS},explain:array<string>>"
)
OVERRIDE_SCHEMA = (
    "id bigint, ticket_id bigint, ts timestamp, pred_dept string, pred_urg string, override_dept string, "
    "override_urg string, note string"
)
SCHEMAS = {"tickets": INBOX_SCHEMA, "overrides": OVERRIDE_SCHEMA}
RANGE_SCHEMA = "first bigint, n bigint"
BATCH = ["writer", "batch"]
CLAIMS = 20
Key = tuple[str, int]


class TicketStore:
    def __init__(self, spark: SparkSession, root: str, taxonomy: Taxonomy = TAXONOMY):
        self.spark, self.root, self.taxonomy = spark, root.rstrip("/"), taxonomy
        for table, schema in SCHEMAS.items():
            for part, columns in (("rows", schema), ("ranges", RANGE_SCHEMA)):
                empty = spark.createDataFrame([], f"{columns}, writer string, batch bigint")
                empty.write.mode("ignore").partitionBy(*BATCH).parquet(f"{self.root}/{table}/{part}")

    def _read(self, table: str, part: str) -> DataFrame:
        columns = SCHEMAS[table] if part == "rows" else RANGE_SCHEMA
        return self.spark.read.schema(f"{columns}, writer string, batch bigint").parquet(f"{self.root}/{table}/{part}")

    def _replace(self, table: str, part: str, rows: DataFrame, key: Key) -> None:
        placed = rows.withColumns({"writer": F.lit(key[0]), "batch": F.lit(key[1]).cast("bigint")})
        out = placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(*BATCH).parquet(f"{self.root}/{table}/{part}")

    def _table(self, table: str) -> DataFrame:
        return self._read(table, "rows").filter("id IS NOT NULL").drop(*BATCH)

    @staticmethod
    def _is(key: Key) -> Column:
        return (F.col("writer") == key[0]) & (F.col("batch") == key[1])

    def _range(self, table: str, key: Key) -> Row | None:
        """The id range that the batch has claimed."""
        return self._read(table, "ranges").filter(self._is(key)).first()

    def _alone(self, table: str, key: Key, first: int, n: int) -> bool:
        """Whether no other batch claims one of the ids."""
        last = F.col("first") + F.col("n") - 1
        others = self._read(table, "ranges").filter(~self._is(key))
        return others.filter((F.col("first") <= first + n - 1) & (last >= first)).isEmpty()

    def _first_id(self, table: str, key: Key, n: int) -> int:
        """First of the batch's ``n`` ids; the same ids again if it is written again with as many rows."""
        own = self._range(table, key)
        if own and own["n"] == n and self._alone(table, key, own["first"], n):
            return own["first"]
        for _ in range(CLAIMS):
            last = F.max(F.col("first") + F.col("n") - 1)
            first = 1 + self._read(table, "ranges").agg(F.coalesce(last, F.lit(0))).first()[0]
            self._replace(table, "ranges", self.spark.createDataFrame([(first, n)], RANGE_SCHEMA), key)
            if self._alone(table, key, first, n):
                return first
        raise RuntimeError(f"other writers claimed the same ids {CLAIMS} times; write the batch again")

    @staticmethod
    def _key(writer: str | None, batch_id: int | None) -> Key:
        """The batch's key; without a writer, one that no other batch has."""
        return (writer or ("default" if batch_id is not None else uuid.uuid4().hex), batch_id or 0)

    def _number(self, table: str, rows: DataFrame, key: Key, order_by: list[str] | None) -> DataFrame:
        """Ids from the range that is kept for this batch."""
        numbered, n = number_rows(rows, 0, order_by)
        first = self._first_id(table, key, n)
        return numbered.withColumn("id", F.col("id") + F.lit(first - 1))

    def _write(self, table: str, rows: DataFrame, key: Key) -> DataFrame:
        written = Observation()
        schema = self.spark.createDataFrame([], SCHEMAS[table]).schema
        self._replace(table, "rows", rows.to(schema).observe(written, F.count(F.lit(1)).alias("n")), key)
        if not written.get.get("n"):
            # Without rows nothing would be overwritten; a row without id stands for the empty batch.
            empty = self.spark.createDataFrame([tuple(None for _ in schema)], schema)
            self._replace(table, "rows", empty, key)
        return self._read(table, "rows").filter(self._is(key) & F.col("id").isNotNull()).drop(*BATCH)

    def number(self, arriving: DataFrame, batch_id: int, order_by: list[str] | None = None, writer: str | None = None) -> DataFrame:
        """Give arriving rows their ticket ids. Done before routing, the sort reads raw rows only."""
        return self._number("tickets", arriving, self._key(writer, batch_id), order_by)

    def raw_tickets(self) -> DataFrame:
        """Tickets as inserted."""
        return self._table("tickets")

    def overrides(self) -> DataFrame:
        return self._table("overrides")

    def tickets(self) -> DataFrame:
        """Current inbox: inserted tickets with the last correction of each applied."""
        return current_state(self.raw_tickets(), self.overrides(), self.taxonomy)

    def insert(
        self,
        predictions: DataFrame,
        batch_id: int | None = None,
        order_by: list[str] | None = None,
        numbered: bool = False,
        writer: str | None = None,
    ) -> DataFrame:
        """Append routed tickets; returns the stored rows with their ids.

        ``numbered`` rows went through ``number`` and keep their ``id``; others get new ids here.
        ``created_at`` is taken from the rows if present, else it is the time of this batch. A
        ``batch_id`` makes the write repeatable: the same writer and id replace that batch alone.
        """
        key = self._key(writer, batch_id)
        rows = predictions if numbered else predictions.drop("id")
        if "created_at" not in rows.columns:
            rows = rows.withColumn("created_at", F.current_timestamp())
        if "extra" not in rows.columns:
            fields = {"department_top3": RANKED, "urgency_top3": RANKED, "rationale": "string", "similar": HITS, "explain": "array<string>"}
            parts = [
                (F.col(f) if f in rows.columns else F.lit(None)).cast(kind).alias(f) for f, kind in fields.items()
            ]
            rows = rows.withColumn("extra", F.struct(*parts))
        if "suggested_reply" in rows.columns:
            rows = rows.withColumnRenamed("suggested_reply", "reply")
        fields = [f for f in self.spark.createDataFrame([], INBOX_SCHEMA).schema if f.name != "id"]
        names = [f.name for f in fields]
        absent = {f.name: F.lit(None).cast(f.dataType) for f in fields if f.name not in rows.columns}
        filled = insert_defaults(rows.withColumns(absent), self.taxonomy)
        keep = names + [c for c in ["id", *(order_by or [])] if c in filled.columns and c not in names]
        kept = filled.select(*keep).withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "due_at")})
        if not numbered:
            kept = self._number("tickets", kept, key, order_by)
        return self._write("tickets", kept, key)

    def override(
        self, corrections: DataFrame, batch_id: int | None = None, writer: str | None = None
    ) -> tuple[DataFrame, DataFrame]:
        """Log corrections (id = arrival order, ticket_id, ts, override_dept, override_urg, note).

        Returns (logged audit rows, rejected corrections that name no ticket). Each audit row holds
        the labels the ticket had just before; a batch that is written again is compared with what
        was logged before it, not with itself. Labels that a caller saw may be given as pred_dept and
        pred_urg; where they aren't null they are logged instead.
        """
        key = self._key(writer, batch_id)
        own, logged = self._range("overrides", key), self.overrides()
        before = logged.filter(F.col("id") < own["first"]) if own else logged
        now = current_state(self.raw_tickets(), before, self.taxonomy)
        _, rejected = check_overrides(corrections, now)
        given = [c for c in ("pred_dept", "pred_urg") if c in corrections.columns]
        log = audit_log(corrections.drop(*given), now).withColumnRenamed("id", "_arrival")
        if given:
            seen = corrections.select(F.col("id").alias("_arrival"), *[F.col(c).alias(f"_{c}") for c in given])
            log = log.join(seen, "_arrival", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in given})
        columns = [c for c in AUDIT_COLUMNS if c != "id"]
        numbered = self._number("overrides", log.select("_arrival", *columns), key, ["_arrival"])
        return self._write("overrides", numbered, key), rejected

    def snapshot(self, path: str) -> None:
        """Write the current inbox as a plain table for readers that should not replay the log."""
        self.tickets().write.mode("overwrite").parquet(path)
