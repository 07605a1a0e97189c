"""Ticket-shaped tables derived from the given ones by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import detect_language, normalize
from ticketloom.operators.inbox import insert_defaults
from ticketloom.sources.synthetic import event_tickets
from ticketloom.taxonomy import TAXONOMY

AS_OF = "2024-01-20 12:00:00"
ORDERS_AS_OF = "1998-01-01 00:00:30"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return event_tickets(events)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def inbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored tickets: detected language, a derived confidence, defaults, SLA and status."""
    confidence = F.round(F.lit(0.30) + F.pmod(F.col("id") * 13, F.lit(70)) / 100.0, 2)
    rows = tickets(spark, sf_dir).withColumns({"language": detect_language(F.col("text")), "confidence": confidence})
    return insert_defaults(rows.withColumn("needs_human", F.col("confidence") < TAXONOMY.abstain_threshold))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Officer corrections from error events. A third name one ticket, some name none that exists."""
    pick = lambda names, i: F.get(F.array(*[F.lit(x) for x in names]), i.cast("int"))
    ev = read(spark, sf_dir, "events").filter(F.col("event_type") == "error")
    target = F.when(F.col("user_id") % 3 == 0, F.lit(0)).otherwise(2 * F.col("event_id") - F.col("user_id"))
    return ev.select(
        F.col("event_id").alias("id"),
        target.cast("bigint").alias("ticket_id"),
        (F.col("ts") + F.make_dt_interval(days=F.lit(1))).alias("ts"),
        pick(TAXONOMY.departments, F.pmod(F.col("event_id") + F.col("user_id"), F.lit(7))).alias("override_dept"),
        pick(TAXONOMY.urgencies, F.pmod(F.floor("value"), F.lit(4))).alias("override_urg"),
        F.concat(F.lit("note "), F.col("event_id").cast("string")).alias("note"),
    )


def answers(drafts: DataFrame) -> DataFrame:
    """Rewriting-service answers for tickets with a template reply: good, fenced, wrapped and broken ones.

    Tickets that came by e-mail have none.
    """
    kind = F.pmod(F.col("id"), F.lit(9))
    reply = F.to_json(F.struct(F.concat(F.lit("Rewritten: "), F.col("template_reply")).alias("suggested_reply"), F.lit("clearer").alias("rationale")))
    late = F.to_json(F.struct(F.lit("We answer within 99 hours.").alias("suggested_reply"), F.lit("x").alias("rationale")))
    raw = (
        F.when(kind == 0, reply)
        .when(kind == 1, F.concat(F.lit("```json\n"), reply, F.lit("\n```")))
        .when(kind == 2, F.concat(F.lit("Sure! "), reply, F.lit(" Hope it helps.")))
        .when(kind == 3, late)
        .when(kind == 4, F.lit("[1, 2]"))
        .when(kind == 5, F.lit("{}"))
        .when(kind == 6, F.lit('{"suggested_reply": "  ", "rationale": "none"}'))
        .when(kind == 7, F.lit("no json here"))
    )
    error = F.when(kind == 8, F.lit("TimeoutError: read timed out"))
    return drafts.filter(F.col("channel") != "email").select("id", F.lit("groq").alias("backend"), raw.alias("raw"), error.alias("error"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tickets(spark, sf_dir).withColumn("norm", normalize(F.col("text")))
