"""Tickets that arrive over time: routed and stored batch by batch, and live counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ticketloom.sources.store import TicketStore


def store_arrivals(
    arriving: DataFrame,
    store: TicketStore,
    route_batch: Callable[[DataFrame], DataFrame],
    checkpoint: str,
    order_by: list[str] | None = None,
) -> StreamingQuery:
    """Route every micro-batch and append it to the inbox.

    Ranking and id assignment are not allowed on a streaming plan, so they run inside the batch. The
    checkpoint folder is the writer's name: a replayed batch replaces itself and keeps its ids, and
    batches of other streams, of a new checkpoint or of uploads are never touched.
    """
    writer = f"stream:{checkpoint.rstrip('/')}"

    def handle(rows: DataFrame, batch_id: int) -> None:
        numbered = store.number(rows, batch_id, order_by, writer)
        store.insert(route_batch(numbered), batch_id, numbered=True, writer=writer)

    return (
        arriving.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def department_counts(tickets: DataFrame, every: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Tickets per time window and department; works on a stream and on a table alike.

    On a stream, tickets that come later than ``late`` after their window are dropped and the
    window's state is freed.
    """
    stamped = tickets.withColumn("created_at", F.col("created_at").cast("timestamp"))
    if tickets.isStreaming:
        stamped = stamped.withWatermark("created_at", late)
    counted = stamped.groupBy(F.window("created_at", every), "department").agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("window_start"), "department", "n")


def publish_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the counts that each micro-batch changed; a replayed batch replaces its own folder.

    What is shown is never deleted while it is rewritten: ``read_counts`` takes the latest of each.
    """

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update")
        .foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """The published counts as they stand: the last one of each window and department."""
    rows = spark.read.schema("window_start timestamp, department string, n bigint, batch bigint").parquet(path)
    return rows.groupBy("window_start", "department").agg(F.max_by("n", "batch").alias("n"))
