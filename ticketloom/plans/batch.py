"""CSV batch job: read an upload, route it, store it, export the predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ticketloom.operators.ids import assign_ids
from ticketloom.operators.inbox import batch_fields
from ticketloom.operators.model import TicketModel
from ticketloom.operators.similar import SimilarIndex
from ticketloom.plans.routing import route
from ticketloom.session import materialize
from ticketloom.sources.files import read_upload_csv, write_csv
from ticketloom.sources.store import TicketStore
from ticketloom.taxonomy import DEFAULT_CHANNEL


def route_upload(
    spark: SparkSession,
    path: str,
    model: TicketModel,
    default_channel: str = DEFAULT_CHANNEL,
    corpus: DataFrame | SimilarIndex | None = None,
    store: TicketStore | None = None,
    export: str | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """Predictions for every row of an uploaded file; blank rows are routed to a human.

    With ``store`` the predictions are also appended to the inbox, with ``export`` written as CSV.
    The rows are routed once: what is stored, exported and returned is read from one written table.
    ``multi_line`` is for files with line breaks inside cells.
    """
    rows = batch_fields(read_upload_csv(spark, path, multi_line), default_channel).select("text", "channel", "ext_id")
    writer = f"upload:{uuid.uuid4().hex}"
    numbered = store.number(rows, 0, writer=writer) if store else assign_ids(rows)
    predictions = materialize(route(numbered, model, corpus), "predictions")
    if store:
        store.insert(predictions, 0, numbered=True, writer=writer)
    if export:
        write_csv(predictions.drop("id"), export)
    return predictions
