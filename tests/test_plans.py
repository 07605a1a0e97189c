"""Physical plans that the design relies on."""

from contextlib import redirect_stdout
from io import StringIO

import pytest
from pyspark.sql import functions as F

from ticketloom.operators import inbox
from ticketloom.operators.ids import assign_ids, places_in_order
from ticketloom.operators.split import stratified_split
from ticketloom.functions import normalize
from ticketloom.operators.similar import _representatives, append_index, read_index, save_index, search_index, similar_tickets
from ticketloom.operators.overrides import latest_override
from ticketloom.plans.routing import route
from ticketloom.plans.training import train
from ticketloom.sources.store import TicketStore
from ticketloom.sources.synthetic import generate


def plan(df):
    out = StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = TicketStore(spark, str(tmp_path_factory.mktemp("plans")))
    rows = generate(spark, 300).drop("id").withColumn("created_at", F.col("timestamp"))
    store.insert(rows, order_by=["created_at", "text"])
    return store


def test_routing_without_corpus_moves_no_row(spark, stored):
    labelled = stored.raw_tickets()
    model, _ = train(labelled.select("id", "text", "department", "urgency", "language"))
    text = plan(route(stored.raw_tickets().select("id", "text", "channel"), model))
    assert "hashpartitioning" not in text and "rangepartitioning" not in text and "SinglePartition" not in text
    assert "BroadcastHashJoin" in text and "NestedLoop" not in text and "Cartesian" not in text


def test_routing_a_batch_reads_no_text_of_the_indexed_corpus(spark, stored, tmp_path):
    past = stored.raw_tickets().select("id", "text", "department", "urgency", "language").withColumn("norm", normalize(F.col("text")))
    model, _ = train(past)
    save_index(past.filter("id <= 200"), f"{tmp_path}/index")
    append_index(past.filter("id > 200"), f"{tmp_path}/index")
    batch = spark.createDataFrame([(1001, "payment failed for my order"), (1002, "")], "id bigint, text string")
    index = read_index(spark, f"{tmp_path}/index")
    found = {r.id: len(r.similar) for r in route(batch, model, index).select("id", "similar").collect()}
    assert found == {1001: 3, 1002: 0}
    for df in (index.vectors, index.summary, index.lists, index.reps, index.pool):
        text = plan(df)
        assert f"{tmp_path}/index" in text and stored.root not in text
    whole = search_index(batch.withColumn("norm", F.col("text")), index).orderBy("query_id", "rank").collect()
    vocab = index.vocab
    assert whole == similar_tickets(batch.withColumn("norm", F.col("text")), past, 3, vocab=vocab).orderBy("query_id", "rank").collect()


def test_numbering_sorts_no_text(spark, stored):
    placed = stored.raw_tickets().select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    text = plan(places_in_order(placed, ["created_at", "ext_id"]))
    read = text.split("ReadSchema:")[1].split("\n")[0]
    assert "text" not in read and "reply" not in read and "created_at" in read
    text = plan(assign_ids(stored.raw_tickets().drop("id")))
    # only the counts per file move
    assert "rangepartitioning" not in text and text.count("hashpartitioning") == text.count("hashpartitioning(_file") == 1
    assert "SortMergeJoin" not in text and "BroadcastHashJoin" in text


def test_split_reads_the_rows_once(spark, stored):
    text = plan(stratified_split(stored.raw_tickets().select("id", "department", "text")))
    assert text.split("== Physical Plan ==")[1].split("\n\n")[0].count("Scan parquet") == 1 and "Window" not in text


def test_inbox_listing_pushes_filters_and_takes_top_rows(spark, stored):
    rows = inbox.list_tickets(stored.raw_tickets(), F.lit("2026-10-01").cast("timestamp"), department="Feedback / General")
    text = plan(inbox.keep_columns(rows, ["id", "department", "urgency", "sla_remaining_min"]))
    assert "TakeOrderedAndProject" in text and "EqualTo(department,Feedback / General)" in text
    read = text.split("ReadSchema:")[1].split("\n")[0]
    assert "text" not in read and "reply" not in read and "extra" not in read


def test_latest_override_combines_before_the_shuffle(spark, stored):
    text = plan(latest_override(stored.overrides()))
    assert "partial_max_by" in text and "Window" not in text


def test_representatives_are_limited_before_the_shuffle(spark):
    rows = spark.range(10).select("id", (F.col("id") % 2).alias("vec"), (F.col("id") % 4).alias("text_key"), F.lit("p").alias("payload"))
    text = plan(_representatives(rows, 3))
    assert text.count("WindowGroupLimit") >= 2 and "Partial" in text
