"""One function per query: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ticketloom.catalog import tables
from ticketloom.functions import (
    detect_language,
    due_at,
    latin_ratio,
    lexicon_hits,
    normalize,
    preview,
    sla_hours,
    sla_remaining_min,
    snippet,
    token_highlight,
    urgency_display,
)
from ticketloom.operators import evaluate, inbox, kpi, overrides, replies, split, tfidf
from ticketloom.operators.ids import assign_ids
from ticketloom.operators.keywords import keyword_department, keyword_hits
from ticketloom.operators.model import fit, fit_counts
from ticketloom.operators.similar import append_index, read_index, save_index, search_index, similar_tickets
from ticketloom.plans.routing import route
from ticketloom.plans.training import train
from ticketloom.session import computed_once, cut_lineage, shared_dir
from ticketloom.sources.files import pack_extra, read_labelled_csv, read_upload_csv, read_upload_with_rejects, unpack_extra, write_csv
from ticketloom.sources.store import TicketStore
from ticketloom.sources.synthetic import event_tickets
from ticketloom.streaming.arrivals import department_counts, publish_counts, read_counts, store_arrivals
from ticketloom.taxonomy import DEPARTMENT_KEYWORDS, TAXONOMY


def as_of(text: str = tables.AS_OF):
    return F.lit(text).cast("timestamp_ntz")


def ticket_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tickets(spark, sf_dir)
    per_group = rows.groupBy("department", "language", "urgency").agg(
        F.count("*").alias("n"), F.min("created_at").alias("first_created")
    )
    return per_group.select(
        "department",
        "language",
        urgency_display(F.col("urgency")).alias("urgency"),
        sla_hours(F.col("urgency")).alias("sla_hours"),
        "n",
        due_at(F.col("first_created"), F.col("urgency")).alias("first_due"),
    )


def routed_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: tickets by routed department, detected language and urgency with the next deadline."""
    rows = tables.tickets(spark, sf_dir)
    text = F.col("text")
    return (
        rows.select(
            keyword_department(text).alias("routed"),
            detect_language(text).alias("tagged"),
            "urgency",
            due_at(F.col("created_at"), F.col("urgency")).alias("due"),
        )
        .groupBy("routed", "tagged", "urgency")
        .agg(F.count("*").alias("n"), F.min("due").alias("next_due"))
    )

#: Letters that q04 writes decomposed, by part number: Latin with one and with two marks, Hangul, Devanagari with nukta.
DECOMPOSED = [("e", "e\u0301"), ("r", "o\u0323\u0307"), ("i", "\u1112\u1161\u11ab"), ("l", "\u0915\u093c\u0928\u093c")]


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tickets(spark, sf_dir).select(F.lit("ticket").alias("src"), "id", "text")
    return rows.unionByName(tables.documents(spark, sf_dir).select(F.lit("document").alias("src"), "id", "text"))


def language_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _texts(spark, sf_dir).select(
        "src",
        "id",
        detect_language(text).alias("language"),
        lexicon_hits(text).alias("hits"),
        F.round(F.coalesce(latin_ratio(text), F.lit(0.0)), 6).alias("latin_ratio"),
    )


def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.tickets(spark, sf_dir).withColumn("tagged", detect_language(F.col("text")))
    return evaluate.label_pairs(rows, "language", "tagged")


def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets and documents, and the names of parts written with decomposed letters."""
    name = F.col("p_name")
    written = [(F.replace(name, F.lit(a), F.lit(b))) for a, b in DECOMPOSED]
    kind = F.pmod("p_partkey", F.lit(len(DECOMPOSED)))
    parts = tables.read(spark, sf_dir, "part").select(F.lit("part").alias("src"), F.col("p_partkey").alias("id"), F.get(F.array(*written), kind.cast("int")).alias("text"))
    norm = normalize(F.col("text"))
    return _texts(spark, sf_dir).unionByName(parts).select("src", "id", norm.alias("norm")).withColumn("n_chars", F.length("norm"))


def token_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = token_highlight(normalize(F.col("text")), 8)
    return (
        # Without "outer" Spark would test the array's size first, and call the function once more for that.
        _texts(spark, sf_dir).select("src", "id", F.posexplode_outer(top).alias("pos", "token")).filter("token IS NOT NULL").select(
            "src", "id", (F.col("pos") + 1).alias("rank"), "token"
        )
    )


def sla_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.substring("o_orderpriority", 1, 1)
    urgency = F.when(level == "1", "P1").when(level == "2", "P2").when(level == "3", "P3").otherwise("P4")
    rows = tables.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").alias("created_at"), urgency.alias("urgency"))
    due = due_at(F.col("created_at"), F.col("urgency"))
    return rows.select(
        "o_orderkey",
        "urgency",
        sla_hours(F.col("urgency")).alias("sla_hours"),
        due.alias("due_at"),
        sla_remaining_min(due, as_of(tables.ORDERS_AS_OF)).alias("sla_remaining_min"),
    )


def inbox_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inbox.list_tickets(
        tables.inbox(spark, sf_dir),
        as_of(),
        department="Billing & Payments",
        urgency=inbox.choice(inbox.ALL),
        needs_human=inbox.human_choice("auto"),
        limit=200,
    )
    return inbox.keep_columns(rows, inbox.LISTING_COLUMNS)


def inbox_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inbox.get_ticket(tables.inbox(spark, sf_dir), 7).select("id", "text", "status", "due_at", "needs_human")


def _accepted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = tables.inbox(spark, sf_dir)
    accepted, _ = overrides.check_overrides(tables.corrections(spark, sf_dir), stored)
    return stored, accepted


def override_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, accepted = _accepted(spark, sf_dir)
    return overrides.current_state(stored, accepted).select(
        "id", "department", "urgency", "sla_hours", "due_at", "status", "needs_human"
    )


def override_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tables.inbox(spark, sf_dir)
    return overrides.audit_log(tables.corrections(spark, sf_dir), stored)


def override_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overrides.list_overrides(override_audit(spark, sf_dir), limit=100)


def override_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted, rejected = overrides.check_overrides(tables.corrections(spark, sf_dir), tables.inbox(spark, sf_dir))
    named = lambda df, verdict: df.select("id", "ticket_id", F.lit(verdict).alias("verdict"))
    return named(accepted, "accepted").unionByName(named(rejected, "rejected"))


def kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, accepted = _accepted(spark, sf_dir)
    return kpi.analytics(overrides.current_state(stored, accepted), accepted)


def drafted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = computed_once(tables.tickets(spark, sf_dir), language=detect_language(F.col("text")))
    # Some rows get labels outside the taxonomy, so both fallbacks are taken.
    odd = F.pmod("id", F.lit(17))
    rows = rows.withColumns(
        {
            "department": F.when(odd == 0, "Gift cards").otherwise(F.col("department")),
            "language": F.when(odd == 1, "other").otherwise(F.col("language")),
            "urgency": F.when(odd == 2, "P9").otherwise(F.col("urgency")),
        }
    )
    return replies.draft_replies(rows)


def draft_reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drafted(spark, sf_dir).select("id", snippet(F.col("text")).alias("snippet"), "template_reply")


def polish_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drafted(spark, sf_dir)
    return replies.merge_rewrites(rows, tables.answers(rows)).select(
        "id", "suggested_reply", "source", "llm_backend", "llm_error", "rationale"
    )


def sla_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which hour numbers a reply text commits to."""
    rows = drafted(spark, sf_dir).select("id", "template_reply")
    checks = {f"h{h}": replies.sla_mentioned(F.col("template_reply"), F.lit(h)) for h in (1, 2, 4, 24, 72)}
    return rows.select("id", *[c.alias(n) for n, c in checks.items()])


def prompt_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.prompt_export(drafted(spark, sf_dir))


def _normed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.documents(spark, sf_dir).withColumn("norm", normalize(F.col("text")))


def term_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _normed_documents(spark, sf_dir)
    return tfidf.term_frequencies(docs, "id", "norm")


def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _normed_documents(spark, sf_dir)
    vocab = tfidf.fit_vocabulary(docs, "id", "norm")
    return tfidf.tfidf_table(docs, "id", "norm", vocab).withColumn("weight", F.round("weight", 6))


def tfidf_sublinear_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.labelled(spark, sf_dir)
    vocab = tfidf.fit_vocabulary(rows, "id", "norm", min_df=2)
    return tfidf.tfidf_table(rows, "id", "norm", vocab, sublinear=True).withColumn("weight", F.round("weight", 6))


def keyword_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("norm")
    rows = tables.labelled(spark, sf_dir)
    hits = [keyword_hits(text, words).alias(f"hits_{i}") for i, words in enumerate(DEPARTMENT_KEYWORDS.values())]
    return rows.select("id", *hits, keyword_department(text).alias("kw_dept"))


def keyword_baseline_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.documents(spark, sf_dir).withColumn("kw_dept", keyword_department(F.col("text")))
    return rows.groupBy("kw_dept").agg(F.count("*").alias("n"))


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.stratified_split(tables.tickets(spark, sf_dir)).select("id", "department", "split")


def split_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_sizes(split.stratified_split(tables.tickets(spark, sf_dir).select("id", "department")))


def _tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels against the keyword department and an urgency guess that is wrong for some rows."""
    guess = F.when(F.pmod("id", F.lit(10)) == 0, "P3").otherwise(F.col("urgency"))
    rows = split.stratified_split(tables.tickets(spark, sf_dir))
    rows = rows.withColumns({"pred_dept": keyword_department(normalize(F.col("text"))), "pred_urg": guess})
    counts = evaluate.tally(rows, "split", "language", "department", "pred_dept", "urgency", "pred_urg")
    return cut_lineage(counts)


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _tally(spark, sf_dir)
    dept = evaluate.classification_report(counts, "department", "pred_dept", TAXONOMY.routeable)
    urg = evaluate.classification_report(counts, "urgency", "pred_urg", ("P1", "P2", "P4"))
    both = dept.withColumn("target", F.lit("department")).unionByName(urg.withColumn("target", F.lit("urgency")))
    return both.withColumn("value", F.round("value", 6))


def recall_and_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _tally(spark, sf_dir)
    slices = evaluate.language_slices(counts).select(
        "split", "language", "n", F.round("department_acc", 6).alias("department_acc"), F.round("urgency_acc", 6).alias("urgency_acc")
    )
    recall = evaluate.p1_recall(counts).withColumn("p1_recall", F.round("p1_recall", 6))
    base = evaluate.accuracy(counts, "department", "pred_dept", "kw_acc").withColumn("kw_acc", F.round("kw_acc", 6))
    return slices.join(F.broadcast(recall), "split").join(F.broadcast(base), "split")


def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same report on given labels: document length as a stand-in prediction of quality."""
    docs = tables.read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = tables.read(spark, sf_dir, "labels").join(docs, "doc_id").select(
        F.col("lang").alias("split"),
        F.col("quality").cast("string").alias("gold"),
        (F.col("n_chars") > 1000).cast("int").cast("string").alias("pred"),
    )
    report = evaluate.classification_report(evaluate.tally(rows, "split", "gold", "pred"), "gold", "pred", ("0", "1"))
    return report.withColumn("value", F.round("value", 6))


def similar_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _normed_documents(spark, sf_dir)
    return similar_tickets(docs, docs, k=3, payload=F.struct(preview(F.col("text")).alias("text")))


def similar_saved_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against a saved index that took them in two parts."""
    docs, folder = _normed_documents(spark, sf_dir), f"{_folder(spark, 'similar-index')}/index"
    shown, odd = F.struct(preview(F.col("text")).alias("text")), F.pmod("id", F.lit(2)) == 1
    save_index(docs.filter(odd), folder, 3, payload=shown, vocab=tfidf.fit_vocabulary(docs, "id", "norm"))
    append_index(docs.filter(~odd), folder, payload=shown)
    return search_index(docs, read_index(spark, folder), 3)


def similar_past_tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.labelled(spark, sf_dir)
    return similar_tickets(rows, rows, k=3)


def batch_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.pmod("id", F.lit(5))
    rows = tables.tickets(spark, sf_dir).select(
        F.when(odd == 0, None).otherwise(F.col("id")).alias("id"),
        F.when(odd == 1, None).otherwise(F.col("channel")).alias("channel"),
        F.when(odd == 2, F.lit("   ")).otherwise(F.concat(F.lit(" "), F.col("text"), F.lit("\n"))).alias("text"),
        F.when(odd == 3, F.lit("")).otherwise(F.col("urgency")).alias("urgency"),
        F.when(odd == 4, None).otherwise(F.pmod("id", F.lit(2)) == 0).alias("needs_human"),
        F.col("created_at"),
        F.col("id").alias("row_no"),
    )
    accepted, _ = inbox.split_blank(rows)
    stored = inbox.insert_defaults(inbox.batch_fields(accepted, "email"))
    return stored.select("row_no", "ext_id", "channel", "text", "urgency", "sla_hours", "due_at", "needs_human", "status")


def rejected_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an upload with blank texts and with records of too many cells gives back as rejects."""
    path, odd, key = _folder(spark, "upload"), F.pmod("id", F.lit(5)) == 2, F.col("id").cast("string")
    rows = tables.tickets(spark, sf_dir)
    blank = F.when(F.pmod("id", F.lit(3)) == 0, F.lit("")).otherwise(F.lit("  \u00a0"))
    good = rows.select(F.concat(F.lit("T"), key).alias("id"), F.when(odd, blank).otherwise(F.col("text")).alias("text"), "channel", key.alias("row_no"))
    write_csv(good, path)
    parts = F.concat_ws(",", F.concat(F.lit("T"), key), F.lit("only"), "language", key, F.lit("too"), F.lit("many"))
    bad = rows.filter(F.pmod("id", F.lit(7)) == 3).select(parts.alias("value"))
    # a file whose first line is dropped as its header
    header = spark.createDataFrame([("id,text,channel,row_no",)], "value string")
    header.unionByName(bad).coalesce(1).write.mode("append").text(path)
    _, rejected = read_upload_with_rejects(spark, path, ["id", "text", "channel", "row_no"])
    number = F.coalesce(F.col("row_no"), F.get(F.split("record", ","), F.lit(3))).cast("long")
    return rejected.select(number.alias("row_no"), F.col("id").alias("ext_id"), "reason", "record")


def upload_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An uploaded file whose first column, by whatever name, is the text."""
    path = _folder(spark, "upload")
    said = F.concat(F.lit('say "'), "text", F.lit('", ok'))
    rows = tables.tickets(spark, sf_dir).select(F.when(F.pmod("id", F.lit(4)) != 0, said).alias("message"), "id", F.nullif("channel", F.lit("chat")).alias("channel"))
    write_csv(rows, path)
    return read_upload_csv(spark, path)


def extra_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The explanatory fields packed into one text column, written, read and unpacked."""
    number, path = F.col("id"), _folder(spark, "packed")
    part = F.round(F.pmod(number, F.lit(97)) / F.lit(97.0), 6)
    ranked = lambda label: F.array(F.struct(F.col(label).alias("label"), part.alias("p")))
    why = F.when(F.pmod(number, F.lit(3)) != 0, F.concat(F.lit('because "'), "language", F.lit('" \\ '), "channel"))
    words = F.array_repeat(F.col("language"), F.pmod(number, F.lit(4)).cast("int"))
    rows = tables.tickets(spark, sf_dir).select("id", ranked("department").alias("department_top3"), ranked("urgency").alias("urgency_top3"), why.alias("rationale"), words.alias("explain"))
    pack_extra(rows).select("id", "extra").write.parquet(path)
    top = "array<struct<label:string,p:double>>"
    back = unpack_extra(spark.read.parquet(path), f"department_top3 {top}, urgency_top3 {top}, rationale string, explain array<string>")
    first = F.get("extra.department_top3", F.lit(0))
    return back.select(
        "id", first["label"].alias("label"), first["p"].alias("p"), F.get("extra.urgency_top3", F.lit(0))["label"].alias("second_label"), "extra.rationale",
        F.size("extra.explain").alias("n_explain"), F.get("extra.explain", F.lit(0)).alias("first_explain"),
    )


def inbox_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest tickets under each filter of the listing, alone and together."""
    rows = tables.inbox(spark, sf_dir)
    wanted = {
        "language": {"language": "hinglish"}, "urgency": {"urgency": "P1"}, "human": {"needs_human": inbox.human_choice("needs human")},
        "all": {"language": "en", "urgency": "P2", "needs_human": True}, "none": {"language": inbox.choice(""), "urgency": inbox.choice(inbox.ALL)},
    }
    out = None
    for name, filters in wanted.items():
        one = inbox.list_tickets(rows, as_of(), limit=200, **filters).select(F.lit(name).alias("listing"), "id", "language", "urgency", "needs_human", "confidence")
        out = one if out is None else out.union(one)
    return out


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.read(spark, sf_dir, "events").select("event_id", "ts")
    return assign_ids(rows, base=1_000_000, order_by=["ts", "event_id"], id_col="ticket_id")


def taxonomy_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tickets per taxonomy department, unused ones with zero, routeable ones flagged."""
    counts = kpi.counts_by(tables.tickets(spark, sf_dir), "department")
    dims = TAXONOMY.department_dim(spark)
    return dims.join(counts, "department", "left").select(
        "department", "ord", "routeable", F.coalesce("n", F.lit(0)).alias("n")
    )


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def route_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on the labelled tickets, then route every ticket with similar past ones."""
    labelled = tables.tickets(spark, sf_dir)
    parts = split.stratified_split(labelled).withColumn("norm", normalize(F.col("text")))
    model = fit(parts.filter(F.col("split") == "train"))
    arriving = labelled.select("id", "created_at", "text", "channel")
    routed = route(arriving, model, corpus=labelled)
    return routed.select(
        "id", "language", "department", "department_confidence", "urgency", "urgency_confidence", "confidence",
        "needs_human", "sla_hours", "source", "suggested_reply",
        F.array_join("explain", " ").alias("explain"),
        F.size("similar").alias("n_similar"),
        F.get("similar", F.lit(0))["score"].alias("best_similar_score"),
    )


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole routing job with the model of whole numbers, which SQL can replay."""
    labelled = tables.labelled(spark, sf_dir)
    model = fit_counts(split.stratified_split(labelled).filter(F.col("split") == "train"))
    routed = route(labelled.select("id", "text", "channel"), model)
    names = lambda top: F.array_join(F.transform(top, lambda x: x["label"]), " | ")
    return routed.select(
        "id", "language", "department", "department_confidence", "urgency", "urgency_confidence", "confidence", "needs_human", "sla_hours", "source",
        names("department_top3").alias("department_top3"), names("urgency_top3").alias("urgency_top3"),
        F.round(F.get("department_top3", F.lit(2))["p"], 6).alias("third_p"),
    )


def model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return train(tables.tickets(spark, sf_dir))[1]


def _event_parts(spark: SparkSession, sf_dir: str, root: str) -> list[DataFrame]:
    """The earlier and the later half of the events, which a stream will find one after the other."""
    events = tables.read(spark, sf_dir, "events")
    cut = events.agg(F.percentile_approx("ts", 0.5)).first()[0]
    return [events.filter(F.col("ts") < F.lit(cut)), events.filter((F.col("ts") >= F.lit(cut)) | F.col("ts").isNull())]


def _event_stream(spark: SparkSession, schema: StructType, folder: str) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(folder)


def _keyword_route(rows: DataFrame) -> DataFrame:
    """The model-free routing used where results must be replayable in SQL."""
    text = normalize(F.col("text"))
    return rows.withColumns({"language": detect_language(F.col("text")), "department": keyword_department(text)})


def stream_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events arriving as a stream, routed and stored per micro-batch; must equal the batch result.

    The stream finds half of the events, stops, and goes on from its checkpoint with the rest.
    """
    root = _folder(spark, "stream-inbox")
    store = TicketStore(spark, f"{root}/store")
    for part in _event_parts(spark, sf_dir, root):
        part.write.mode("append").parquet(f"{root}/arriving")
        arriving = event_tickets(_event_stream(spark, part.schema, f"{root}/arriving"))
        rows = arriving.withColumn("ext_id", F.col("id").cast("string")).drop("id").withColumn("needs_human", F.lit(False))
        store_arrivals(rows, store, _keyword_route, f"{root}/checkpoint", ["created_at", "ext_id"]).awaitTermination()
    return store.raw_tickets().select(
        "id", "ext_id", "text", "channel", "language", "department", "urgency", "sla_hours", "status",
        F.col("due_at").cast("timestamp_ntz").alias("due_at"),
    )


def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "stream-counts")
    for part in _event_parts(spark, sf_dir, root):
        part.write.mode("append").parquet(f"{root}/arriving")
        counts = department_counts(event_tickets(_event_stream(spark, part.schema, f"{root}/arriving")))
        publish_counts(counts, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return read_counts(spark, f"{root}/counts").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled tickets written as CSV and read back with the declared schema."""
    path = _folder(spark, "labelled-csv")
    rows = tables.tickets(spark, sf_dir)
    stamped = rows.withColumns({"id": F.concat(F.lit("T"), F.col("id").cast("string")), "timestamp": F.col("created_at").cast("timestamp")})
    write_csv(stamped.select("id", "text", "department", "urgency", "language", "channel", "timestamp"), path)
    back = read_labelled_csv(spark, path)
    return back.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))


def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert the tickets, log the corrections twice over, and read the current inbox."""
    store = TicketStore(spark, _folder(spark, "store"))
    arriving = _keyword_route(tables.tickets(spark, sf_dir)).withColumn("ext_id", F.col("id").cast("string"))
    store.insert(arriving.withColumnRenamed("id", "event_id"), order_by=["event_id"])
    # Stored ids start at 1 where event ids start at 0.
    wanted = tables.corrections(spark, sf_dir).withColumn("ticket_id", F.col("ticket_id") + 1)
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")
    store.override(wanted.filter(~late))
    store.override(wanted.filter(late))
    last = store.overrides().groupBy(F.col("ticket_id").alias("id")).agg(
        F.count("*").alias("n_overrides"), F.max_by("pred_dept", "id").alias("replaced_dept"), F.max("id").alias("last_override")
    )
    return store.tickets().join(last, "id", "left").select(
        "id", "ext_id", "department", "urgency", "sla_hours", "status",
        F.col("due_at").cast("timestamp_ntz").alias("due_at"),
        F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"), "replaced_dept",
        F.coalesce("last_override", F.lit(0)).alias("last_override"),
    )
