import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.functions import normalize
from ticketloom.operators import evaluate
from ticketloom.operators.model import feature_table, fit_counts, load_model, save_model, score
from ticketloom.operators.split import split_sizes, stratified_split
from ticketloom.plans.batch import route_upload
from ticketloom.plans.routing import PREDICTION_COLUMNS, apply_labels, route
from ticketloom.plans.training import metric_document, train
from ticketloom.sources.files import read_labelled_csv, read_metrics, read_upload_csv, unpack_extra, pack_extra, write_labelled_csv, write_metrics
from ticketloom.sources.store import TicketStore
from ticketloom.sources.synthetic import generate
from ticketloom.streaming.arrivals import department_counts, publish_counts, read_counts, store_arrivals
from ticketloom.taxonomy import TAXONOMY


@pytest.fixture(scope="module")
def labelled(spark):
    return generate(spark, 1200).cache()


@pytest.fixture(scope="module")
def trained(labelled):
    return train(labelled)


def test_generated_tickets(spark, labelled, tmp_path):
    assert labelled.columns == ["id", "text", "department", "urgency", "language", "channel", "timestamp"]
    rows = {r.id: r for r in labelled.collect()}
    assert len(rows) == 1200 and "T0001" in rows and "T1200" in rows
    assert {r.department for r in rows.values()} == set(TAXONOMY.routeable)
    assert {r.channel for r in rows.values()} <= {"app", "email", "web", "whatsapp"}
    assert {r.urgency for r in rows.values()} == set(TAXONOMY.urgencies)
    again = {r.id: r for r in generate(spark, 1200).repartition(7).collect()}
    assert again == rows
    path = write_labelled_csv(spark, str(tmp_path / "csv"))
    assert {r.id: r for r in read_labelled_csv(spark, path).collect()} == rows


def test_split_is_exact_complete_and_stable(spark, labelled):
    got = {r.id: (r.department, r.split) for r in stratified_split(labelled).collect()}
    assert len(got) == 1200
    for digits, parts in ((1, 3), (2, 11)):
        other = stratified_split(labelled.repartition(parts), bucket_digits=digits)
        assert {r.id: (r.department, r.split) for r in other.collect()} == got
    for d in TAXONOMY.routeable:
        splits = [s for dep, s in got.values() if dep == d]
        n = len(splits)
        assert splits.count("train") == int(n * 0.70 + 0.5)
        assert splits.count("train") + splits.count("val") == int(n * 0.85 + 0.5)
    deep = stratified_split(labelled, bucket_digits=1, rank_rows=1)
    assert {r.id: (r.department, r.split) for r in deep.collect()} == got
    sizes = {r.split: r.n for r in split_sizes(stratified_split(labelled)).collect()}
    assert sum(sizes.values()) == 1200 and abs(sizes["train"] - 840) < 5


def test_split_of_odd_rows(spark):
    """Equal ids stay together, no stratum is a stratum, rows without id are in the last split."""
    rows = [(i, "a") for i in range(40)] + [(i, None) for i in range(20)] + [(7, "b")] * 6 + [(None, "a")] * 5 + [(1, "c")]
    rows = spark.createDataFrame(rows, "id bigint, department string").withColumn("_cut", F.lit("kept"))
    got = stratified_split(rows, rank_rows=2)
    assert got.columns == ["id", "department", "_cut", "split"] and got.count() == 72
    n = {(r.department, r.split): r.n for r in got.filter("id IS NOT NULL").groupBy("department", "split").agg(F.count("*").alias("n")).collect()}
    assert n[("a", "train")] == 28 and n[("a", "val")] == 6 and n[(None, "train")] == 14 and n[(None, "test")] == 3
    assert [k for k in n if k[0] == "b"] == [("b", "train")] and n[("c", "train")] == 1
    assert {r.split for r in got.filter("id IS NULL").collect()} == {"test"}
    assert stratified_split(rows.filter("false")).count() == 0


def test_count_model(spark):
    train = spark.createDataFrame(
        [(1, "pay bill", "A", "P1"), (2, "pay bill now", "A", "P2"), (3, "pay late", "B", "P2"), (4, "late ship", "B", None)],
        "id bigint, norm string, department string, urgency string",
    )
    model = fit_counts(train)
    assert model.vocab.terms == ["bill", "late", "pay bill", "pay"] and model.classes == {"department": ["A", "B"], "urgency": ["P1", "P2"]}
    assert model.shares["department"].tolist() == [[1000, 0, 1000, 666], [0, 1000, 0, 333]]
    assert model.shares["urgency"].tolist() == [[500, 0, 500, 333], [500, 500, 500, 666]]
    rows = spark.createDataFrame([(1, "pay pay"), (2, "unknown"), (3, None), (4, "late")], "id bigint, norm string")
    got = {r.id: [(x.label, x.p) for x in r.department_top3] for r in score(rows, model).collect()}
    assert got[1] == [("A", 887 / (887 + 221)), ("B", 221 / (887 + 221))] and got[2] == got[3] == [("A", 0.5), ("B", 0.5)]
    assert got[4] == [("B", 1001 / 1002), ("A", 1 / 1002)]


def python_report(gold, pred, labels):
    out, n = {}, len(gold)
    per = []
    for c in labels:
        tp = sum(g == p == c for g, p in zip(gold, pred))
        sup, prd = gold.count(c), pred.count(c)
        p, r = (tp / prd if prd else 0.0), (tp / sup if sup else 0.0)
        f = 2 * p * r / (p + r) if p + r else 0.0
        per.append((p, r, f, sup))
        out[c] = {"precision": p, "recall": r, "f1": f, "support": sup}
    total = sum(x[3] for x in per)
    for name, w in (("macro avg", [1 / len(per)] * len(per)), ("weighted avg", [x[3] / total for x in per])):
        out[name] = {m: sum(a * x[i] for a, x in zip(w, per)) for i, m in enumerate(("precision", "recall", "f1"))}
        out[name]["support"] = total
    if set(gold) | set(pred) <= set(labels):
        out["accuracy"] = {"accuracy": sum(g == p for g, p in zip(gold, pred)) / n}
    else:
        tp = sum(g == p and g in labels for g, p in zip(gold, pred))
        prd = sum(p in labels for p in pred)
        p, r = tp / prd, tp / total
        out["micro avg"] = {"precision": p, "recall": r, "f1": 2 * p * r / (p + r), "support": total}
    return out


@pytest.mark.parametrize("labels", [["a", "b", "c", "never"], ["a", "b"]])
def test_classification_report(spark, labels):
    rng = np.random.default_rng(1)
    gold = list(rng.choice(["a", "b", "c"], 200))
    pred = [g if rng.random() < 0.7 else str(rng.choice(["a", "c"])) for g in gold]
    rows = spark.createDataFrame([("s", str(g), str(p)) for g, p in zip(gold, pred)], "split string, gold string, pred string")
    got = {}
    for r in evaluate.classification_report(evaluate.tally(rows, "split", "gold", "pred"), "gold", "pred", labels).collect():
        got.setdefault(r["class"], {})[r["metric"]] = r["value"]
    want = python_report(gold, pred, labels)
    assert got.keys() == want.keys()
    for c in want:
        assert got[c] == pytest.approx(want[c])


def test_p1_recall_is_null_without_p1(spark):
    rows = spark.createDataFrame([("x", "P1", "P1", 3), ("x", "P1", "P2", 1), ("y", "P2", "P1", 2)], "split string, urgency string, pred_urg string, n int")
    assert {r.split: r.p1_recall for r in evaluate.p1_recall(rows).collect()} == {"x": 0.75, "y": None}


def test_training_minimises_the_stated_objective(spark, labelled, trained):
    """The gradient of sum(weighted log loss) + |W|^2/2 vanishes at the fitted coefficients."""
    model, _ = trained
    rows = stratified_split(labelled).filter("split = 'train'").withColumn("norm", normalize(F.col("text")))
    table = feature_table(rows, model.vocab, "department").collect()
    assert sum(r.n for r in table) == rows.count() > len(table)  # equal rows of one class are one row
    table = [r for r in table for _ in range(r.n)]
    x = np.stack([r.features.toArray() for r in table])
    classes = model.classes["department"]
    assert classes == sorted(classes) and np.allclose(np.linalg.norm(x, axis=1), 1)
    y = np.array([classes.index(r.department) for r in table])
    w = len(y) / (len(classes) * np.bincount(y))[y]
    coef, bias = model.weights("department")
    z = x @ coef.T + bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    residual = (p - np.eye(len(classes))[y]) * w[:, None]
    assert np.abs(residual.T @ x + coef).max() < 0.02 * np.abs(coef).max()
    assert np.abs(residual.sum(axis=0)).max() < 0.5


def test_scores_equal_spark_ml(spark, labelled, trained):
    model, _ = trained
    rows = labelled.limit(50).withColumn("norm", normalize(F.col("text")))
    own = {r.id: {x.label: x.p for x in r.department_top3} for r in score(rows, model).collect()}
    ml = model.estimators["department"].transform(feature_table(rows, model.vocab, "id"))
    for r in ml.collect():
        p = dict(zip(model.classes["department"], r.probability))
        assert own[r.id] == pytest.approx({c: p[c] for c in own[r.id]})
        assert list(own[r.id].values()) == pytest.approx(sorted(p.values(), reverse=True)[:3])


def test_metrics(spark, trained, tmp_path):
    _, metrics = trained
    doc = metric_document(metrics)
    assert abs(doc["n_train"] - 840) < 5 and doc["n_train"] + doc["n_val"] + doc["n_test"] == 1200
    assert doc["test"]["department"]["accuracy"] > 0.95 and doc["test"]["p1_recall"] > 0.9
    assert 0.4 < doc["test"]["keyword_baseline_dept_acc"] < doc["test"]["department"]["accuracy"]
    assert doc["department"] == doc["test"]["department"] and set(doc["by_language"]) == {"en", "hi", "hinglish"}
    write_metrics(metrics, str(tmp_path / "m"))
    back = read_metrics(spark, str(tmp_path / "m"))
    key = lambda r: str(tuple(r))
    assert sorted(map(key, back.collect())) == sorted(map(key, metrics.collect()))


def test_routing(spark, labelled, trained):
    model, _ = trained
    cases = [
        (1, "Mera order 12345 abhi tak nahi aaya, saman kab milega?"),
        (2, "A phishing SMS asks customers for the OTP, the link is live."),
        (3, "என் ஆர்டர் வரவில்லை"),
        (4, None),
    ]
    corpus = labelled.withColumn("id", F.regexp_extract("id", r"(\d+)", 1).cast("bigint"))
    routed = route(spark.createDataFrame(cases, "id bigint, text string"), model, corpus)
    assert routed.columns == ["id", *PREDICTION_COLUMNS]
    got = {r.id: r for r in routed.collect()}
    assert (got[1].language, got[1].department, got[1].source) == ("hinglish", "Product / Order / Delivery", "sklearn")
    assert got[1].sla_hours == TAXONOMY.sla_hours[got[1].urgency] and len(got[1].similar) == 3
    scores = [h.score for h in got[1].similar]
    assert scores == sorted(scores, reverse=True) and got[1].suggested_reply == got[1].template_reply
    assert (got[2].language, got[2].department, got[2].urgency) == ("en", "Abuse / Safety / Fraud", "P1")
    assert got[3].language == "other" and got[3].needs_human
    assert got[4].text == "" and got[4].needs_human and got[4].similar == [] and got[4].explain == []
    for r in got.values():
        assert abs(r.confidence - min(r.department_confidence, r.urgency_confidence)) < 1e-9
        assert (r.department == TAXONOMY.abstain_department) == (min(r.department_top3[0].p, r.urgency_top3[0].p) < 0.45)


def test_abstain_rule(spark):
    top = lambda p: [("A", p), ("B", 1 - p)]
    rows = spark.createDataFrame(
        [(1, "en", top(0.9), top(0.8)), (2, "en", top(0.9), top(0.44)), (3, "other", top(0.9), top(0.8)), (4, "hi", top(0.45), top(0.9))],
        "id int, language string, department_top3 array<struct<label:string,p:double>>, urgency_top3 array<struct<label:string,p:double>>",
    )
    got = {r.id: (r.department, r.urgency, r.needs_human, r.confidence) for r in apply_labels(rows).collect()}
    assert got == {1: ("A", "A", False, 0.8), 2: ("Other / Unknown", "A", True, 0.44), 3: ("A", "A", True, 0.8), 4: ("A", "A", False, 0.45)}


def test_model_survives_saving(spark, labelled, trained, tmp_path):
    model, _ = trained
    save_model(model, spark, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    rows = labelled.limit(40).withColumn("norm", normalize(F.col("text")))
    picked = lambda m: {r.id: (r.department_top3, r.urgency_top3) for r in score(rows, m).collect()}
    assert picked(loaded) == picked(model)


def test_upload_batch(spark, trained, tmp_path):
    model, _ = trained
    (tmp_path / "a.csv").write_text('message,id\n"Refund, please\nnow",7\n   ,8\n"He said ""hi""",\n', encoding="utf-8")
    assert [r.text for r in read_upload_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()] == ["Refund, please\nnow", "   ", 'He said "hi"']
    (tmp_path / "b.csv").write_text("id,channel,text\n1,phone,App crash\n,,Login OTP\n", encoding="utf-8")
    store = TicketStore(spark, str(tmp_path / "store"))
    got = route_upload(spark, str(tmp_path / "b.csv"), model, "email", store=store, export=str(tmp_path / "out"))
    assert sorted((r.text, r.channel, r.ext_id) for r in got.collect()) == [("App crash", "phone", "1"), ("Login OTP", "email", None)]
    out = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "out"))
    assert out.columns == PREDICTION_COLUMNS and out.count() == 2
    stored = store.tickets().collect()
    assert sorted(r.text for r in stored) == ["App crash", "Login OTP"] and all(len(r.extra.department_top3) == 3 for r in stored)
    packed = pack_extra(got)
    back = unpack_extra(packed, "rationale string, explain array<string>").select("extra.*").collect()
    assert sorted(r.explain for r in back) == sorted(r.explain for r in got.collect())


def test_stream_equals_batch(spark, labelled, trained, tmp_path):
    model, _ = trained
    source = str(tmp_path / "in")
    rows = labelled.select(F.col("id").alias("ext_id"), "text", "channel", F.col("timestamp").alias("created_at"))
    rows.filter("ext_id <= 'T0600'").coalesce(1).write.parquet(source)
    stored = TicketStore(spark, str(tmp_path / "store"))

    def run_stream():
        stream = spark.readStream.schema(rows.schema).parquet(source)
        store_arrivals(stream, stored, lambda df: route(df, model), str(tmp_path / "ckpt"), ["ext_id"]).awaitTermination()

    run_stream()
    assert stored.raw_tickets().count() == 600
    rows.filter("ext_id > 'T0600'").coalesce(1).write.mode("append").parquet(source)
    run_stream()
    shown = ["ext_id", "language", "department", "urgency", "confidence", "needs_human", "reply", "sla_hours"]
    batch = route(rows, model).withColumnRenamed("suggested_reply", "reply").select(*shown).collect()
    got = stored.raw_tickets()
    assert sorted(map(str, got.select(*shown).collect())) == sorted(map(str, batch))
    assert [r.id for r in got.orderBy("ext_id").collect()] == list(range(1, 1201))
    stream = spark.readStream.schema(rows.schema).parquet(source).withColumn("department", F.col("channel"))
    publish_counts(department_counts(stream), str(tmp_path / "n"), str(tmp_path / "ckpt2")).awaitTermination()
    want = department_counts(rows.withColumn("department", F.col("channel"))).collect()
    assert sorted(map(str, read_counts(spark, str(tmp_path / "n")).collect())) == sorted(map(str, want))
