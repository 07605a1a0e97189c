"""Training and evaluation job: split, fit both targets, report on validation and test rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions import normalize
from ticketloom.operators import evaluate
from ticketloom.operators.keywords import keyword_department
from ticketloom.operators.model import TicketModel, fit, score
from ticketloom.operators.split import split_sizes, stratified_split
from ticketloom.session import cut_lineage, materialize
from ticketloom.taxonomy import TAXONOMY, Taxonomy

TALLY = ("split", "language", "department", "pred_dept", "urgency", "pred_urg", "kw_dept")
SPLIT_NOTE = "70/15/15 stratified by department"


def metric_table(counts: DataFrame, taxonomy: Taxonomy = TAXONOMY) -> DataFrame:
    """(split, target, class, metric, value) from the tally of gold and predicted labels."""

    def rows(df: DataFrame, target: str, name, *metrics: str) -> DataFrame:
        pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
        return df.select("split", F.lit(target).alias("target"), name.alias("class"), F.inline(pairs))

    def report(gold: str, predicted: str, labels) -> DataFrame:
        return evaluate.classification_report(counts, gold, predicted, labels).select(
            "split", F.lit(gold).alias("target"), "class", "metric", "value"
        )

    none = F.lit(None).cast("string")
    keyword = evaluate.accuracy(counts, "department", "kw_dept", "keyword_baseline_dept_acc")
    sizes = counts.groupBy("split").agg(F.sum("n").alias("n"))
    parts = [
        report("department", "pred_dept", taxonomy.routeable),
        report("urgency", "pred_urg", taxonomy.urgencies),
        rows(evaluate.language_slices(counts), "by_language", F.col("language"), "n", "department_acc", "urgency_acc"),
        rows(evaluate.p1_recall(counts), "overall", none, "p1_recall"),
        rows(keyword, "overall", none, "keyword_baseline_dept_acc"),
        rows(sizes, "overall", none, "n"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def train(labelled: DataFrame, id_col: str = "id", seed: int = 42, taxonomy: Taxonomy = TAXONOMY) -> tuple[TicketModel, DataFrame]:
    """Fit on the train split of ``labelled`` (id, text, department, urgency, language) and evaluate.

    Returns the model and the metric table, which includes the split sizes.
    """
    rows = stratified_split(labelled, id_col=id_col, seed=seed).withColumn("norm", normalize(F.col("text")))
    rows = materialize(rows.select(id_col, "split", "norm", "language", "department", "urgency"), "training-rows")
    model = fit(rows.filter(F.col("split") == "train"), id_col)
    held_out = score(rows.filter(F.col("split") != "train"), model).withColumns(
        {
            "pred_dept": F.get("department_top3", F.lit(0))["label"],
            "pred_urg": F.get("urgency_top3", F.lit(0))["label"],
            "kw_dept": keyword_department(F.col("norm")),
        }
    )
    counts = cut_lineage(evaluate.tally(held_out, *TALLY))
    sizes = split_sizes(rows).select(
        "split", F.lit("sizes").alias("target"), F.lit(None).cast("string").alias("class"),
        F.lit("n_rows").alias("metric"), F.col("n").cast("double").alias("value"),
    )
    return model, cut_lineage(metric_table(counts, taxonomy).unionByName(sizes))


def metric_document(metrics: DataFrame) -> dict:
    """The metric table as one nested document; the test block is repeated at the top level.

    The table has a fixed few hundred rows, so collecting it is safe.
    """
    doc: dict = {"split": SPLIT_NOTE, "val": {}, "test": {}}
    for r in metrics.collect():
        if r["target"] == "sizes":
            doc[f"n_{r['split']}"] = int(r["value"])
            continue
        block = doc.setdefault(r["split"], {})
        if r["target"] == "overall":
            block[r["metric"]] = r["value"]
        else:
            block.setdefault(r["target"], {}).setdefault(r["class"], {})[r["metric"]] = r["value"]
    for block in (doc["val"], doc["test"]):
        for target in ("department", "urgency"):
            if "accuracy" in block.get(target, {}):
                block[target]["accuracy"] = block[target]["accuracy"]["accuracy"]
    doc.update({key: doc["test"][key] for key in ("department", "urgency", "by_language") if key in doc["test"]})
    return doc
