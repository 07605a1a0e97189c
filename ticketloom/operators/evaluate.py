"""Classification reports, recall and accuracy slices from predictions and gold labels.

The predictions are counted once per combination of split, language and labels. That tally has a
fixed number of rows (labels x labels), and every score is derived from it without a further join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ["precision", "recall", "f1"]


def tally(df: DataFrame, *columns: str) -> DataFrame:
    """Rows per combination of the given label columns, as ``n``."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def _ratio(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole), F.lit(0.0))


def class_scores(counts: DataFrame, gold: str, predicted: str, labels, by: str = "split") -> DataFrame:
    """Per split and class: support, predicted, tp and the scores. A zero denominator gives 0.

    Every listed label gets a row even if it never occurs; other classes seen in the data are kept
    with ``listed`` false.
    """
    n, zero = F.col("n"), F.lit(0).cast("bigint")

    def cell(name, support, guessed, tp):
        return F.struct(name.alias("class"), support.alias("support"), guessed.alias("predicted"), tp.alias("tp"))

    hit = F.when(F.col(gold) == F.col(predicted), n).otherwise(zero)
    cells = F.array(
        cell(F.col(gold), n, zero, hit),
        cell(F.col(predicted), zero, n, zero),
        *[cell(F.lit(label), zero, zero, zero) for label in labels],
    )
    pairs = counts.groupBy(by, gold, predicted).agg(F.sum("n").alias("n"))
    totals = pairs.select(by, F.inline(cells)).groupBy(by, "class").agg(
        *[F.sum(c).alias(c) for c in ("support", "predicted", "tp")]
    )
    return totals.withColumns(
        {
            "precision": _ratio(F.col("tp"), F.col("predicted")),
            "recall": _ratio(F.col("tp"), F.col("support")),
            "f1": _ratio(2.0 * F.col("tp"), F.col("support") + F.col("predicted")),
            "listed": F.coalesce(F.col("class").isin(*labels), F.lit(False)),
        }
    )


def classification_report(counts: DataFrame, gold: str, predicted: str, labels, by: str = "split") -> DataFrame:
    """Long table (split, class, metric, value) with per-class rows and the averages.

    ``accuracy`` appears when the labels cover everything seen in gold and prediction; otherwise
    the report has a ``micro avg`` over the listed labels in its place.
    """
    scores = class_scores(counts, gold, predicted, labels, by)
    listed = F.col("listed")
    only = lambda c: F.when(listed, c)
    per_split = scores.groupBy(by).agg(
        F.collect_list(only(F.struct("class", *METRICS, "support"))).alias("classes"),
        *[F.avg(only(F.col(m))).alias(f"macro_{m}") for m in METRICS],
        *[F.sum(only(F.col(m) * F.col("support"))).alias(f"sum_{m}") for m in METRICS],
        *[F.sum(only(F.col(c))).alias(c) for c in ("support", "predicted", "tp")],
        F.sum("tp").alias("correct"),
        F.sum("support").alias("seen"),
        F.bool_or(~listed).alias("open"),
    )

    def row(name, metric, value):
        return F.struct(F.lit(name).alias("class"), F.lit(metric).alias("metric"), value.cast("double").alias("value"))

    support, guessed, tp = F.col("support"), F.col("predicted"), F.col("tp")
    micro = [
        row("micro avg", "precision", _ratio(tp, guessed)),
        row("micro avg", "recall", _ratio(tp, support)),
        row("micro avg", "f1", _ratio(2.0 * tp, guessed + support)),
        row("micro avg", "support", support),
    ]
    averages = [row("macro avg", m, F.col(f"macro_{m}")) for m in METRICS]
    averages += [row("weighted avg", m, _ratio(F.col(f"sum_{m}"), support)) for m in METRICS]
    averages += [row(name, "support", support) for name in ("macro avg", "weighted avg")]
    overall = F.array(row("accuracy", "accuracy", _ratio(F.col("correct"), F.col("seen"))))
    per_class = F.flatten(
        F.transform(
            "classes",
            lambda c: F.array(
                *[
                    F.struct(c["class"].alias("class"), F.lit(m).alias("metric"), c[m].cast("double").alias("value"))
                    for m in [*METRICS, "support"]
                ]
            ),
        )
    )
    everything = F.concat(per_class, F.array(*averages), F.when(F.col("open"), F.array(*micro)).otherwise(overall))
    return per_split.select(by, F.inline(everything))


def _share(condition: Column) -> Column:
    """Share of rows (weighted by ``n``) that meet the condition."""
    return F.try_divide(F.sum(F.when(condition, F.col("n")).otherwise(0)).cast("double"), F.sum("n"))


def p1_recall(counts: DataFrame, gold: str = "urgency", predicted: str = "pred_urg", by: str = "split") -> DataFrame:
    """Recall of P1; NULL where a split has no P1 gold."""
    p1 = F.sum(F.when(F.col(gold) == "P1", F.col("n")))
    hit = F.sum(F.when((F.col(gold) == "P1") & (F.col(predicted) == "P1"), F.col("n")).otherwise(0))
    return counts.groupBy(by).agg(F.try_divide(hit.cast("double"), p1).alias("p1_recall"))


def language_slices(counts: DataFrame, by: str = "split") -> DataFrame:
    """Accuracy of both targets by gold language."""
    return counts.groupBy(by, "language").agg(
        F.sum("n").alias("n"),
        _share(F.col("department") == F.col("pred_dept")).alias("department_acc"),
        _share(F.col("urgency") == F.col("pred_urg")).alias("urgency_acc"),
    )


def accuracy(counts: DataFrame, gold: str, predicted: str, name: str, by: str = "split") -> DataFrame:
    return counts.groupBy(by).agg(_share(F.col(gold) == F.col(predicted)).alias(name))


def label_pairs(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """How often each gold label got each predicted label."""
    return tally(df.select(F.col(gold).alias("gold"), F.col(predicted).alias("pred")), "gold", "pred")
