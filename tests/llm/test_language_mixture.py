import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.llm import language_mixture as lm


@pytest.fixture(scope="module")
def judged(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return docs.select("doc_id", "lang").join(lm.classify(docs), "doc_id").toPandas()


def test_held_out_accuracy(judged):
    held = judged[judged.held_out & judged.lang.notna()]
    assert len(held) > 200 and (held.lang == held.lang_pred).mean() >= 0.98
    assert judged.score.between(0, 1).all()


def test_fold_is_not_learned_from(spark):
    rows = [(i, "zzz yyy xxx " * 5, "q" if i % 2 else "r") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    folds = docs.select("doc_id", lm.held_out().alias("h")).collect()
    lone = next(r.doc_id for r in folds if r.h)
    changed = docs.withColumn("lang", F.when(F.col("doc_id") == lone, "only").otherwise(F.col("lang")))
    assert {r.lang_pred for r in lm.classify(changed).collect()} <= {"q", "r"}


def test_mixture_proportions(spark, judged):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang in ('de', 'es')")
    texts = {r.lang: r.t for r in docs.groupBy("lang").agg(F.max(F.col("text").substr(1, 3000)).alias("t")).collect()}
    n = min(map(len, texts.values()))
    mixed = texts["de"][:n] + " " + texts["es"][: n // 3]
    found = lm.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), lm.learn(docs), "doc_id").first()
    assert found.languages == ["de", "es"] and abs(found.proportions[0] - 0.75) < 0.06


def test_em_finds_the_maximum():
    rng = np.random.default_rng(1)
    table = rng.dirichlet(np.ones(lm.CELLS), 3).astype(np.float32)
    counts = np.stack([rng.multinomial(3000, p @ table.astype(float) / (p @ table.astype(float)).sum()) for p in ([1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5])])
    shares, explained = lm.mixtures(counts, table)
    assert explained.all() and np.abs(shares - [[1, 0, 0], [0.5, 0.5, 0], [0.2, 0.3, 0.5]]).max() < 0.06
    assert (shares[0, 1:] == 0).all()


def test_odd_texts(spark, make):
    docs = make([(1, None), (2, ""), (3, "123 !?"), (4, "é"), (5, "the the the"), (5, "the the the"), (None, "the")])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") == 5, "en"))
    got = {r.doc_id: r for r in lm.predict(docs, (["en"], np.full((1, lm.CELLS), 1 / lm.CELLS, np.float32)), "doc_id", "hit").collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["en"] * 3
    assert got[1].score == 0 and got[1].languages == [] and got[5].score == 1
    assert {r.lang_pred for r in lm.classify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert lm.classify(docs.limit(0)).count() == 0
