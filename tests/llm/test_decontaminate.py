import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ticketloom.llm import decontaminate as dc

WORD = re.compile(r"[^\W_]+")


def shingles(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(docs, items, threshold=0.8):
    out = set()
    for d, text in docs:
        w = WORD.findall((text or "").lower())
        for i, item in items:
            v = WORD.findall((item or "").lower())
            k = min(5, len(v))
            if v and not shingles(w, k).keys() & shingles(v, k).keys():
                continue
            for s in range(len(w)) if v else ():
                a, b = shingles(w[s : s + len(v)], k), shingles(v, k)
                if sum((a & b).values()) >= threshold * sum((a | b).values()):
                    out.add((d, i))
                    break
    return out


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")


def pairs(df):
    return {(r.doc_id, r.item_id) for r in df.collect()}


def test_given_documents(documents, benchmark):
    want = brute([(r.doc_id, r.text) for r in documents.collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert want and pairs(dc.leaks(documents, benchmark)) == want


def test_near_copies_short_items_and_odd_rows(spark, make, monkeypatch):
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 20)  # several blocks
    words = [f"w{i}" for i in range(60)]
    items = [(1, " ".join(words[:50])), (2, "Two, words!"), (3, None), (4, "..."), (5, "w1 w1 w1 w1 w1 w1 w1"), (None, " ".join(words[50:60]))]
    swapped = words[:20] + ["other"] + words[21:50]
    docs = [
        (10, "x y " + " ".join(words[:50]).upper() + " z"), (11, "-".join(words[:46])), (12, " ".join(swapped)), (13, "two words"),
        (14, None), (15, ""), (16, " ".join(["w1"] * 6)), (17, "clean text of no item at all"), (18, "a " + " ".join(words[50:60])), (10, "x"),
        (None, "two words"),
    ]
    found = dc.leaks(make(docs), spark.createDataFrame(items, "item_id long, text string").withColumn("hit", F.lit(1)))
    assert pairs(found) == brute(docs, items)
    place = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.similarity) for r in found.collect()}
    assert place[10, 1] == (2, 50, 1.0)
    empty = spark.createDataFrame([], "item_id long, text string")
    assert dc.leaks(make(docs), empty).count() == 0 and dc.leaks(make([]), empty).count() == 0


def test_long_items_are_found_by_their_parts(spark, make):
    item = [f"v{i}" for i in range(700)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert sorted(r.n_words for r in dc.item_parts(bench).collect()) == [256, 256, 256]
    assert pairs(dc.leaks(make([(1, " ".join(item[300:600])), (2, " ".join(item[430:]))]), bench)) == {(2, 1)}


def test_simhash_counts_bits(spark):
    words = ["a", "b", "c", "a"]
    row = spark.createDataFrame([(words,)], "words array<string>")
    hashes = [r[0] & (2**64 - 1) for r in row.select(F.explode("words").alias("w")).select(F.xxhash64("w")).collect()]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) > 2)
    assert row.select(dc.simhash("words")).first()[0] & (2**64 - 1) == want
