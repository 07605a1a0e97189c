import re
import sys
import unicodedata
from collections import Counter

import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketloom.functions import detect_language, is_blank, normalize, preview, snippet, token_highlight, word_ngrams, word_tokens
from ticketloom.functions.language import HINGLISH_LEXICON
from ticketloom.functions.text import NFC_INERT, SPACE_CLASS, SPACES, STOP_WORDS, WORD


def run(spark, texts, make):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    return [r[0] for r in rows.select("i", make(F.col("text")).alias("v")).orderBy("i").select("v").collect()]


TEXTS = [
    None, "", "   ", "\u00a0\u3000", "plain text", "a\u00a0b\tc\n\nd", "see https://x.y/z?q=1 now", "http://a",
    "Cafe\u0301 au lait", "\u095b\u0958", "\u1100\u1161", "A\u0323\u0307", "\u212b \u2126 \uf900", "क\u094dष", "x\x1fy\x85z",
    "मेरा बिल गलत है", "e\u0301" * 5, "\ufb01 ligature", "a\u200bb",
]


def python_normalize(text):
    if text is None:
        return ""
    t = unicodedata.normalize("NFC", text).replace("\u00a0", " ")
    return re.sub(r"\s+", " ", re.sub(r"https?://\S+", " ", t)).strip()


def test_normalize_matches_python(spark):
    assert run(spark, TEXTS, normalize) == [python_normalize(t) for t in TEXTS]


def test_patterns_name_the_classes_they_stand_for(spark):
    """Their first parts only save tests: the characters are those of the whole class, one by one."""
    every = spark.range(1, 0xFFFF).where("id not between 55296 and 57343").select(F.decode(F.expr("unhex(lpad(hex(id), 4, '0'))"), "UTF-16BE").alias("c"))
    like = lambda p: F.regexp_like("c", F.lit(p))
    seen = every.select(like(SPACES).alias("space"), like(f"[{SPACE_CLASS}]+").alias("all"), like(WORD.replace("{2,}", "")).alias("word"), like(r"[\p{L}\p{N}_]").alias("any"))
    assert seen.where("space <> all or word <> any").count() == 0 and seen.where("space").count() == 29
    assert SPACES.index("&&") < SPACES.index(SPACE_CLASS) and WORD.startswith("[a-z")


def test_blank(spark):
    assert run(spark, TEXTS, is_blank) == [not (t or "").strip() for t in TEXTS]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=50, max_size=200))
def test_normalize_and_blank_on_any_text(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    assert run(spark, texts, normalize) == [python_normalize(t) for t in texts]
    assert run(spark, texts, is_blank) == [not t.strip() for t in texts]


def test_inert_characters_never_change_under_nfc():
    """No character the NFC stage skips composes, decomposes or reorders."""
    inert = re.compile("[" + re.sub(r"\\x\{([0-9a-f]+)\}", lambda m: re.escape(chr(int(m[1], 16))), NFC_INERT) + "]")
    chars = [chr(c) for c in range(sys.maxunicode + 1) if inert.match(chr(c))]
    assert len(chars) > 900
    second = set()
    for c in range(sys.maxunicode + 1):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            second.add(chr(int(parts[1], 16)))
    for c in chars:
        assert unicodedata.normalize("NFC", c) == c
        assert unicodedata.combining(c) == 0
        assert c not in second


def test_snippet_and_preview_cut_code_points(spark):
    long = "₹ 👍  word\n" * 60
    assert run(spark, [long, None], snippet) == [" ".join(long.split())[:140], ""]
    assert run(spark, [long, None], preview) == [long[:240], ""]


def test_word_tokens_use_python_word_characters(spark):
    texts = ["My UPI_id a b2 naïve", "मेरा बिल गलत है", "x", ""]
    want = [regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower()) for t in texts]
    assert run(spark, texts, word_tokens) == want
    grams = [t + [f"{a} {b}" for a, b in zip(t, t[1:])] for t in want]
    assert run(spark, texts, lambda c: word_ngrams(word_tokens(c))) == grams


def python_highlight(text, n=8):
    toks = re.findall(r"[a-zA-Z\u0900-\u097F']+", python_normalize(text).lower())
    return [w for w, _ in Counter(t for t in toks if t not in STOP_WORDS and len(t) > 2).most_common(n)]


def test_token_highlight_matches_counter(spark):
    texts = [
        "Refund refund the bank order bank order bank zeta alpha gamma delta kappa lambda",
        "मेरा बिल बिल गलत है please help", "a an to", "", None, "don't don't won't", " ".join(f"w{i % 977}x" for i in range(20000)),
    ]
    assert run(spark, texts, lambda c: token_highlight(normalize(c))) == [python_highlight(t) for t in texts]


def test_language_decisions(spark):
    one = HINGLISH_LEXICON[0]
    cases = [
        ("मेरा बिल गलत है", "hi"),
        ("Order nahi mila kya", "hinglish"),
        ("The charge on my invoice is wrong", "en"),
        ("என் ஆர்டர் வரவில்லை", "other"),
        ("", "other"), (None, "other"), (" \u00a0\n", "other"),
        ("बिल என்", "hi"),
        (one + " b c d e f g h", "hinglish"),
        (one + " b c d e f g h i", "en"),
        ("12345 67", "other"),
        ("привет мир hello", "other"),
        ("Où est ma commande ?", "en"),
        ("ok " + "ж" * 2, "en"), ("ok " + "ж" * 3, "other"),
    ]
    assert run(spark, [c[0] for c in cases], detect_language) == [c[1] for c in cases]


def test_highlights_leave_interpreted_lambdas(spark):
    """Ties by first place, stop words, short words, null and blank rows, over more than one slice of rows."""
    from ticketloom.functions import text as module

    rows = ["card bill card the THE bill zeta", "the a to", None, "", "aa bb", "बिल बिल राशि abc"] + [f"row{'x' * (i % 7 + 1)} one two one" for i in range(2 * module.TOP_ROWS)]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, norm string").coalesce(1).select("id", token_highlight(F.col("norm"), 2).alias("top"))
    assert "lambdafunction" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: r.top for r in df.collect()}
    assert [got[i] for i in range(6)] == [["card", "bill"], [], [], [], [], ["बिल", "राशि"]]
    assert all(got[i] == ["one", "row" + "x" * ((i - 6) % 7 + 1)] for i in range(6, len(rows)))
