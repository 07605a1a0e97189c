import re
from collections import Counter, defaultdict

from ticketloom.llm import source_divergence as sd

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "text string, lang string, source string, term int, n string, value double, rank string"


def brute(rows, min_docs=3, top=200):
    docs = [((lang or ""), (source or ""), [t.translate(LOWER) for t in TERM.findall(text or "")]) for text, lang, source in rows]
    out = set()
    for lang in {d[0] for d in docs}:
        df, groups = Counter(), defaultdict(Counter)
        for own, source, terms in docs:
            if own == lang:
                df.update(set(terms))
                groups[source].update(terms)
        kept = [t for t in df if df[t] >= min_docs]
        shares = {}
        total = Counter()
        for g in groups:
            total.update(groups[g])
        for g, counts in [*groups.items(), (None, total)]:
            n = sum(counts[t] for t in kept)
            shares[g] = {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}
        for g in groups:
            p = shares[g]
            pairs = [(sum((p[t] - q) ** 2 // q for t, q in shares[h].items()), h) for h in groups if h != g]
            terms = [((p[t] - q) ** 2 // q, t) for t, q in shares[None].items() if groups[g][t] and p[t] > q]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, g, part, item, value, r + 1) for r, (value, item) in enumerate(order)}
    return out


def audited(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x", 2.0, "y") for r in rows], SCHEMA)
    got = [tuple(r) for r in sd.audit(df, **how).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_equals_brute_force(spark, documents):
    rows = [(r.text, r.lang, r.source) for r in documents.collect()]
    assert audited(spark, rows) == brute(rows)
    assert audited(spark, rows, min_docs=1, top=3) == brute(rows, 1, 3)


def test_odd_rows(spark):
    rows = [
        ("Ärger ÄRGER a_b c1d it's", "de", "a"), ("ärger x", "de", "b"), ("a b c d x", "de", None), ("x a b", "de", ""), ("x", "de", "lone"),
        (None, "de", "silent"), ("", "de", "silent"), ("123 !!", "de", "silent"), ("x x x", None, "a"), ("x y z", "", "b"), ("only one", "fr", "z"),
        (None, None, None), ("x a b", "de", "b"), ("x a b", "de", "b"), ("É é é \U0001f600", "en", "q"), ("é é", "en", "r"), ("é", "en", "q"), ("é \U0001f600", "en", "s"),
    ]
    assert audited(spark, rows) == brute(rows)
    # a language without kept terms has pairs of value 0, one of a single source none
    assert {r[4] for r in brute([("a", "x", "1"), ("b", "x", "2")])} == {0}
    assert audited(spark, [("a", "x", "1"), ("b", "x", "2")]) == brute([("a", "x", "1"), ("b", "x", "2")])
    assert audited(spark, [("a b a", "x", "1")] * 3) == brute([("a b a", "x", "1")] * 3)
    assert audited(spark, []) == set()


def test_long_texts_and_flushes(spark, monkeypatch):
    monkeypatch.setattr(sd, "PIECE", 50)
    monkeypatch.setattr(sd, "HELD", 7)
    rows = [(" ".join(f"w{chr(97 + (i * k) % 23)}x" for i in range(4000)), "en", f"s{k % 3}") for k in range(1, 9)]
    # the settings reach the workers with the function's globals only in this process: count here, too
    import pyarrow as pa

    batch = pa.record_batch({"lang": ["en"] * 8, "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    got = defaultdict(lambda: [0, 0])
    for part in sd._count_terms(iter([batch])):
        for r in part.to_pylist():
            got[r["source"], r["term"]][0] += r["n"]
            got[r["source"], r["term"]][1] += r["docs"]
    want = defaultdict(lambda: [0, 0])
    for text, _, source in rows:
        for t, n in Counter(TERM.findall(text)).items():
            want[source, t][0] += n
            want[source, t][1] += 1
    assert {k: v for k, v in got.items() if k[1]} == dict(want)
    assert audited(spark, rows) == brute(rows)


def test_shared_paths_are_one_node(spark):
    # 30 terms with the same row of counts share their nodes
    text = " ".join(chr(97 + i // 26) + chr(97 + i % 26) for i in range(30))
    rows = [(text, "en", s) for s in ("a", "b", "c")] * 3
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    nodes = sd.tree(sd.term_rows(sd.count_terms(df))).collect()
    assert sorted((len(n.prefix), n.terms) for n in nodes) == [(1, 30), (2, 30), (3, 30)]
    assert audited(spark, rows) == brute(rows)
