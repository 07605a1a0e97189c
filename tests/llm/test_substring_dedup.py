import random

import numpy as np

from ticketloom.llm import substring_dedup as sd

RNG = random.Random(5)


def prose(n, tag):
    return [f"{tag}{RNG.randrange(10**6)}" for _ in range(n)]


def spans(df):
    return sorted((r.doc_id, r.start_word, r.end_word, r.src_doc_id, r.src_start_word, r.src_end_word) for r in df.collect())


def test_exact_and_fuzzy_passages_and_clean_documents(make):
    passage, other = prose(60, "p"), prose(90, "o")
    fuzzy = other[:30] + ["new"] + other[31:60] + other[62:]
    rows = [
        (1, " ".join(prose(40, "a") + passage + prose(20, "a"))),
        (2, " ".join(prose(7, "b") + passage + prose(90, "b"))),
        (3, " ".join(w.upper() for w in passage) + "\n"),
        (4, " ".join(other)),
        (5, " ".join(prose(11, "c") + fuzzy + prose(5, "c"))),
        (6, " ".join(prose(300, "d"))),
        (7, " ".join(prose(10, "e") + passage[:45] + prose(10, "e"))),
        (8, " ".join(passage + passage)),
    ]
    got = spans(sd.repeated_passages(make(rows)))
    assert got[:2] == [(2, 7, 67, 1, 40, 100), (3, 0, 60, 1, 40, 100)]
    assert [g for g in got if g[0] == 5] == [(5, 11, 11 + 88, 4, 0, 90)]
    assert {g[0] for g in got} == {2, 3, 5, 8}
    cut = {r.doc_id: r.text for r in sd.without_passages(make(rows), sd.repeated_passages(make(rows))).collect()}
    assert cut[3] == "" and len(cut[2].split()) == 97 and cut[1] == rows[0][1] and cut[6] == rows[5][1]


def test_odd_tables(make):
    text = " ".join(prose(80, "x"))
    same = " ".join(["go"] * 120)
    rows = [(None, text), (3, text), (3, text), (4, None), (5, ""), (6, "short"), (7, text), (8, same), (9, same)]
    found = sd.repeated_passages(make(rows))
    assert {(r.doc_id, r.src_doc_id) for r in found.collect()} == {(7, 3), (9, 8)}
    cut = sd.without_passages(make(rows), found)
    assert cut.columns == make(rows).columns and cut.count() == len(rows)
    assert {r.doc_id: r.text for r in cut.collect()}[4] is None
    assert sd.repeated_passages(make([])).count() == 0


def test_chains_have_the_best_score():
    rng = np.random.default_rng(3)

    def best(p, q):
        runs = list(zip(*(x.tolist() for x in sd._runs(p, q, 0)), strict=True))
        f = []
        for i, (a, z, b) in enumerate(runs):
            value = z - a + sd.K
            for j, (c, y, d) in enumerate(runs[:i]):
                if y < a and d + y - c < b:
                    value = max(value, z - a + sd.K + f[j] - sd.GAP_COST * (a - y + b - d - y + c - 2 * sd.K))
            f.append(value)
        return max(f)

    def score(chain):
        total = chain[0][1] - chain[0][0] + sd.K
        for (c, y, d), (a, z, b) in zip(chain, chain[1:], strict=False):
            assert y < a and d + y - c < b
            total += z - a + sd.K - sd.GAP_COST * (a - y + b - d - y + c - 2 * sd.K)
        return total

    for _ in range(50):
        p = np.sort(rng.choice(60, 12, replace=False))
        q = rng.choice(60, 12, replace=False)
        assert abs(max(map(score, sd.chains(p, q))) - best(p, q)) < 1e-9


def test_given_documents_are_covered(documents):
    """Every run of 50 words that an earlier document has is inside reported passages."""
    from tests.llm.test_text_arrays import WORD, lower

    texts = {r.doc_id: WORD.findall(lower(r.text or "")) for r in documents.collect()}
    covered, first = {}, {}
    for r in sd.repeated_passages(documents).collect():
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for d in sorted(texts):
        runs = {tuple(texts[d][i : i + 50]): i for i in range(len(texts[d]) - 49)}
        for run, i in runs.items():
            if first.setdefault(run, d) != d:
                assert set(range(i, i + 50)) <= covered.get(d, set())


def covers_all_runs(texts, found, n=50):
    """Whether every run of n words that an earlier document has is inside reported passages."""
    covered, first = {}, {}
    for r in found:
        covered.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    for d in sorted(texts):
        for i in range(len(texts[d]) - n + 1):
            if first.setdefault(tuple(texts[d][i : i + n]), d) != d and not set(range(i, i + n)) <= covered.get(d, set()):
                return False
    return True


def test_passages_split_over_several_first_sources(make):
    s1, s2, s3 = prose(30, "s"), prose(30, "t"), prose(26, "u")
    texts = {
        1: prose(50, "a") + s1 + prose(50, "a"), 2: prose(20, "b") + s2 + prose(60, "b"), 3: s1 + s2, 4: prose(9, "c") + s1 + s2,
        5: prose(60, "d") + s3 + prose(70, "d"), 6: prose(31, "e") + s2[5:] + s3 + prose(8, "e"), 7: s2[5:] + s3[:25], 8: s1 + s2 + prose(90, "f") + s1 + s2,
    }
    found = sd.repeated_passages(make([(d, " ".join(t)) for d, t in texts.items()])).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.src_doc_id) for r in found} >= {(4, 9, 69, 3), (7, 0, 50, 6), (8, 0, 60, 3), (8, 150, 210, 3)}
    assert {r.doc_id for r in found} == {4, 7, 8} and covers_all_runs(texts, found)


def test_parts_of_a_chain_that_misses_the_identity(make):
    a, b, c, d, e = (prose(n, "v") for n in (60, 40, 55, 55, 60))
    texts = {
        1: prose(10, "a") + a + prose(40, "g") + b + prose(9, "a"), 2: prose(30, "b") + a + prose(40, "h") + b + prose(5, "b"),
        3: c + prose(50, "i") + d, 4: prose(8, "c") + c + prose(50, "j") + d,
        5: e + prose(20, "k") + a[:30] + b[:25], 6: e + prose(60, "l"),
    }
    found = sd.repeated_passages(make([(k, " ".join(t)) for k, t in texts.items()])).collect()
    got = {(r.doc_id, r.start_word, r.end_word, r.src_doc_id, r.src_start_word) for r in found}
    assert got == {(2, 30, 90, 1, 10), (4, 8, 63, 3, 0), (4, 113, 168, 3, 105), (6, 0, 60, 5, 0)}
    assert all(r.identity >= 0.8 and r.end_word - r.start_word >= 50 for r in found) and covers_all_runs(texts, found)


def test_passages_of_random_chains_hold_their_equal_runs():
    rng = np.random.default_rng(8)
    for _ in range(200):
        x, y, runs = [], [], []
        for _ in range(rng.integers(1, 7)):
            same = rng.integers(0, 1 << 60, rng.integers(8, 90)).tolist()
            runs.append((len(x), len(x) + len(same) - sd.K, len(y)))
            x += same + rng.integers(0, 1 << 60, rng.integers(1, 60)).tolist()
            y += same + rng.integers(0, 1 << 60, rng.integers(1, 60)).tolist()
        found = sd.passages(np.array(x), np.array(y), runs, 50, 0.8)
        for s, e, t, u, matches in found:
            assert e - s >= 50 and matches / max(e - s, u - t) >= 0.8 and matches <= len(set(x[s:e]) & set(y[t:u]))
        for first, last, other in runs:
            if last + sd.K - first >= 50:
                assert any(s <= first and last + sd.K <= e and t <= other for s, e, t, u, _ in found)


def test_each_copy_in_a_document_is_found(make):
    passage = prose(90, "p")
    fuzzy = [w if i % 35 else "new" for i, w in enumerate(passage[1:], 1)]  # equal runs of 34 words
    rows = [(1, " ".join(prose(20, "a") + passage)), (2, " ".join(prose(10, "b") + fuzzy + prose(200, "b") + fuzzy + prose(7, "b") + passage))]
    found = spans(sd.repeated_passages(make(rows)))
    assert found == [(2, 10, 99, 1, 21, 110), (2, 299, 388, 1, 21, 110), (2, 395, 485, 1, 20, 110)]


def test_ends_of_many_chains_extend_like_one():
    rng = np.random.default_rng(8)
    pairs = []
    for _ in range(300):
        a = rng.integers(10, 10 + rng.integers(2, 60), rng.integers(0, sd.REACH + 1)).astype(np.uint64)
        b = np.delete(a, rng.integers(0, max(a.size, 1), 2) % max(a.size, 1)) if a.size and rng.random() < 0.5 else a.copy()
        b = np.concatenate([b, rng.integers(10, 60, sd.REACH).astype(np.uint64)])[: rng.integers(0, sd.REACH + 1)]
        if b.size and rng.random() < 0.5:
            b[rng.integers(0, b.size)] = 5
        pairs.append((a, b))
    pairs += [(pairs[0][0][:0], pairs[0][1][:0]), (np.arange(48, dtype=np.uint64) + 3, np.arange(48, dtype=np.uint64) + 3)]
    assert sd.extend_all(pairs) == [tuple(map(int, sd._extend(a, b))) for a, b in pairs] and sd.extend_all([]) == []
