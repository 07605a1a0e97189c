import random
from fractions import Fraction

import numpy as np
import pytest

from tests.llm.test_text_arrays import WORD, lower
from ticketloom.llm import ngram_jaccard as nj


def brute(rows, n, t):
    t = Fraction(str(t))
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and both >= t * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def result(df):
    rows = df.collect()
    assert len({r.doc_id for r in rows}) == len(rows)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in rows}


def edited(words, k, rng):
    words = list(words)
    for _ in range(k):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[], ["new"], [words[at], "more"]])
    return " ".join(words)


@pytest.mark.parametrize(("n", "t"), [(3, 0.9), (2, 0.5)])
def test_equals_brute_force(make, monkeypatch, n, t):
    monkeypatch.setattr(nj, "BLOCK_ROWS", 16)
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(1000 + i, x) for i, x in enumerate([None, "", " \n", "a", "A", "a b", "a b c", "A  B\tC", "a b c d", "b b b b b b"])]
    for g in range(4):
        base = rng.choices(vocabulary, k=rng.choice([6, 12, 40, 200]))
        rows += [(100 * g + i, edited(base, rng.choice([0, 0, 1, 2, 5, 9]), rng)) for i in range(40)]
    assert result(nj.jaccard_components(make(rows), n, t)) == brute(rows, n, t)


def test_given_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    assert result(nj.jaccard_components(documents, 3, 0.9)) == brute(rows, 3, 0.9)


@pytest.mark.parametrize(("key_bytes", "name_bytes"), [(1, 6), (5, 1)])
def test_shortened_keys_and_names_only_add_candidates(make, monkeypatch, key_bytes, name_bytes):
    monkeypatch.setattr(nj, "KEY_BYTES", key_bytes)
    monkeypatch.setattr(nj, "NAME_BYTES", name_bytes)
    rng = random.Random(5)
    base = [rng.choices([f"w{i}" for i in range(60)], k=40) for _ in range(60)]
    rows = [(100 * g + i, edited(words, i, rng)) for g, words in enumerate(base) for i in range(5)]
    assert result(nj.jaccard_components(make(rows), 3, 0.8)) == brute(rows, 3, 0.8)


def test_what_a_cluster_writes_grows_with_its_rows(make, monkeypatch):
    """One cluster of 300 sets in blocks of 16: each set's members leave once, whatever number of blocks there is."""
    monkeypatch.setattr(nj, "BLOCK_ROWS", 16)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    rows = [(i, edited(base, 3, rng)) for i in range(300)]
    kept, cut = [], nj.cut_lineage
    monkeypatch.setattr(nj, "cut_lineage", lambda df: kept.append(cut(df)) or kept[-1])
    assert result(nj.jaccard_components(make(rows), 3, 0.8)) == brute(rows, 3, 0.8)
    blocks = kept[0].where("members is not null").collect()
    held = np.concatenate([np.frombuffer(r.sets, np.int64) for r in blocks])
    assert len(blocks) > 10 and held.size == np.unique(held).size <= 300
    assert all(len(r.members) == 8 * np.frombuffer(r.sizes, np.int64).sum() for r in blocks)


def test_empty_table_repeated_rows_and_missing_ids(make):
    assert nj.jaccard_components(make([])).count() == 0
    text = "one two three four five six seven"
    got = nj.jaccard_components(make([(7, text), (7, text), (None, text), (9, text), (None, "alone here"), (None, None)])).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7), (9, 7)]


def test_size_intervals_leave_no_pair_out():
    t = Fraction(9, 10)
    table = nj.size_intervals(t)
    place = lambda n: next(i for i, x in enumerate(table) if x[0] <= n <= x[1])
    for b in range(1, 400):
        for a in range(-(-b * 9 // 10), b + 1):
            assert place(b) - place(a) <= 1
            both = place(b)
            if table[both][2] > 0:
                assert table[both][2] - table[both][3] > (a + b) * (1 - t) / (1 + t) - 1e-9


def test_overlap_counts_are_the_product():
    rng = np.random.default_rng(0)
    dense = rng.random((7, 30)) < 0.3
    rows, members = np.nonzero(dense)
    product = dense.astype(int) @ dense.T.astype(int)
    assert (np.triu(nj.overlaps(members.astype(np.uint64), rows, 7), 1) == np.triu(product, 1)).all()


@pytest.mark.parametrize("share", [0, 1, 2])
def test_any_choice_of_common_columns_gives_the_same_groups(make, monkeypatch, share):
    """The sample only picks columns that the candidate blocks leave out: none, all or every second will do."""
    rng = random.Random(share)
    words = [f"w{i}" for i in range(400)]
    texts = [edited(words[k * 40 : k * 40 + 60], rng.choice([0, 1, 2]), rng) for k in range(8) for _ in range(5)]
    rows = list(enumerate(texts + ["", None, "one two"]))
    docs = make(rows)

    def chosen(docs, n, total, intervals):
        found = [nj.ta.mix(np.zeros(0, np.uint64))]
        for batch in docs.select("text").toArrow().to_batches():
            found += [members for _, _, members, _ in nj._rows(batch, n)]
        every = np.unique(np.concatenate(found))
        return every[:: share] if share else every[:0]

    monkeypatch.setattr(nj, "_common_columns", chosen)
    assert result(nj.jaccard_components(docs, 3, 0.8)) == brute(rows, 3, 0.8)
