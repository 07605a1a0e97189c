import hashlib
import random

from ticketloom.llm import edit_embedding as ee
from ticketloom.llm.text_arrays import mix
import numpy as np


def walk(text):
    """Character by character, as the module's text says."""
    symbols, at, out, t = ee._symbols(text), 0, [], 0
    while at < len(text):
        out.append(int(symbols[at]))
        at += int(ee._MOVES[t % ee.PERIOD, symbols[at]])
        t += 1
    return out


def by_hand(text):
    level = int(ee._level(np.array([len(text)]))[0])
    trace, digits, j = walk(text), "", 0
    while True:
        step = int(ee.sampled_steps(level, 4096)[j])
        if step >= len(trace):
            return f"{level}:{digits}"
        salt = int(mix(np.array([step], np.uint64))[0]) << 8 & (2**64 - 1)
        digits += "%x" % (int(mix(np.array([(trace[step] + salt) % 2**64], np.uint64))[0]) >> 60)
        j += 1


def test_fingerprints_equal_the_walk_by_hand():
    rng = random.Random(2)
    texts = ["", "a", "ab é日𝄞"] + ["".join(rng.choices("abc é日\n", k=n)) for n in (3, 60, 255, 256, 700, 3000, 9000)]
    assert ee.fingerprints(texts) == [by_hand(t) for t in texts]
    assert ee.fingerprints(texts[::-1])[::-1] == ee.fingerprints(texts)


def test_samples_of_a_level_are_among_those_below():
    for level in range(5):
        assert set(ee.sampled_steps(level + 1, 200)) <= set(ee.sampled_steps(level, 400))


def test_likeness_falls_with_edits():
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=4000))
    near = text[:1500] + text[1501:]
    prints = ee.fingerprints([text, near, text[:3000] + "".join(rng.choices("xyz", k=1000)), "".join(rng.choices("abcdefgh ", k=4000)), text + text])
    like = [ee.likeness(prints[0], p) for p in prints]
    assert like[0] == 1 and like[1] > 0.9 and 0.6 < like[2] < 0.85 and like[3] < 0.2 and 0.35 < like[4] < 0.6
    assert ee.likeness(*ee.fingerprints(["", ""])) == 1 and ee.likeness(*ee.fingerprints(["", "a"])) == 0


def want(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for (i, _), t, f in zip(rows, texts, texts[1:] + texts[:1], strict=True):
        edited = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
        p, q, n = ee.fingerprints([t, edited, f])
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), p, q, ee.likeness(p, q), ee.likeness(p, n)))
    return out


def rows_of(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[2], r[3]))


def key(r):
    return (r[0] is not None, r[0] or 0, r[2], r[3])


def test_edits_take_from_the_next_document(make, documents, monkeypatch):
    monkeypatch.setattr(ee, "GROUP_CHARS", 500)
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices("abcé日 ", k=rng.randrange(60)))) for i in rng.sample(range(1000), 120)]
    rows += [(5000, None), (5001, ""), (5001, "tie b"), (5001, "tie a"), (5001, "tie a"), (None, "no id"), (None, "no id too")]
    assert rows_of(ee.fingerprint_edits(make(rows).repartition(5))) == sorted(want(rows), key=key)
    assert rows_of(ee.fingerprint_edits(make([(3, "abcdefgh")]))) == want([(3, "abcdefgh")])
    assert ee.fingerprint_edits(make([])).count() == 0
    given = [(r.doc_id, r.text) for r in documents.collect()]
    assert rows_of(ee.fingerprint_edits(documents)) == sorted(want(given), key=key)


def test_neighbours(make):
    rng = random.Random(6)
    base = ["".join(rng.choices("abcdefghij ", k=900)) for _ in range(6)]
    rows = [(10 * g + i, t if i < 2 else t[: 400 + i] + "#" + t[400 + i :]) for g, t in enumerate(base) for i in range(4)]
    odd = [(None, base[0]), (99, None), (98, ""), (5, "a repeated id " * 20), (97, "a repeated id " * 20)]
    got = sorted((r.doc_id, r.component_id) for r in ee.edit_neighbours(make([*rows, *odd])).collect())
    assert got == sorted([(i, i // 10 * 10) for i, _ in rows] + [(99, 98), (98, 98), (5, 5), (97, 5)])
    assert ee.edit_neighbours(make([])).count() == 0


def test_small_scales_miss_nothing():
    """Up to 31 samples some window is equal, wherever the differences that the threshold allows are."""
    for n in range(6, 32):
        for m in range(n, 32):
            least = min(n, m)
            wrong = int(max(n, m) * (1 - (0.8 * 15 + 1) / 16) + 1e-9) - abs(n - m)
            if wrong >= 0:
                shared = set(ee._scales(n)) & set(ee._scales(m))
                assert any(least // s > wrong for s in shared), (n, m)


def test_recall_against_all_pairs(make):
    """Links of one edit to a fifth of the text at once, below a common beginning, at all lengths."""
    rng = random.Random(8)
    letters = "etaoin shrdlu cmfwyp"
    common = "".join(rng.choices(letters, k=400))
    rows = []
    for n in (60, 100, 250, 510, 900, 3000, 9000):
        for g in range(12):
            text = (common[: n // 2] if g % 2 else "") + "".join(rng.choices(letters, k=n))
            rows.append(text[:n])
            for edits in (1, max(1, n // 100), max(1, n // 25)):
                near = list(text[:n])
                for _ in range(edits):
                    at = rng.randrange(len(near))
                    near[at : at + rng.randrange(2)] = rng.choice(letters) * rng.randrange(2)
                rows.append("".join(near))
            rows.append(text[: n - n // 6])
    prints = ee.fingerprints(rows)
    got = {r.doc_id: r.component_id for r in ee.edit_neighbours(make(list(enumerate(rows)))).collect()}
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    found = alike = 0
    for i in range(len(rows)):
        for j in range(i):
            if ee.likeness(prints[i], prints[j]) >= 0.8:
                alike += 1
                found += got[i] == got[j]
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert alike > 300 and found >= 0.98 * alike, (found, alike)
    assert all(find(i) == find(got[i]) for i in range(len(rows)))  # no group joins what no link joins
