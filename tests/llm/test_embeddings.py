"""Multi-index search against brute force, whitening against a direct eigendecomposition."""

import itertools
import math

import numpy as np
import pytest

from ticketloom.llm import multi_index as mi
from ticketloom.llm import whitening as wh

SCHEMA = "vec_id long, embedding array<float>, label int, n string, ids int, j string, component int, part int"
NAN, INF = float("nan"), float("inf")


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 2, "y", 3, 4) for i, v in rows], SCHEMA)


def usable(rows, zero=True):
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in rows]
    most = max(sizes, key=lambda s: (sizes.count(s), s), default=0)
    return [(i, np.array(v, np.float32).astype(float)) for i, v in rows if len(v) == most and (zero or any(v))]


def brute(rows, k=10):
    rows = [(i, v) for i, v in usable(rows, zero=False) if i is not None]
    rows = list({(i, v.tobytes()): (i, v) for i, v in rows}.values())
    out = []
    for n, (q, v) in enumerate(rows):
        if q % 100 == 0:
            found = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for m, (i, w) in enumerate(rows) if m != n)[:k]
            out += [(q, r + 1, i, s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def search(spark, rows, **how):
    return sorted(tuple(r) for r in mi.nearest(table(spark, rows), **how).collect())


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = search(spark, rows, every=7)
    data = {i: np.array(v, float) for i, v in rows}
    hits = total = 0
    for q, group in itertools.groupby(got, key=lambda r: r[0]):
        group = list(group)
        assert [r[1] for r in group] == list(range(1, 11)) and [(s, i) for _, _, i, s in group] == sorted((s, i) for _, _, i, s in group)
        assert all(abs(float(np.sqrt(((data[q] - data[i]) ** 2).sum())) - s) < 1e-12 and i != q for _, _, i, s in group)
        want = sorted((float(np.sqrt(((data[q] - w) ** 2).sum())), i) for i, w in data.items() if i != q)[:10]
        hits += len({i for _, i in want} & {r[2] for r in group})
        total += 10
    assert total == 10 * len([i for i in data if i % 7 == 0]) and hits / total >= 0.9


def test_odd_vectors_ties_and_copies(spark):
    rng = np.random.default_rng(1)
    point = [1.0, 2.0, 3.0]
    rows = [(100 * i, (point if i % 3 else [0.5, -1.0, float(i)])) for i in range(40)] + [(i, point) for i in range(1, 60)]
    rows += [(200, None), (300, [0.0, 0.0, 0.0]), (400, [1.0, None, 2.0]), (500, [NAN, 1.0, 1.0]), (600, [INF, 0.0, 1.0]), (700, []), (800, [1.0, 2.0]), (None, point)]
    rows += [(100, point), (100, point), (100, [9.0, 9.0, 9.0]), (7, [9.0, 9.0, 9.0])] + [(1000 + i, rng.normal(size=3).tolist()) for i in range(50)]
    # with every cell visited the search is exact
    small = search(spark, rows, centroids=1)
    assert [r[:3] for r in small] == [r[:3] for r in brute(rows)]
    assert np.allclose([r[3] for r in small], [r[3] for r in brute(rows)], rtol=1e-14)
    assert search(spark, []) == [] and search(spark, [(0, point)]) == [] and search(spark, [(0, None)]) == []
    assert search(spark, [(0, [1.0]), (1, [3.0]), (2, [2.0])]) == [(0, 1, 2, 1.0), (0, 2, 1, 2.0)]


def test_cells_come_in_order_of_their_sums():
    rng = np.random.default_rng(2)
    for n, m in ((1, 1), (1, 7), (9, 1), (12, 15)):
        a, b = rng.integers(0, 9, n).astype(float), rng.random(m)
        cells = list(mi.cells_by_distance(a, b))
        sums = [a[i] + b[j] for i, j in cells]
        assert len(set(cells)) == n * m and sums == sorted(sums)


def test_spectrum_equals_direct_decomposition():
    rng = np.random.default_rng(3)
    cases = [
        rng.normal(size=(400, 24)) * 100, np.floor(rng.normal(size=(300, 6)) * 3), np.repeat(rng.normal(size=(3, 10)), 40, 0), np.eye(12)[rng.integers(0, 12, 200)],
        rng.normal(size=(200, 5)) * np.array([1, 1e-8, 1e8, 1, 0]), rng.normal(size=(50, 1)), np.ones((5, 4)), rng.normal(size=(1, 4)), rng.integers(0, 2, (300, 9)) * 1.0,
    ]
    for x in cases:
        whole, parts = wh.Spectrum(x.shape[1]), wh.Spectrum(x.shape[1])
        for row in x:
            whole.add(row)
        for part in np.array_split(x, 3):
            own = wh.Spectrum(x.shape[1])
            for row in part:
                own.add(row)
            parts.merge(own.n, own.mean, own.values, own.vectors)
        scatter = (x - x.mean(0)).T @ (x - x.mean(0))
        scale = max(np.linalg.norm(scatter, 2), 1e-300)
        for s in (whole, parts):
            assert s.n == len(x) and np.allclose(s.mean, x.mean(0))
            assert np.abs(s.vectors.T @ s.vectors - np.eye(s.values.size)).max(initial=0) < 1e-12
            assert np.abs(s.vectors * s.values @ s.vectors.T - scatter).max() < 1e-12 * scale


def whitened(spark, rows, **how):
    return wh.whiten(table(spark, rows), **how).collect()


def check(rows, got, k=8):
    rows = usable(rows)
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    off = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    values, vectors = np.linalg.eigh(off.T @ off / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert len(got) == n * k and {r.n for r in got} == {n}
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    assert sorted(((r.vec_id, r.component, r.deviation) for r in got), key=key) == sorted(((i, c, d) for (i, _), d in zip(rows, deviation, strict=True) for c in range(1, k + 1)), key=key)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    for c in range(1, k + 1):
        mine = sorted(((r.deviation, abs(r.whitened)) for r in got if r.component == c))
        want = sorted((d, abs(float(o @ vectors[:, c - 1] / np.sqrt(values[c - 1])))) for d, o in zip(deviation, off, strict=True))
        assert np.allclose([m[1] for m in mine], [w[1] for w in want], atol=1e-9)
        assert all(abs(r.explained - values[c - 1] / values.sum()) < 1e-12 for r in got if r.component == c)


def test_whitening_equals_direct_decomposition(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.repartition(11).collect()]
    check(rows, whitened(spark, rows))


def test_refinement_mends_a_short_spectrum(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=40) * np.linspace(0.05, 0.6, 40)).tolist()) for i in range(300)]
    check(rows, whitened(spark, rows, keep=10))


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 20, rng.normal(size=3).tolist()) for i in range(60)]
    rows += [(1, None), (2, []), (3, [1.0, None, 1.0]), (4, [NAN, 0.0, 0.0]), (5, [INF, 0.0, 0.0]), (6, [1.0, 2.0]), (None, [0.0, 0.0, 0.0]), rows[0], rows[0]]
    check(rows, whitened(spark, rows))
    flat = [(i, [float(i), 2.0 * i, 0.25]) for i in range(9)]  # one direction only
    check(flat, whitened(spark, flat))
    assert whitened(spark, []) == [] and whitened(spark, [(1, None)]) == []
    assert whitened(spark, [(1, [1.0, 2.0])]) == [] and whitened(spark, [(1, [1.0, 2.0])] * 5) == []
    huge = [(i, [1e30 * (i % 2), float(i)]) for i in range(8)]
    assert {r.deviation for r in whitened(spark, huge)} == {None}


@pytest.mark.parametrize("n", [1, 2, 30])
def test_roots_interlace(n):
    rng = np.random.default_rng(n)
    d = np.sort(rng.random(n))
    zz = rng.random(n) ** 8 + 1e-20
    away = wh.secular_roots(d, zz)
    roots = np.linalg.eigvalsh(np.diag(d) + np.sqrt(np.outer(zz, zz)))
    assert np.allclose(d[:, None] - away, roots, atol=1e-13)
