"""Embedding whitening by incremental eigendecomposition.

Each task keeps the eigenvalues and eigenvectors of the scatter of the rows it has seen. A row changes the
scatter by one centred rank-one term, so the new eigenvalues are the roots of a secular equation and the new
vectors follow from them; directions that the term doesn't touch, and equal eigenvalues, are deflated
first. The tasks' spectra are merged in a tree: each eigenpair of one is a rank-one update of the other, and
so is the difference of their means. The merged vectors start a Rayleigh-Ritz refinement: the exactly
centred covariance is applied to them in a distributed pass, and their residuals are added to the basis
until the leading pairs are accurate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.session import materialize

#: Components, eigenpairs that a spectrum keeps (all, for vectors of at most so many entries), spectra merged at once.
COMPONENTS, KEEP, FAN_IN = 8, 128, 8
#: Residual (relative to the first eigenvalue) that ends the refinement; its most rounds; columns of its basis.
ACCURACY, ROUNDS, BASIS = 1e-13, 40, 256
#: The stored integer of an entry c is floor(SCALE * c) + SHIFT, with SCALE * c kept within LIMIT.
SCALE, SHIFT, LIMIT = 1024, 100_000, 2.0**40
_EPS = np.finfo(float).eps


def secular_roots(d: np.ndarray, zz: np.ndarray) -> np.ndarray:
    """L[i, j] = d[i] - root[j] of 1 + sum(zz / (d - x)) = 0, for ascending different d and positive zz.

    Each root lies between d[j] and the next (the last one: at most sum(zz) above). It is found relative to
    the nearer of the two, so small differences keep their digits.
    """
    k = d.size
    upper = np.append(d[1:], d[-1] + zz.sum())
    middle = d + (upper - d) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        left = 1 + (zz[:, None] / (d[:, None] - middle)).sum(0) >= 0
    left[-1] = True
    origin = np.where(left, d, upper)
    delta = d[:, None] - origin
    gap = upper - d
    low, high = np.where(left, 0.0, -gap / 2), np.where(left, gap / 2, 0.0)
    high[-1] = gap[-1]
    mu = (low + high) / 2
    pole_1, pole_2 = d - origin, upper - origin
    below = np.arange(k)[:, None] <= np.arange(k)
    for _ in range(80):
        diff = delta - mu
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            term = zz[:, None] / diff
            slope = term / diff
        f = 1 + term.sum(0)
        done = (np.abs(f) <= 4 * _EPS * k * (1 + np.abs(term).sum(0))) | (high - low <= 2 * _EPS * np.maximum(np.abs(low), np.abs(high)))
        if done.all():
            break
        low, high = np.where(f < 0, mu, low), np.where(f > 0, mu, high)
        # two-pole interpolation of the rising and the falling part, kept inside the bracket
        s1, s2 = np.where(below, slope, 0).sum(0), np.where(below, 0, slope).sum(0)
        a1, a2 = pole_1 - mu, pole_2 - mu
        c = f - a1 * s1 - a2 * s2
        a = (a1 + a2) * f - a1 * a2 * (s1 + s2)
        b = a1 * a2 * f
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = mu + step
        new = np.where(np.isfinite(new) & (new > low) & (new < high), new, (low + high) / 2)
        mu = np.where(done, mu, new)
    return delta - mu


class Spectrum:
    """Count, mean, and eigenpairs (values ascending, vectors as columns) of a scatter around the mean."""

    def __init__(self, dims: int, keep: int = KEEP):
        self.n, self.mean, self.keep = 0, np.zeros(dims), min(keep, dims)
        self.values, self.vectors = np.zeros(0), np.zeros((dims, 0))

    def add(self, row: np.ndarray) -> None:
        self.n += 1
        off = row - self.mean
        self.mean = self.mean + off / self.n
        self.rank_one(off * np.sqrt((self.n - 1) / self.n))

    def merge(self, n: int, mean: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        if not n:
            return
        for value, vector in zip(values, vectors.T, strict=True):
            self.rank_one(np.sqrt(max(value, 0.0)) * vector)
        total = self.n + n
        off = mean - self.mean
        self.rank_one(off * np.sqrt(self.n / total * n))
        self.mean = self.mean + off * (n / total)
        self.n = total

    def rank_one(self, v: np.ndarray) -> None:
        """Adds the outer product of ``v`` with itself."""
        size = float(np.sqrt(v @ v))
        if size == 0:
            return
        d, u = self.values, self.vectors
        z = u.T @ v
        if u.shape[1] < u.shape[0]:
            rest = v - u @ z
            again = u.T @ rest
            rest, z = rest - u @ again, z + again
            beta = float(np.sqrt(rest @ rest))
            if beta > 1e-12 * size:
                u, d, z = np.column_stack([rest / beta, u]), np.append(0.0, d), np.append(beta, z)
        order = np.argsort(d, kind="stable")
        d, z, u = d[order], z[order], u[:, order]
        tiny = 8 * _EPS * max(float(np.abs(d).max(initial=0)), size * size)
        moved = np.abs(z) * size > tiny
        at = np.flatnonzero(moved)
        if at.size > 1 and (np.diff(d[at]) <= 2 * np.sqrt(_EPS) * max(d[-1], size * size)).any():
            d, z, u = d.copy(), z.copy(), u.copy()
            last = at[0]
            for j in at[1:]:  # turns the part of one of two equal eigenvalues to zero
                r = np.hypot(z[last], z[j])
                c, s = z[j] / r, z[last] / r
                if abs((d[j] - d[last]) * c * s) <= tiny:
                    moved[last] = False
                    u[:, [last, j]] = np.column_stack([c * u[:, last] - s * u[:, j], s * u[:, last] + c * u[:, j]])
                    d[last], d[j] = c * c * d[last] + s * s * d[j], s * s * d[last] + c * c * d[j]
                    z[last], z[j] = 0.0, r
                last = j
            at = np.flatnonzero(moved)
        if at.size:
            active = np.argsort(d[at], kind="stable")
            at = at[active]
            poles = d[at]
            away = secular_roots(poles, z[at] ** 2)  # poles[i] - root[j]
            # the vector for which these roots are exact, so that the new vectors are orthogonal
            gaps = poles[None, :] - poles[:, None]
            k = at.size
            ratio = np.ones((k, k))
            lower, higher = np.tril_indices(k, -1), np.triu_indices(k)
            ratio[lower] = -away[lower] / gaps[lower]
            higher = (higher[0][higher[1] < k - 1], higher[1][higher[1] < k - 1])
            ratio[higher] = -away[higher] / gaps[higher[0], higher[1] + 1]
            exact = np.sqrt(np.maximum(ratio.prod(1) * -away[:, -1], 0)) * np.where(z[at] < 0, -1, 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                turn = exact[:, None] / away
            bad = ~np.isfinite(turn).all(0)
            turn[:, bad] = np.eye(k)[:, bad]
            turn /= np.sqrt((turn * turn).sum(0))
            near = np.argmin(np.abs(away), 0)
            d, u = d.copy(), u.copy()
            d[at] = poles[near] - away[near, np.arange(k)]
            u[:, at] = u[:, at] @ turn
            order = np.argsort(d, kind="stable")
            d, u = d[order], u[:, order]
        if d.size > self.keep:
            d, u = d[-self.keep :], u[:, -self.keep :]
        self.values, self.vectors = d, u

    def batch(self, part: int, sums: list[int]) -> pa.RecordBatch:
        return pa.record_batch(
            {
                "part": pa.array([part], pa.int64()),
                "n": pa.array([self.n], pa.int64()),
                "sums": pa.array([[str(s) for s in sums]], pa.list_(pa.string())),
                "mean": pa.array([self.mean], pa.list_(pa.float64())),
                "values": pa.array([self.values], pa.list_(pa.float64())),
                "vectors": pa.array([self.vectors.ravel()], pa.list_(pa.float64())),
            }
        )


_SPECTRUM = "part long, n long, sums array<string>, mean array<double>, values array<double>, vectors array<double>"


def integers(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    """The stored integers of the batch's vectors, one line each."""
    values = batch.column("_vector").flatten().to_numpy(zero_copy_only=False).astype(float)
    return np.floor(np.clip(values * SCALE, -LIMIT, LIMIT)).astype(np.int64).reshape(-1, dims) + SHIFT


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, as Python integers where 64 bits don't hold it."""
    if x.size and int(np.abs(x).max()) * n + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def usable(embeddings: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """The rows that take part, with the column ``_vector``, and the length of their vectors."""
    value = F.col(vector)
    bad = F.exists(value, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = embeddings.withColumn("_vector", value.cast("array<double>")).where(value.isNotNull() & (F.size(value) > 0) & ~bad)
    found = rows.groupBy(F.size("_vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = found["dims"] if found else 0
    return rows.where(F.size("_vector") == dims), dims


def spectra(rows: DataFrame, dims: int, keep: int = KEEP) -> DataFrame:
    """One spectrum for each task that has rows, with the exact sums of the integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, sums = Spectrum(dims, keep), [0] * dims
        for batch in batches:
            x = integers(batch, dims)
            if x.size:
                sums = [a + b for a, b in zip(sums, x.astype(object).sum(0) if np.abs(x).max() > 1 << 41 else x.sum(0).tolist(), strict=True)]
            for row in (x - SHIFT).astype(float):
                state.add(row)
        if state.n:
            yield state.batch(TaskContext.get().partitionId(), sums)

    return rows.select("_vector").mapInArrow(run, _SPECTRUM)


def _merge(dims: int, keep: int):
    def run(table: pa.Table) -> pa.Table:
        state, sums, rows = Spectrum(dims, keep), [0] * dims, sorted(table.to_pylist(), key=lambda r: r["part"])
        for r in rows:
            state.merge(r["n"], np.array(r["mean"]), np.array(r["values"]), np.array(r["vectors"]).reshape(dims, -1))
            sums = [a + int(b) for a, b in zip(sums, r["sums"], strict=True)]
        return pa.Table.from_batches([state.batch(rows[0]["part"], sums)])

    return run


def combined(found: DataFrame, dims: int, keep: int = KEEP) -> tuple[Spectrum, list[int]]:
    """All spectra merged, ``FAN_IN`` at a time, until one is left."""
    found = materialize(found, "spectra")
    left = found.count()
    while left > 1:
        groups = -(-left // FAN_IN)
        numbered = found.withColumn("at", F.pmod(F.xxhash64("part"), F.lit(groups)))
        found = numbered.groupBy("at").applyInArrow(_merge(dims, keep), _SPECTRUM)
        found = materialize(found, "spectra")
        left = found.count()
    row = found.first()
    state = Spectrum(dims, keep)
    state.n, state.mean, state.values = row["n"], np.array(row["mean"]), np.array(row["values"])
    state.vectors = np.array(row["vectors"]).reshape(dims, -1)
    return state, [int(s) for s in row["sums"]]


def _apply(rows: DataFrame, dims: int, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """(covariance times ``block``, trace of the covariance) in one pass; centred before multiplying."""
    held = rows.sparkSession.sparkContext.broadcast((sums, block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, block = held.value
        total, trace = np.zeros(block.shape), 0.0
        for batch in batches:
            off = _deviations(integers(batch, dims), n, sums).astype(float) / n
            total += off.T @ (off @ block)
            trace += float((off * off).sum())
        out = np.append(total.ravel(), trace)
        yield pa.record_batch({"at": np.arange(out.size, dtype=np.int32), "value": out})

    found = rows.select("_vector").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(block.size + 1)
    for r in found:  # dims x columns numbers
        out[r["at"]] = r["value"]
    return out[:-1].reshape(block.shape) / n, out[-1] / n


def refine(rows: DataFrame, dims: int, n: int, sums: list[int], start: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(values, vectors, trace) of the ``k`` leading eigenpairs, by Rayleigh-Ritz on a growing basis."""
    basis, _ = np.linalg.qr(start)
    image, trace = _apply(rows, dims, n, sums, basis)
    for _ in range(ROUNDS):
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        vectors = basis @ turn
        rest = image @ turn - vectors * values
        top = rest[:, :k]
        if np.sqrt((top * top).sum(0)).max(initial=0) <= ACCURACY * max(values[0], 0) or basis.shape[1] >= dims:
            break
        if basis.shape[1] > BASIS - k:
            keep = 2 * k
            basis, image, rest = vectors[:, :keep], image @ turn[:, :keep], rest[:, :keep]
        new = rest[:, : 2 * k]
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        new, scale = np.linalg.qr(new)
        new = new[:, np.abs(np.diag(scale)) > 1e-3 * ACCURACY * max(values[0], 0)][:, : dims - basis.shape[1]]
        if not new.shape[1]:
            break
        new, _ = np.linalg.qr(new - basis @ (basis.T @ new))
        more, _ = _apply(rows, dims, n, sums, new)
        basis, image = np.column_stack([basis, new]), np.column_stack([image, more])
    return values[:k], vectors[:, :k], trace


def whiten(embeddings: DataFrame, k: int = COMPONENTS, keep: int = KEEP, vector: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of each row and leading component.

    Rows whose vector is null, empty, or holds null or non-finite entries take no part; neither do rows
    whose vector has another length than most (ties: the longer). Null and repeated vec_id stay as they are and repeated rows count each
    time. Components whose eigenvalue is at rounding level (1e-12 of the first, or equal vectors throughout)
    can't be scaled to one and are left out, so there may be fewer than ``k``, or no rows at all; so without
    rows. Entries beyond 2^30 count as that. A deviation that 64 bits don't hold is null. Other columns are
    ignored.
    """
    spark = embeddings.sparkSession
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows, dims = usable(embeddings.select("vec_id", vector), vector)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "_vector")
    if not dims:
        return spark.createDataFrame([], schema)
    state, sums = combined(spectra(rows, dims, keep), dims, keep)
    n = state.n
    if not state.values.size:
        return spark.createDataFrame([], schema)
    start = state.vectors[:, ::-1][:, : min(2 * k, dims)]
    values, vectors, trace = refine(rows, dims, n, sums, start, min(k, start.shape[1]))
    good = values > 1e-12 * max(values[0], 0)
    values, vectors = values[good], vectors[:, good]
    held = spark.sparkContext.broadcast((sums, vectors / np.sqrt(values), values / trace))
    size = int(good.sum())

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scaled, _ = held.value
        total = np.zeros((size + 1, size))
        for batch in batches:
            white = _deviations(integers(batch, dims), n, sums).astype(float) / n @ scaled
            total[:-1] += white.T @ white
            total[-1] += white.sum(0)
        yield pa.record_batch({"at": np.arange(total.size, dtype=np.int32), "value": total.ravel()})

    found = rows.select("_vector").mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
    flat = np.zeros((size + 1) * size)
    for r in found:
        flat[r["at"]] = r["value"]
    flat = flat.reshape(size + 1, size) / n
    error = float(np.abs(flat[:-1] - np.outer(flat[-1], flat[-1]) - np.eye(size)).max(initial=0))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, scaled, explained = held.value
        for batch in batches:
            if not batch.num_rows:
                continue
            off = _deviations(integers(batch, dims), n, sums)
            if off.dtype != object and int(np.abs(off).max()) ** 2 * dims < 1 << 63:
                deviation = pa.array((off * off).sum(1), pa.int64())
            else:
                exact = (off.astype(object) ** 2).sum(1)
                deviation = pa.array([int(s) if s < 1 << 63 else None for s in exact], pa.int64())
            white = off.astype(float) / n @ scaled
            each = np.repeat(np.arange(batch.num_rows), size)
            yield pa.record_batch(
                {
                    "vec_id": batch.column("vec_id").take(pa.array(each)),
                    "component": np.tile(np.arange(1, size + 1, dtype=np.int32), batch.num_rows),
                    "n": np.full(each.size, n, np.int64),
                    "deviation": deviation.take(pa.array(each)),
                    "whitened": white.ravel(),
                    "explained": np.tile(explained, batch.num_rows),
                    "identity_error": np.full(each.size, error),
                }
            )

    return rows.mapInArrow(project, schema)
