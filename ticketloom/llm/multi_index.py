"""Nearest neighbours through an inverted multi-index.

Vectors are cut into two halves, each with a codebook of its own, so a vector's cell is a pair of centroids.
A query visits cells in the order of the summed distances of its halves to the pair's centroids, which a
heap yields without looking at all pairs, until the cells visited hold a share of all entries. The share is
calibrated on the sample that the codebooks are fitted to, so that ``COVER`` of the true neighbours lie in
cells visited; neighbours in the whole table are nearer than in the sample and easier to reach. The
entries of the cells visited are reranked by their exact distances.

Work is dealt by (first centroid, block of its entries, chunk of queries), so no task holds more than
about ``ENTRIES`` entries and ``QUERIES`` queries, however many rows share a cell. Equal vectors are searched
once, for queries as for entries, and an entry keeps the ids that can be among the nearest of any query.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketloom.llm.whitening import usable
from ticketloom.operators.skew import hot_keys, skew_join
from ticketloom.session import materialize

#: Centroids of a half; vectors of the sample that codebooks and share are fitted to; rounds of fitting.
CENTROIDS, SAMPLE, ROUNDS = 64, 8192, 12
#: Queries of the calibration, and the part of true neighbours that it covers.
CALIBRATION, COVER = 256, 0.97
#: Entries and queries that a task holds at most (about); cells of distances at a time.
ENTRIES, QUERIES, CELLS = 8192, 4096, 1 << 21
#: Ids share a vector only if both hashes agree.
_KEY = "k1 long, k2 long"


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1), 0)


def codebook(sample: np.ndarray, k: int = CENTROIDS, rounds: int = ROUNDS) -> np.ndarray:
    """At most ``k`` centroids by Lloyd's rounds from evenly spaced rows; empty ones stay where they are."""
    points = np.unique(sample, axis=0)
    centroids = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        nearest = _squares(sample, centroids).argmin(1)
        n = np.bincount(nearest, minlength=len(centroids))
        total = np.zeros(centroids.shape)
        np.add.at(total, nearest, sample)
        centroids[n > 0] = total[n > 0] / n[n > 0, None]
    return centroids


def cells_by_distance(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, int]]:
    """All pairs (i, j) in ascending order of a[i] + b[j] (multi-sequence traversal with a heap)."""
    first, second = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    low, high = a[first].tolist(), b[second].tolist()
    first, second = first.tolist(), second.tolist()
    heap = [(low[0] + high[0], 0, 0)]
    while heap:
        _, i, j = heapq.heappop(heap)
        yield first[i], second[j]
        # (i, j + 1) follows (i, j); (i + 1, 0) follows (i, 0): each pair enters once
        if j + 1 < len(high):
            heapq.heappush(heap, (low[i] + high[j + 1], i, j + 1))
        if j == 0 and i + 1 < len(low):
            heapq.heappush(heap, (low[i + 1] + high[0], i + 1, 0))


class Index:
    """Codebooks, and how many entries each cell holds."""

    def __init__(self, sample: np.ndarray, k: int = CENTROIDS):
        self.half = (sample.shape[1] + 1) // 2
        self.books = codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)
        self.counts = np.zeros((len(self.books[0]), len(self.books[1])), np.int64)
        self.share = 1.0

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _squares(x[:, : self.half], self.books[0]), _squares(x[:, self.half :], self.books[1])

    def visit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which cells a query visits, from the distances of its halves."""
        seen, found, wanted = np.zeros(self.counts.shape, bool), 0, self.share * self.counts.sum()
        for i, j in cells_by_distance(a, b):
            seen[i, j] = True
            found += self.counts[i, j]
            if found >= wanted:
                break
        return seen

    def calibrate(self, sample: np.ndarray, k: int, queries: int = CALIBRATION, cover: float = COVER) -> None:
        """Sets the share of entries to visit: the least that covers the sample's own neighbours."""
        a, b = self.distances(sample)
        i, j = a.argmin(1), b.argmin(1)
        counts = np.zeros(self.counts.shape, np.int64)
        np.add.at(counts, (i, j), 1)
        needed = []
        step = max(1, len(sample) // queries)
        for q in range(0, len(sample), step):
            far = _squares(sample[q : q + 1], sample)[0]
            far[q] = np.inf
            near = np.argsort(far, kind="stable")[: min(k, len(sample) - 1)]
            total = (a[q][:, None] + b[q]).ravel()
            order = np.argsort(total, kind="stable")
            until = np.empty(total.size)
            until[order] = np.cumsum(counts.ravel()[order])
            needed.append(until.reshape(counts.shape)[i[near], j[near]] / len(sample))
        needed = np.concatenate(needed) if needed else np.zeros(0)
        self.share = float(np.quantile(needed, cover)) if needed.size else 1.0


def _lines(batch: pa.RecordBatch | pa.Table, column: str, dims: int) -> np.ndarray:
    values = batch.column(column)
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    return values.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims)


def fit(classes: DataFrame, dims: int, k: int, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Index:
    """Codebooks and share from the ``sample`` classes of the least hashes."""
    rows = classes.orderBy("k1", "k2").limit(sample).select("_vector").toArrow()
    vectors = _lines(rows, "_vector", dims)
    index = Index(vectors, centroids)
    index.calibrate(vectors, k)
    return index


def _assign(index, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = index.value.distances(_lines(batch, "_vector", dims))
            columns = {name: batch.column(name) for name in batch.schema.names}
            yield pa.record_batch(columns | {"i": a.argmin(1).astype(np.int32), "j": b.argmin(1).astype(np.int32)})

    return run


def _plan_visits(index, dims: int):
    """(key, vector, i, js): the cells that each query visits, one row for each first centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = index.value.distances(_lines(batch, "_vector", dims))
            for q in range(batch.num_rows):
                seen = index.value.visit(a[q], b[q]) & (index.value.counts > 0)
                rows = np.flatnonzero(seen.any(1))
                if not rows.size:
                    continue
                at = pa.array(np.full(rows.size, q))
                yield pa.record_batch(
                    {
                        "k1": batch.column("k1").take(at),
                        "k2": batch.column("k2").take(at),
                        "_vector": batch.column("_vector").take(at),
                        "i": rows.astype(np.int32),
                        "js": pa.array([np.flatnonzero(seen[r]) for r in rows], pa.list_(pa.int32())),
                    }
                )

    return run


def _rerank(dims: int, k: int):
    """The ``k`` nearest ids of each query among the entries of one block."""

    def run(entries: pa.Table, queries: pa.Table) -> pa.Table:
        x, cell = _lines(entries, "_vector", dims), entries.column("j").to_numpy()
        ids = entries.column("ids").to_pylist()
        size = (x * x).sum(1)
        out: dict[str, list] = {"row": [], "vec_id": [], "score": []}
        all_q, visited = _lines(queries, "_vector", dims), queries.column("js").to_pylist()
        width = max(int(cell.max(initial=0)) + 1, 1)
        for begin in range(0, queries.num_rows, step := max(1, CELLS // max(len(x), 1))):
            q = all_q[begin : begin + step]
            far = (q * q).sum(1)[:, None] - 2 * q @ x.T + size
            slack = 1e-9 * ((q * q).sum(1) + size.max(initial=0))
            for r in range(len(q)):
                open_cell = np.zeros(width, bool)
                wanted = np.array(visited[begin + r])
                open_cell[wanted[wanted < width]] = True
                here = np.flatnonzero(open_cell[cell])
                if not here.size:
                    continue
                d = far[r, here]
                if here.size > k:
                    # rounding may swap near ties: all within the slack are measured exactly
                    here = here[d <= np.partition(d, k - 1)[k - 1] + slack[r]]
                off = x[here] - q[r]
                score = np.sqrt((off * off).sum(1))
                near = sorted((s, i) for s, at in zip(score.tolist(), here.tolist(), strict=True) for i in ids[at])[:k]
                out["row"] += [begin + r] * len(near)
                out["score"] += [s for s, _ in near]
                out["vec_id"] += [i for _, i in near]
        at = pa.array(out["row"], pa.int64())
        keys = {c: queries.column(c).combine_chunks().take(at) for c in ("k1", "k2")}
        return pa.table(keys | {"vec_id": pa.array(out["vec_id"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    return run


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """(k1, k2, _vector, ids, queries): different vectors, their ``k`` least ids and number of query rows."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(64))
    within = Window.partitionBy("k1", "k2", "salt").orderBy("vec_id")
    least = rows.withColumn("salt", salt).withColumn("at", F.row_number().over(within)).where(F.col("at") <= k)
    least = least.withColumn("at", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("vec_id"))).where(F.col("at") <= k)
    classes = least.groupBy("k1", "k2").agg(F.min("_vector").alias("_vector"), F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where("_query").groupBy("k1", "k2").agg(F.count("*").alias("queries"))
    return classes.join(asked, ["k1", "k2"], "left").na.fill(0, ["queries"])


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, vector: str = "embedding", centroids: int = CENTROIDS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest rows found for each row whose id ``every`` divides.

    Vectors that are null, empty, zero, of another length than most (ties: the longer), or hold null or
    non-finite entries take no part, nor do rows without vec_id. Rows equal in id and vector are one row;
    rows that share only the id are different rows: each is a query, and may be found, the other's
    included. With fewer candidates than ``k`` all are returned; without any, nothing. Ties go to the
    smaller vec_id. Other columns are ignored.
    """
    spark = embeddings.sparkSession
    rows, dims = usable(embeddings.select("vec_id", vector), vector)
    rows = rows.where(F.col("vec_id").isNotNull() & F.exists("_vector", lambda c: c != 0))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "_vector", F.xxhash64("_vector").alias("k1"), F.xxhash64(F.lit(1), "_vector").alias("k2"))
    rows = materialize(rows.dropDuplicates(["vec_id", "k1", "k2"]).withColumn("_query", F.col("vec_id") % every == 0), "vectors")
    if not dims or rows.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # one more than asked for, as a query finds itself
    classes = materialize(_classes(rows, k + 1), "vector-classes")
    index = fit(classes, dims, k, centroids=centroids)
    held = spark.sparkContext.broadcast(index)
    cells = materialize(classes.mapInArrow(_assign(held, dims), f"{_KEY}, _vector array<double>, ids array<long>, queries long, i int, j int"), "index")
    for r in cells.groupBy("i", "j").count().collect():  # at most centroids squared
        index.counts[r["i"], r["j"]] = r["count"]
    held = spark.sparkContext.broadcast(index)
    blocks = F.lit(np.maximum(-(-index.counts.sum(1) // ENTRIES), 1).tolist())
    asked = cells.where("queries > 0").select("k1", "k2", "_vector")
    chunks = -(-asked.count() // QUERIES) or 1
    visits = asked.mapInArrow(_plan_visits(held, dims), f"{_KEY}, _vector array<double>, i int, js array<int>")
    block, chunk = F.element_at(blocks, F.col("i") + 1).cast("int"), F.lit(chunks)
    visits = visits.withColumn("block", F.explode(F.sequence(F.lit(0), block - 1))).withColumn("chunk", F.pmod(F.col("k1"), chunk).cast("int"))
    entries = cells.select("_vector", "ids", "i", "j", F.pmod(F.col("k2"), block).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), chunk - 1)).alias("chunk"))
    groups = ["i", "block", "chunk"]
    pairs = entries.groupBy(*groups).cogroup(visits.groupBy(*groups)).applyInArrow(_rerank(dims, k + 1), f"{_KEY}, vec_id long, score double")
    order = Window.partitionBy("k1", "k2").orderBy("score", "vec_id")
    pairs = pairs.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    found = pairs.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    found = found.withColumn("key", F.struct("k1", "k2")).drop("k1", "k2")
    queries = rows.where("_query").select(F.col("vec_id").alias("query_id"), F.struct("k1", "k2").alias("key"))
    counts = classes.where("queries > 0").select(F.struct("k1", "k2").alias("key"), "queries")
    joined = skew_join(queries, found, "key", hot_keys(counts, "key", "queries"), F.col("query_id"))
    others = F.filter("near", lambda e: (e["vec_id"] != F.col("query_id")) | (e["score"] != 0))
    out = joined.select("query_id", F.posexplode(F.slice(others, 1, k)).alias("at", "e"))
    return out.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"), F.col("e.score").alias("score"))
