"""Stupid-backoff scores of documents: n-gram count tables joined to exploded n-grams.

Tokens are pieces of a public model, so every n-gram has an exact code. Pairs of pieces are counted
over the whole corpus and kept in a table that is partitioned by hash. The exploded pairs of each
document, once each with how often the document has them, go to the same partitions, are joined there
and summed to one number for each document and partition. A document is scored by all other rows: its
own occurrences are taken off every count. With such counts a pair (a, b) scores log10 c(a, b) / c(a)
if it occurs elsewhere, else log10 0.4 c(b) / N, and log10 0.4^2 / V if the piece occurs nowhere else
either (V pieces of the model). Pairs that make up more than 1 / ``HOT`` of the corpus, of which there
are fewer than ``HOT``, are scored before the shuffle, so no partition gets more than its share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import text_arrays as ta
from ticketloom.llm.sentencepiece_codec import Codec, encode_bytes
from ticketloom.session import materialize

BACKOFF = 0.4
#: Bound of the pairs that are scored by a broadcast table.
HOT = 1 << 16
#: Pairs that a task counts before it passes them on; tokens of a partition; least partitions.
FLUSH, PARTITION_TOKENS, LEAST_PARTITIONS = 1 << 20, 6_000_000, 16
_SHIFT = np.uint64(32)
#: What goes to the partitions: keys of rows with their numbers of pairs, and for each pair four numbers.
_PACKED = {"part": pa.int32()} | dict.fromkeys(("rows", "codes", "own", "own_first", "own_second"), pa.binary())


def _pairs(batch: pa.RecordBatch, codec: Codec) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last row, codes of the pairs, rows): each piece with the one before it, or the start."""
    start = codec.score.size
    data, offsets = ta.column_bytes(batch.column("text"))
    for first, last in ta.row_groups(offsets):
        ids, counts = encode_bytes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], codec)
        before = np.empty(ids.size, np.uint64)
        before[1:] = ids[:-1]
        heads = (np.cumsum(counts) - counts)[counts > 0]
        before[heads] = start
        yield first, last, (before << _SHIFT) | ids.astype(np.uint64), np.repeat(np.arange(last - first), counts)


def _narrow(codes: np.ndarray) -> np.ndarray:
    """Codes as 16 and 16 bits, where all pieces have numbers below 65,536."""
    return ((codes >> np.uint64(16)) | (codes & np.uint64(0xFFFF))).astype(np.uint32)


def _wide(codes: np.ndarray) -> np.ndarray:
    codes = codes.astype(np.uint64)
    return ((codes >> np.uint64(16)) << _SHIFT) | (codes & np.uint64(0xFFFF))


def _split(codes: np.ndarray, partitions: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, partitions that occur, cuts) that deal codes out by hash."""
    place = (ta.mix(codes) % np.uint64(partitions)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    place = place[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    return order, place[np.concatenate([[0], cuts])] if place.size else place, cuts


def _blobs(values: np.ndarray, cuts: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.split(values, cuts)] if values.size else [], pa.binary())


def count_table(docs: DataFrame, codec: Codec, partitions: int) -> DataFrame:
    """(part, codes, counts, seconds, sums): all pairs of each partition, and counts of second pieces."""
    held = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0

        def flush() -> pa.RecordBatch:
            codes, counts = np.unique(np.concatenate(found), return_counts=True)
            order, parts, cuts = _split(codes, partitions)
            return pa.record_batch(
                {"part": pa.array(parts, pa.int32()), "codes": _blobs(_narrow(codes[order]), cuts), "counts": _blobs(counts[order].astype(np.uint32), cuts)}
            )

        for batch in batches:
            for _, _, codes, _ in _pairs(batch, held.value):
                found.append(codes)
                size += codes.size
                if size > FLUSH:
                    yield flush()
                    found, size = [], 0
        if size:
            yield flush()

    def add(group: pa.Table) -> pa.Table:
        codes = np.frombuffer(b"".join(group["codes"].to_pylist()), np.uint32)
        counts = np.frombuffer(b"".join(group["counts"].to_pylist()), np.uint32)
        unique, at = np.unique(codes, return_inverse=True)
        total = np.zeros(unique.size, np.int64)
        np.add.at(total, at, counts)
        second, at = np.unique(unique & np.uint32(0xFFFF), return_inverse=True)
        sums = np.zeros(second.size, np.int64)
        np.add.at(sums, at, total)
        row = {"part": pa.array(group["part"][:1].to_pylist(), pa.int32())}
        row |= {n: pa.array([x.tobytes()], pa.binary()) for n, x in (("codes", unique), ("counts", total), ("seconds", second), ("sums", sums))}
        return pa.table(row)

    counted = docs.select("text").mapInArrow(run, "part int, codes binary, counts binary")
    return counted.repartition(partitions, "part").groupBy("part").applyInArrow(add, "part int, codes binary, counts binary, seconds binary, sums binary")


def _piece_counts(table: DataFrame, pieces: int) -> np.ndarray:
    """How often each piece occurs; one number for each piece of the model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("seconds").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                yield pa.record_batch({"piece": np.frombuffer(a, np.uint32).astype(np.int64), "n": np.frombuffer(b, np.int64)})

    out = np.zeros(pieces + 1, np.int64)
    rows = table.select("seconds", "sums").mapInArrow(run, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    for r in rows.collect():  # at most one row for each piece
        out[r["piece"]] = r["n"]
    return out


def _hot_pairs(table: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that make up 1 / HOT of all or more: so at most HOT of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("codes").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                codes, counts = np.frombuffer(a, np.uint32).astype(np.int64), np.frombuffer(b, np.int64)
                hot = counts * HOT >= total
                yield pa.record_batch({"code": codes[hot], "n": counts[hot]})

    rows = sorted((r["code"], r["n"]) for r in table.select("codes", "counts").mapInArrow(run, "code long, n long").collect())
    return np.array([c for c, _ in rows], np.uint32), np.array([n for _, n in rows], np.int64)


def _own_pairs(codes: np.ndarray, row: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Distinct pairs of each row, by row: (codes, rows, own, own_first, own_second).

    ``own`` is how often the row has the pair, the others how often it has the pair's pieces.
    """
    both, own = np.unique((row.astype(np.uint64) << _SHIFT) | codes, return_counts=True)
    codes, row = both.astype(np.uint32), (both >> _SHIFT).astype(np.int64)
    first, second = _pieces_of(codes)
    piece, at = np.unique(row << 16 | second, return_inverse=True)
    has = np.bincount(at, own, piece.size).astype(np.int64)
    before = np.searchsorted(piece, row << 16 | first).clip(max=max(piece.size - 1, 0))
    return codes, row, own, np.where(first == start, 1, has[before]), has[at]


def _pieces_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (codes >> np.uint32(16)).astype(np.int64), (codes & np.uint32(0xFFFF)).astype(np.int64)


def _parts(codes, counts, own, own_first, own_second, pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, places backed off to one piece, places whose piece is unseen) of pairs, for all their places.

    The score of the second kind lacks log10 0.4 / N, that of the third is 0: both are added to the sums.
    """
    first, second = _pieces_of(codes)
    elsewhere, second = counts - own, pieces[second] - own_second
    direct, single = elsewhere > 0, (elsewhere <= 0) & (second > 0)
    ratio = np.log10(np.maximum(elsewhere, 1) / np.maximum(pieces[first] - own_first, 1))
    value = np.where(direct, ratio, np.log10(np.maximum(second, 1)))
    return value * own, single * own, ~(direct | single) * own


_SUM = "key long, doc_id long, n_rows long, n_tokens long, log_score double, n_single long, n_unseen long"
_NAMES = [c.split()[0] for c in _SUM.split(", ")]


def score_documents(docs: DataFrame, codec: Codec) -> DataFrame:
    """(doc_id, n_tokens, log_score, per_token, n_backoff, n_unseen) of each row, by the model of all other rows.

    log_score sums the base-10 scores of all pieces of the whole text, each after the piece before it
    (the first after the start of a document); per_token is its mean, n_backoff how many pairs occur in no
    other row, n_unseen how many of these have a piece that occurs in no other row. So a text that
    another row repeats never backs off. A null or empty text has no tokens, log_score 0 and per_token
    null. Repeated rows are counted and returned as often as they occur; a row without doc_id is scored
    like others. Rows are told apart by a 64-bit hash of (doc_id, text): of two rows with equal hashes
    both get the mean. Other columns are ignored; an empty table gives none. Models of 65,535 pieces or
    more are refused.
    """
    if codec.score.size >= 1 << 16:
        raise ValueError("pairs of so many pieces don't fit in 32 bits")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(LEAST_PARTITIONS, size // (3 * PARTITION_TOKENS))
    table = materialize(count_table(docs, codec, partitions), "pair-counts")
    pieces = _piece_counts(table, codec.score.size)
    total = int(pieces.sum())
    pieces[-1] = docs.where("text <> ''").count()  # how often a document starts
    held = spark.sparkContext.broadcast((codec, pieces, *_hot_pairs(table, total)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, pieces, hot, hot_counts = held.value
        packed, size = [], 0

        def head(batch: pa.RecordBatch, first: int, last: int, own: tuple) -> tuple[pa.RecordBatch, np.ndarray]:
            n = last - first
            at = np.searchsorted(hot, own[0]).clip(max=max(hot.size - 1, 0))
            is_hot = hot[at] == own[0] if hot.size else np.zeros(own[0].size, bool)
            codes, row, *of_row = (x[is_hot] for x in own)
            sums = _parts(codes, hot_counts[at[is_hot]], *of_row, pieces)
            columns = {c: pa.nulls(n, t) for c, t in _PACKED.items()}
            columns |= {c: batch.column(c).slice(first, n) for c in ("key", "doc_id")}
            columns |= {"n_tokens": np.bincount(own[1], own[2], n).astype(np.int64), "log_score": np.bincount(row, sums[0], n).astype(np.float64)}
            columns |= {c: np.bincount(row, x, n).astype(np.int64) for c, x in zip(_NAMES[5:], sums[1:], strict=True)}
            return pa.record_batch(columns), ~is_hot

        def tail() -> pa.RecordBatch:
            codes, key, *of_row = (np.concatenate(x) for x in zip(*packed, strict=True))
            order, parts, cuts = _split(_wide(codes), partitions)
            columns = {"part": pa.array(parts, pa.int32()), "rows": _runs(key[order], cuts), "codes": _blobs(codes[order], cuts)}
            columns |= {c: _blobs(x[order].astype(np.uint32), cuts) for c, x in zip(list(_PACKED)[3:], of_row, strict=True)}
            columns |= {c: pa.nulls(parts.size, pa.int64()) for c in ("key", "doc_id", "n_tokens")}
            columns |= {"log_score": pa.nulls(parts.size, pa.float64())}
            return pa.record_batch(columns | {c: pa.nulls(parts.size, pa.int64()) for c in _NAMES[5:]})

        for batch in batches:
            keys = batch.column("key").to_numpy()
            for first, last, codes, row in _pairs(batch, codec):
                own = _own_pairs(_narrow(codes), row, codec.score.size)
                scored, rest = head(batch, first, last, own)
                yield scored
                codes, row, *of_row = (x[rest] for x in own)
                packed.append((codes, keys[row + first], *of_row))
                size += codes.size
                if size > FLUSH:
                    yield tail()
                    packed, size = [], 0
        if size:
            yield tail()

    def join(left: pa.Table, right: pa.Table) -> pa.Table:
        _, pieces, *_ = held.value
        if not right.num_rows or not left.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(_NAMES, [pa.int64()] * 4 + [pa.float64()] + [pa.int64()] * 2, strict=True)})
        known = np.frombuffer(right["codes"][0].as_py(), np.uint32)
        counts = np.frombuffer(right["counts"][0].as_py(), np.int64)
        out = []
        for runs, blob, *of_row in zip(*(left[c].to_pylist() for c in ("rows", *list(_PACKED)[2:])), strict=True):
            key, size = np.split(np.frombuffer(runs, np.int64), 2)
            codes = np.frombuffer(blob, np.uint32)
            of_row = [np.frombuffer(x, np.uint32).astype(np.int64) for x in of_row]
            sums = _parts(codes, counts[np.searchsorted(known, codes)], *of_row, pieces)
            out.append((key, *(np.add.reduceat(x, np.cumsum(size) - size) for x in sums)))
        key, *sums = (np.concatenate(x) for x in zip(*out, strict=True))
        zero = np.zeros(key.size, np.int64)
        return pa.table(dict(zip(_NAMES, (key, pa.nulls(key.size, pa.int64()), zero, zero, *sums), strict=True)))

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    schema = ", ".join(["part int", *(f"{c} binary" for c in list(_PACKED)[1:]), *(c for c in _SUM.split(", ") if "n_rows" not in c)])
    exploded = materialize(keyed.mapInArrow(run, schema), "exploded-pairs")
    heads = exploded.where("part is null").withColumn("n_rows", F.lit(1).cast("long")).select(_NAMES)
    # as many shuffle partitions as parts, so that tasks don't grow with the corpus
    tails = exploded.where("part is not null").select(*_PACKED).repartition(partitions, "part").groupBy("part")
    known = table.select("part", "codes", "counts").repartition(partitions, "part").groupBy("part")
    joined = tails.cogroup(known).applyInArrow(join, _SUM)
    # equal rows have one key: their sums are divided among them
    sums = heads.union(joined).groupBy("key").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in _NAMES[2:]])
    each = lambda c: (F.col(c) / F.col("n_rows"))
    single = F.log10(F.lit(BACKOFF)) - F.log10(F.greatest(F.lit(total) - each("n_tokens"), F.lit(1)))
    unseen = F.lit(float(np.log10(BACKOFF**2 / max(codec.score.size, 1))))
    log_score = each("log_score") + each("n_single") * single + each("n_unseen") * unseen
    out = sums.select(
        "doc_id",
        each("n_tokens").cast("long").alias("n_tokens"),
        log_score.alias("log_score"),
        (log_score / F.expr("nullif(n_tokens / n_rows, 0)")).alias("per_token"),
        (each("n_single") + each("n_unseen")).cast("long").alias("n_backoff"),
        each("n_unseen").cast("long").alias("n_unseen"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"),
    )
    return out.drop("copy")


def _runs(keys: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """For each partition the keys of its rows, and how many pairs each has there."""
    out = []
    for part in np.split(keys, cuts):
        edge = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1])
        out.append(np.concatenate([part[edge], np.diff(np.append(edge, part.size))]).tobytes())
    return pa.array(out, pa.binary())
