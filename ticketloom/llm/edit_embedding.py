"""Edit embedding of documents: random walks over their characters, sampled into fingerprints.

A walk reads a text with one pointer. At step t it puts out the character under the pointer, then a
random bit, shared by all texts and given by t and that character, says whether the pointer moves.
Walks over equal stretches fall into step again after an edit, so texts of small edit distance have
walks of small Hamming distance. A fingerprint keeps four bits of the walk at sampled steps: one step
in each stretch of 2^level steps, with the level that gives 256 to 511 samples (fewer in short
texts). The samples of a level are among those of the level below, so fingerprints of all lengths
can be compared. Neighbours are found by banding the samples and verified on the whole fingerprint.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.graphs import components
from ticketloom.llm.text_arrays import mix
from ticketloom.session import materialize

#: Least number of samples of a long text; steps after which the random bits repeat; steps of a trace.
SAMPLES, PERIOD, TRACE = 256, 1024, 256
#: Characters that a task embeds at a time.
GROUP_CHARS = 12_000_000
#: Bands of a window; samples of a band at small scales; fingerprints that may be alike to some of the level above.
BANDS, WIDTHS, LONG = 6, {32: 4, 64: 6}, 320
_MOVES = (mix(np.arange(PERIOD * 256, dtype=np.uint64)) >> np.uint64(63)).astype(np.int64).reshape(PERIOD, 256)
_MOVES[:, 0] = 0  # the end of a text holds the pointer
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _symbols(text: str) -> np.ndarray:
    """Characters as 1 to 255: ASCII apart, others hashed; 0 marks the end."""
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(code < 127, code + 1, 128 + (code * np.uint32(2654435761) >> np.uint32(16)) % 128).astype(np.uint8)


def _level(n: np.ndarray) -> np.ndarray:
    return np.maximum(np.floor(np.log2(np.maximum(2 * n, 1) / SAMPLES)), 0).astype(np.int64)


def _half(j: np.ndarray, level: int) -> np.ndarray:
    """Which of the two samples of the level below the sample ``j`` is."""
    return (mix(j.astype(np.uint64) * np.uint64(64) + np.uint64(level)) >> np.uint64(63)).astype(np.int64)


@functools.cache
def sampled_steps(level: int, n: int) -> np.ndarray:
    """The steps of the first ``n`` samples of a level, ascending."""
    j = np.arange(n)
    for k in range(level, 0, -1):
        j = 2 * j + _half(j, k)
    return j


def fingerprints(texts: list[str]) -> list[str]:
    """Fingerprint of each text: its level, a colon, and a hexadecimal digit for each sample."""
    length = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(length + 1)
    symbols = np.zeros(int(ends[-1]) if texts else 0, np.uint8)
    for t, end, n in zip(texts, ends, length, strict=True):
        symbols[end - 1 - n : end - 1] = _symbols(t)
    level = _level(length)
    out = np.zeros((len(texts), 2 * SAMPLES + TRACE), np.uint8)
    lane = np.flatnonzero(length > 0)
    at = (ends - 1 - length)[lane]
    next_of = {}
    t0 = 0
    while lane.size:
        trace = np.empty((TRACE, lane.size), np.uint8)
        move = np.empty(lane.size, np.int64)
        for code, moves in zip(trace, _MOVES[t0 % PERIOD : t0 % PERIOD + TRACE], strict=True):
            symbols.take(at, out=code, mode="clip")
            moves.take(code, out=move, mode="clip")
            at += move
        for k in np.unique(level[lane]):
            first = next_of.setdefault(k, 0)
            known = 2 * SAMPLES
            while sampled_steps(k, known)[-1] < t0 + TRACE:
                known *= 2
            steps = sampled_steps(k, known)
            next_of[k] = int(np.searchsorted(steps, t0 + TRACE))
            steps = steps[first : next_of[k]]
            if steps.size:
                mine = np.flatnonzero(level[lane] == k)
                code = trace[steps - t0][:, mine].astype(np.uint64)
                salt = (mix(steps.astype(np.uint64)) << np.uint64(8))[:, None]
                digit = _HEX[(mix(code + salt) >> np.uint64(60)).astype(np.int64)]
                if next_of[k] > out.shape[1]:
                    out = np.pad(out, ((0, 0), (0, out.shape[1])))
                out[lane[mine], first : next_of[k]] = np.where(code > 0, digit, 0).T
        going = trace[-1] > 0
        lane, at = lane[going], at[going]
        t0 += TRACE
    used = (out > 0).sum(1)
    return [f"{k}:" + x[:n].tobytes().decode() for k, x, n in zip(level, out, used, strict=True)]


def likeness(a: str, b: str) -> float:
    """Share of samples that agree, less what four bits agree by chance; 0 to 1.

    The finer fingerprint is brought to the level of the coarser; where one is longer, its further
    samples agree with nothing. Two empty ones are alike.
    """
    (ka, da), (kb, db) = ((int(x), np.frombuffer(y.encode(), np.uint8)) for x, y in (a.split(":"), b.split(":")))
    if ka > kb:
        (ka, da), (kb, db) = (kb, db), (ka, da)
    while ka < kb:
        ka += 1
        pick = np.arange((da.size + 1) // 2)
        pick = 2 * pick + _half(pick, ka)
        da = da[pick[pick < da.size]]
    longest = max(da.size, db.size)
    if not longest:
        return 1.0
    n = min(da.size, db.size)
    return max(0.0, (int((da[:n] == db[:n]).sum()) / longest - 1 / 16) / (15 / 16))


def _with_next(docs: DataFrame) -> DataFrame:
    """Documents in blocks of ascending doc_id, each with the first document of the block after it.

    Rows without doc_id come first; rows of one doc_id are in the order of their texts. The only
    shuffle of the texts; a block goes to a task in order, and one more row of it to another task.
    """
    spark = docs.sparkSession
    n = 3 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10 * n)).first()[0]
    cuts = np.unique(np.array(cuts or [], np.int64))

    def block(doc_id: pa.Array) -> np.ndarray:
        known = np.asarray(doc_id.is_valid())
        place = np.searchsorted(cuts, doc_id.fill_null(0).to_numpy(), "right") + 1
        return np.where(known, place, 0)

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id = batch.column("doc_id")
            at = block(doc_id)
            least = doc_id.fill_null(0).to_numpy()
            order = np.lexsort((least, at))
            head = order[np.unique(at[order], return_index=True)[1]]
            yield pa.record_batch({"block": at[head].astype(np.int32), "doc_id": least[head]})

    # one row for each block, of which there are three for each partition
    found = docs.select("doc_id").mapInArrow(firsts, "block int, doc_id long").groupBy("block").agg(F.min("doc_id")).collect()
    first = sorted((r[0], r[1]) for r in found)
    numbers = np.array([b for b, _ in first], np.int64)
    least = np.array([i for _, i in first], np.int64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, at = batch.column("doc_id"), block(batch.column("doc_id"))
            own = np.searchsorted(numbers, at)
            head = np.flatnonzero((at == 0) | (least[own] == doc_id.fill_null(0).to_numpy()))
            rows = np.concatenate([np.arange(at.size), head])
            to = np.concatenate([at, numbers[own[head] - 1]])  # before the first block is the last
            taken = batch.take(pa.array(rows))
            edge = np.arange(rows.size) >= at.size
            yield pa.record_batch(
                {"block": to.astype(np.int32), "edge": edge, "doc_id": taken.column("doc_id"), "text": taken.column("text")}
            )

    text = F.coalesce(F.col("text"), F.lit("")).alias("text")
    dealt = docs.select("doc_id", text).mapInArrow(deal, "block int, edge boolean, doc_id long, text string")
    return dealt.repartition("block").sortWithinPartitions("block", "edge", "doc_id", "text")


_SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, next_fingerprint string"
)


def _results(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(texts, following, strict=True)]
    prints = fingerprints([*texts, following[-1], *edited])
    own, after, changed = prints[: len(texts)], prints[1 : len(texts) + 1], prints[len(texts) + 1 :]
    return pa.record_batch(
        {
            "doc_id": pa.array(ids, pa.int64()),
            "n_chars": pa.array([len(t) for t in texts], pa.int64()),
            "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
            "fingerprint": own,
            "edited_fingerprint": changed,
            "near_edited": [likeness(a, b) for a, b in zip(own, changed, strict=True)],
            "near_next": [likeness(a, b) for a, b in zip(own, after, strict=True)],
            "next_fingerprint": after,
        }
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of whole texts, of their edited texts, and their likeness; one row for each row.

    The edited text replaces the last quarter of the characters (rounded down) by as many from the
    start of the next document in the order of doc_id (after the last: the first). A null text is
    empty; rows without doc_id come first, rows of one doc_id are ordered by text; a single row is
    its own next. Other columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, chars, now, closed = [], [], 0, None, False
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("block", "edge", "doc_id", "text"))
            for block, edge, doc_id, text in zip(*columns, strict=True):
                if block != now:
                    ids, texts, chars, now, closed = [], [], 0, block, False
                if closed:  # further rows of the next block's first doc_id
                    continue
                if texts and (edge or chars > GROUP_CHARS):
                    yield _results(ids, texts, [*texts[1:], text])
                    ids, texts, chars = [], [], 0
                closed = edge
                if not edge:
                    ids.append(doc_id)
                    texts.append(text)
                    chars += len(text)

    return _with_next(docs.select("doc_id", "text")).mapInArrow(run, _SCHEMA)


def _coarser(level: int, samples: np.ndarray) -> np.ndarray:
    """The samples of the level above."""
    pick = np.arange((samples.size + 1) // 2)
    pick = 2 * pick + _half(pick, level + 1)
    return samples[pick[pick < samples.size]]


@functools.cache
def _places(scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of each band, ends of their windows) for fingerprints of ``scale`` to 2 ``scale`` samples.

    A window is a quarter of the scale. Scales 3 and 4 are whole windows of so many samples, for short texts.
    """
    if scale < 32:
        places = np.arange(-(-40 // scale) * scale).reshape(-1, scale)
        return places, places[:, -1] + 1
    size, width = scale // 4, WIDTHS.get(scale, 8)
    order = np.argsort(mix(np.arange(8 * BANDS * size, dtype=np.uint64) + np.uint64(scale << 20)).reshape(-1, size), axis=1)
    window = np.repeat(np.arange(8), BANDS)
    return np.sort(order[:, :width], axis=1) + size * window[:, None], size * (window + 1)


def _scales(n: int) -> list[int]:
    """Scales of a fingerprint of ``n`` samples. Two with lengths within a fifth of each other share one."""
    if n < 32:
        return [3] * (6 <= n < 12) + [4] * (n >= 8)
    scale = min(1 << (n.bit_length() - 1), SAMPLES)
    return [scale] + ([scale // 2 if scale > 32 else 4] if n < 1.25 * scale else [])


def band_keys(fingerprint: str) -> np.ndarray:
    """Keys of the bands of a fingerprint, whose two lowest bits name one of four orders."""
    text, samples = fingerprint.split(":")
    level, samples = int(text), np.frombuffer(samples.encode(), np.uint8)
    out = [np.zeros(0, np.uint64)]
    for k in (level, level + 1) if samples.size >= LONG else (level,):
        digits = samples if k == level else _coarser(level, samples)
        for scale in _scales(digits.size):
            places, ends = _places(scale)
            places = places[ends <= digits.size]
            content = np.zeros((len(places), 8), np.uint8)
            content[:, : places.shape[1]] = digits[places]
            number = np.arange(len(places), dtype=np.uint64) + np.uint64((k << 40) + (scale << 20))
            key = mix(content.view(np.uint64).ravel() ^ mix(number))
            out.append((key & ~np.uint64(3)) | (number & np.uint64(3)))
    return np.concatenate(out)


def edit_neighbours(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, component_id): documents grouped by likeness of their fingerprints.

    A band is up to 8 samples at fixed places of one window of a fingerprint, and a window a quarter of the
    fingerprint's scale (a power of two). Bands whose window ends behind the fingerprint are left out, and
    fingerprints near the limit of a scale or level have the bands of both. Each band links its members to
    one of them, the least in one of four orders, so members that one head hides meet others; a link counts
    if the fingerprints are at least ``threshold`` alike. Equal fingerprints (by a 64-bit hash) are one
    class, so copies cost no links. component_id is the least doc_id of the group; a document without
    neighbours has its own. Rows without doc_id are left out; rows of one doc_id are judged each by its
    text; a null text is empty. Other columns are ignored; an empty table gives no rows. Banding is
    randomised: alike texts are missed if no band links them or a chain between them.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            first = 0
            while first < len(texts):
                last, chars = first + 1, len(texts[first] or "")
                while last < min(len(texts), first + 4096) and chars < GROUP_CHARS:
                    chars += len(texts[last] or "")
                    last += 1
                prints = fingerprints([t or "" for t in texts[first:last]])
                yield pa.record_batch({"doc_id": batch.column("doc_id").slice(first, last - first), "print": prints})
                first = last

    def band(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("class").to_numpy()
            for i in range(0, ids.size, 4096):
                keys = [band_keys(x) for x in batch.column("print").slice(i, 4096).to_pylist()]
                key = np.concatenate(keys)
                owner = np.repeat(ids[i : i + 4096], [k.size for k in keys])
                place = owner.view(np.uint64) ^ ((key & np.uint64(3)) << np.uint64(62))
                yield pa.record_batch({"band": key.view(np.int64), "place": place.view(np.int64)})

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [likeness(x, y) >= threshold for x, y in zip(batch["pa"].to_pylist(), batch["pb"].to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    prints = rows.mapInArrow(embed, "doc_id long, print string").withColumn("class", F.xxhash64("print"))
    prints = materialize(prints, "edit-prints")
    classes = prints.groupBy("class").agg(F.min("doc_id").alias("first"), F.min("print").alias("print"))
    classes = materialize(classes, "edit-classes")
    banded = materialize(classes.select("class", "print").mapInArrow(band, "band long, place long"), "edit-bands")
    heads = banded.groupBy("band").agg(F.min("place").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    member = lambda c: F.col(c).bitwiseXOR(F.shiftleft(F.col("band").bitwiseAND(F.lit(3)), 62))
    pairs = banded.join(heads, "band").where("place <> head").select(member("place").alias("a"), member("head").alias("b"))
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = classes.select(F.col("class").alias("a"), F.col("print").alias("pa"))
    right = classes.select(F.col("class").alias("b"), F.col("print").alias("pb"))
    links = pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "pb").mapInArrow(verify, "a long, b long")
    roots = components(links).withColumnRenamed("node", "class")
    named = classes.select("class", "first").join(roots, "class", "left").withColumn("root", F.coalesce("root", "class"))
    named = materialize(named, "edit-groups")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(least, "root").select("class", "component_id")
    return prints.select("doc_id", "class").join(named, "class").select("doc_id", "component_id")
