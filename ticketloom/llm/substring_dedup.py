"""Substring dedup: shared word k-mers, chained in order and aligned into fuzzy passages.

Seeds are the least k-mers (by hash) of each window of ``WINDOW`` k-mers, so any equal run of
K + WINDOW - 1 words has a common seed. Each place of a seed is joined with its first place, in the
order of doc_id, so a seed in n documents gives n - 1 anchors and never pairs of later documents.
Anchors of two documents are chained in increasing order of both: the best chain before an anchor is
the greatest prefix in a Fenwick tree over the places of the earlier document, less a cost for the
gap. Chains are aligned: gaps by their longest common subsequence, ends by local alignment. Of a chain
that misses the identity, the longest parts that reach it are passages.

The seeds of a passage may stand first in different documents. So the windows of min_words words that
no passage found so far covers are joined with their own first places, which are chained and aligned
likewise. Only windows whose seeds all stand in an earlier document can be repeats; others are not
hashed into rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import bitmaps
from ticketloom.llm import text_arrays as ta
from ticketloom.session import materialize

#: Words of a seed; seeds of a window.
K, WINDOW = 8, 17
#: Cost of a word in a gap of a chain; the greatest gap; words aligned beyond the outer seeds.
GAP_COST, GAP, REACH = 0.1, 64, 48
#: Tasks that rows which want one document's text are dealt to.
SLOTS = 32
#: Factor of a document's salt.
SALT = 2654435761
#: Words and identity of a passage.
MIN_WORDS, IDENTITY = 50, 0.8


def _least(value: np.ndarray) -> np.ndarray:
    """The least of each window of k-mers."""
    n = max(value.size - WINDOW + 1, 0)
    least = value[:n].copy()
    for j in range(1, WINDOW):
        np.minimum(least, value[j : j + n], out=least)
    return least


def _winnow(value: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Which k-mers are the least of some window inside their row."""
    chosen = np.zeros(value.size, bool)
    least = _least(value)
    n = least.size
    if not n:
        return chosen
    inside = row[:n] == row[WINDOW - 1 :]
    for j in range(WINDOW):
        chosen[j : j + n] |= inside & (value[j : j + n] == least)
    return chosen


def _seeds(docs: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(seed, doc_id, pos, more): the first place of each seed in a row; with a filter each place of what it passes.

    Where a text repeats a few words over and over, a seed comes again within a window; ``more`` is
    how many words later it does so for the last time without a gap, and these are one place.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for first, last in ta.row_groups(offsets):
                value, row, _, _ = ta.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                at = ta.windows(value, row, K)
                kmer, owner = ta.window_hash(value, at, K), row[at]
                keep = _winnow(kmer, owner)
                kmer, owner, at = kmer[keep].view(np.int64), owner[keep], at[keep]
                if held.value is not None:
                    keep = bitmaps.test(held.value, kmer & np.int64(bitmaps.BITS - 1))
                    kmer, owner, at = kmer[keep], owner[keep], at[keep]
                order = np.lexsort((at, kmer, owner))
                kmer, owner, at = kmer[order], owner[order], at[order]
                fresh = np.ones(kmer.size, bool)
                fresh[1:] = (kmer[1:] != kmer[:-1]) | (owner[1:] != owner[:-1])
                parts = fresh.copy()
                parts[1:] |= np.diff(at) > WINDOW
                head = np.flatnonzero(parts)
                more = at[np.append(head[1:], at.size) - 1] - at[head] if at.size else at
                if held.value is None:
                    head, more = head[fresh[head]], more[fresh[head]]
                kmer, owner, at = kmer[head], owner[head], at[head]
                pos = at - ta.starts_of(row, last - first)[owner]
                out = {"seed": kmer, "doc_id": ids[first:last][owner], "pos": pos.astype(np.int32), "more": more.astype(np.int32)}
                yield pa.record_batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, "seed long, doc_id long, pos int, more int")


def _repeatable(value: np.ndarray, row: np.ndarray, bits: np.ndarray, min_words: int, salt: np.ndarray | None = None) -> np.ndarray:
    """Places where ``min_words`` words of one row begin whose seeds, with the row's salt, are all in the filter."""
    at = ta.windows(value, row, min_words)
    inner = min_words - K - WINDOW + 2  # windows of seeds among so many words
    if inner <= 0 or not at.size:
        return at
    least = _least(ta.window_hash(value, np.arange(value.size - K + 1), K)).view(np.int64)
    if salt is not None:
        least = least ^ salt[row[: least.size]]
    misses = np.concatenate([[0], np.cumsum(~bitmaps.test(bits, least & np.int64(bitmaps.BITS - 1)))])
    return at[misses[at + inner] == misses[at]]


def _stretches(docs: DataFrame, bits: np.ndarray, min_words: int) -> DataFrame:
    """(doc_id, begin, end): first places, from begin to below end, of windows that may be repeats.

    The filter holds the seeds that an earlier document has, with their documents' salt.
    """
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for first, last in ta.row_groups(offsets):
                value, row, _, _ = ta.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                salt = (ids[first:last] & (bitmaps.BITS - 1)) * SALT
                at = _repeatable(value, row, held.value, min_words, salt)
                owner = row[at]
                cut = np.ones(at.size, bool)
                cut[1:] = (np.diff(at) > 1) | (np.diff(owner) > 0)
                head = np.flatnonzero(cut)
                tail = np.append(head[1:], at.size)[: head.size] - 1
                start = ta.starts_of(row, last - first)[owner[head]]
                out = {"doc_id": ids[first:last][owner[head]], "begin": (at[head] - start).astype(np.int32)}
                yield pa.record_batch(out | {"end": (at[tail] + 1 - start).astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, begin int, end int")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that few are held as Python objects or as words."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _uncovered(stretches: DataFrame, spans: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, stretches) of the windows that are not inside the spans."""
    part = lambda df, a, b, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct(a, b))).alias(name))
    listed = part(stretches, "begin", "end", "stretches").join(part(spans, "start_word", "end_word", "cover"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            ids, left = [], []
            for r in batch.to_pylist():
                merged: list[list[int]] = []
                for c in r["cover"] or []:
                    if merged and c["start_word"] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c["end_word"])
                    else:
                        merged.append([c["start_word"], c["end_word"]])
                # first places of the windows inside what is covered
                inside = [(a, b - min_words + 1) for a, b in merged if b - a >= min_words]
                rest, i = [], 0
                for x in r["stretches"]:
                    at, end = x["begin"], x["end"]
                    while i < len(inside) and inside[i][1] <= at:
                        i += 1
                    j = i
                    while at < end and j < len(inside) and inside[j][0] < end:
                        if inside[j][0] > at:
                            rest += [at, inside[j][0]]
                        at = max(at, inside[j][1])
                        j += 1
                    if at < end:
                        rest += [at, end]
                if rest:
                    ids.append(r["doc_id"])
                    left.append(rest)
            yield pa.record_batch({"doc_id": pa.array(ids, pa.int64()), "stretches": pa.array(left, pa.list_(pa.int32()))})

    return listed.mapInArrow(run, "doc_id long, stretches array<int>")


def _window_keys(value: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` words that begin at each place."""
    return ta.mix(ta.span_hash(ta.value_sums(value), at, at + n)).view(np.int64)


def _open_windows(docs: DataFrame, uncovered: DataFrame, min_words: int) -> DataFrame:
    """(key, doc_id, pos) of the windows of the given stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                value, row, _, _ = ta.words(*ta.column_bytes(batch.column("text").slice(i, 1)))
                flat = batch.column("stretches")[i].as_py()
                at = np.concatenate([np.arange(a, b) for a, b in zip(flat[::2], flat[1::2], strict=True)])
                at = at[at + min_words <= value.size]  # of another row of this doc_id
                out = {"key": _window_keys(value, at, min_words), "doc_id": np.full(at.size, doc_id, np.int64)}
                yield pa.record_batch(out | {"pos": at.astype(np.int32)})

    texts = bitmaps.mark(docs, "doc_id", uncovered.select("doc_id")).where("_hit").select("doc_id", "text")
    joined = texts.join(uncovered, "doc_id").select("doc_id", "text", "stretches")
    return joined.mapInArrow(run, "key long, doc_id long, pos int").distinct()


def _window_places(docs: DataFrame, bits: np.ndarray, keys: np.ndarray, min_words: int) -> DataFrame:
    """(key, doc_id, pos) of the windows that may be repeats and pass the filter of keys."""
    held = docs.sparkSession.sparkContext.broadcast((bits, keys))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds, wanted = held.value
        for batch in batches:
            data, offsets = ta.column_bytes(batch.column("text"))
            ids = batch.column("doc_id").to_numpy()
            for first, last in ta.row_groups(offsets):
                value, row, _, _ = ta.words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                at = _repeatable(value, row, seeds, min_words)
                key = _window_keys(value, at, min_words)
                keep = bitmaps.test(wanted, key & np.int64(bitmaps.BITS - 1))
                key, at = key[keep], at[keep]
                pos = at - ta.starts_of(row, last - first)[row[at]]
                yield pa.record_batch({"key": key, "doc_id": ids[first:last][row[at]], "pos": pos.astype(np.int32)})

    return docs.select("doc_id", "text").mapInArrow(run, "key long, doc_id long, pos int")


def _runs(p: np.ndarray, q: np.ndarray, more: np.ndarray | int) -> tuple[np.ndarray, ...]:
    """(first p, last p, first q) of anchors that follow each other on one diagonal."""
    cut = np.ones(p.size, bool)
    cut[1:] = (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] - p[:-1] > WINDOW + K)
    head = np.flatnonzero(cut)
    return p[head], np.maximum.reduceat(p + more, head), q[head]


def chains(p: np.ndarray, q: np.ndarray, more: np.ndarray | int = 0) -> list[list[tuple[int, int, int]]]:
    """Chains of anchors (p, q), sorted by p: each a list of diagonal runs (first p, last p, first q).

    An anchor goes on for ``more`` words.
    """
    first, last, other = _runs(p, q, more)
    n = first.size
    end = other + last - first  # last place in the earlier document
    ranks = sorted(set(end.tolist()))
    tree = [(-1e18, -1)] * (len(ranks) + 1)
    score, before = [0.0] * n, [-1] * n
    waiting = sorted(range(n), key=lambda i: last[i])
    w = 0
    for i in range(n):  # runs are in the order of their first p
        while w < n and last[waiting[w]] < first[i]:
            j = waiting[w]
            w += 1
            item = (score[j] + GAP_COST * float(last[j] + end[j]), j)
            at = bisect_left(ranks, end[j]) + 1
            while at <= len(ranks):
                if item > tree[at]:
                    tree[at] = item
                at += at & -at
        best = (-1e18, -1)
        at = bisect_left(ranks, other[i])  # ends below the run's first place
        while at > 0:
            best = max(best, tree[at])
            at -= at & -at
        gain = best[0] - GAP_COST * float(first[i] + other[i] - 2 * K)
        score[i] = float(last[i] - first[i] + K)
        if best[1] >= 0 and gain > 0:
            score[i] += gain
            before[i] = best[1]
    out, used = [], [False] * n
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append((int(first[i]), int(last[i]), int(other[i])))
            i = before[i]
        path.reverse()
        part: list[tuple[int, int, int]] = []
        for run in path:
            if part and max(run[0] - part[-1][1], run[2] - part[-1][2] - part[-1][1] + part[-1][0]) > GAP + K:
                out.append(part)
                part = []
            part.append(run)
        if part:
            out.append(part)
    return out


_CHAIN = "doc_id long, src_doc_id long, p int, q int, p_end int, q_end int, runs array<int>"


def _chained(anchors: DataFrame, min_words: int) -> DataFrame:
    """Chains of each pair of documents that are long enough for a passage."""
    span = min_words - 2 * (WINDOW - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
            d, s, p, q, more = (table[c].to_numpy() for c in ("doc_id", "src_doc_id", "pos", "src_pos", "more"))
            cut = np.flatnonzero((d[1:] != d[:-1]) | (s[1:] != s[:-1])) + 1
            lows = np.concatenate([[0], cut]) if d.size else np.zeros(0, np.int64)
            highs = np.append(cut, d.size)
            rows = []
            for a, b in zip(lows, highs, strict=False):
                if (p[a:b] + more[a:b]).max() + K - p[a] < span:
                    continue
                for chain in chains(*(x[a:b].astype(np.int64) for x in (p, q, more))):
                    (p0, _, q0), (p1, p2, q1) = chain[0], chain[-1]
                    if p2 + K - p0 >= span:
                        rows.append((d[a], s[a], p0, q0, p2 + K, q1 + p2 - p1 + K, [x for r in chain for x in r]))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32())]
            names = ["doc_id", "src_doc_id", "p", "q", "p_end", "q_end", "runs"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            d, s = table["doc_id"].to_numpy(), table["src_doc_id"].to_numpy()
            # the last pair may go on in the next batch
            open_at = int(np.flatnonzero((d != d[-1]) | (s != s[-1]))[-1]) + 1 if ((d != d[-1]) | (s != s[-1])).any() else 0
            if open_at:
                yield from solve(table.slice(0, open_at))
            held = table.slice(open_at)
        if held is not None and held.num_rows:
            yield from solve(held)

    sorted_ = anchors.repartition("doc_id", "src_doc_id").sortWithinPartitions("doc_id", "src_doc_id", "pos", "src_pos")
    return sorted_.mapInArrow(run, _CHAIN)


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence."""
    if not a.size or not b.size:
        return 0
    row = np.zeros(b.size + 1, np.int64)
    for x in a:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (b == x)))
    return int(row[-1])


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """(words of a, words of b, matches at least) of the best alignment of two beginnings."""
    n = min(a.size, b.size)
    differ = np.flatnonzero(a[:n] != b[:n])
    same = int(differ[0]) if differ.size else n
    a, b = a[same:], b[same:]
    if min(a.size, b.size) < 4:
        return same, same, same
    step = np.arange(b.size + 1)
    row = -step
    best = (0, 0, 0)
    for i, x in enumerate(a, 1):
        t = np.empty_like(row)
        t[0] = -i
        t[1:] = np.maximum(row[:-1] + np.where(b == x, 1, -1), row[1:] - 1)
        row = np.maximum.accumulate(t + step) - step
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    score, i, j = best
    return same + i, same + j, same + (max(i, j) + score) // 2


def extend_all(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int, int]]:
    """``_extend`` of many pairs at once; no side has more than ``REACH`` words."""
    n = len(pairs)
    if not n:
        return []
    sides = []
    for side, filler in ((0, 1), (1, 2)):  # fillers differ, so they end what is equal
        sizes = np.array([p[side].size for p in pairs])
        lines = np.full((n, 2 * REACH), filler, np.uint64)
        for i, p in enumerate(pairs):
            lines[i, : p[side].size] = p[side]
        sides.append((lines, sizes))
    (a, size_a), (b, size_b) = sides
    same = np.argmax(a != b, 1)
    shifted = same[:, None] + np.arange(REACH)
    a, b = np.take_along_axis(a, shifted, 1), np.take_along_axis(b, shifted, 1)
    size_a, size_b = size_a - same, size_b - same
    active = np.minimum(size_a, size_b) >= 4
    step = np.arange(REACH + 1, dtype=np.int16)
    row = np.tile(-step, (n, 1))
    outside = step > size_b[:, None]
    best, at_i, at_j = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(1, int(size_a[active].max(initial=0)) + 1):
        t = np.empty_like(row)
        t[:, 0] = -i
        t[:, 1:] = np.maximum(row[:, :-1] + np.where(b == a[:, i - 1, None], np.int16(1), np.int16(-1)), row[:, 1:] - 1)
        row = np.maximum.accumulate(t + step, 1) - step
        inside = np.where(outside, np.int16(-1000), row)
        j = inside.argmax(1)
        value = inside[np.arange(n), j]
        better = active & (i <= size_a) & (value > best)
        best[better], at_i[better], at_j[better] = value[better], i, j[better]
    tail = np.where(active, (np.maximum(at_i, at_j) + best) // 2, 0)
    return list(zip((same + at_i).tolist(), (same + at_j).tolist(), (same + tail).tolist(), strict=True))


def _ends(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The words before a chain, last first, and those behind it."""
    p0, _, q0 = runs[0]
    at_a, at_b = max(last for _, last, _ in runs) + K, max(other + last - first for first, last, other in runs) + K
    return [(a[max(p0 - REACH, 0) : p0][::-1], b[max(q0 - REACH, 0) : q0][::-1]), (a[at_a : at_a + REACH], b[at_b : at_b + REACH])]


def align(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], ends: list[tuple[int, int, int]] | None = None) -> tuple[int, int, int, int, int]:
    """(start, end in a, start, end in b, matches) of a chain's passage; ``ends`` are its extended ends, if known."""
    p0, _, q0 = runs[0]
    left, right = ends or [_extend(x, y) for x, y in _ends(a, b, runs)]
    matches = left[2]
    at_a, at_b = p0, q0
    for first, last, other in runs:
        if first > at_a or other > at_b:
            matches += _common(a[at_a:first], b[at_b:other])
        skip = max(at_a - first, at_b - other, 0)
        end = last + K
        x, y = a[first + skip : end], b[other + skip : other + end - first]
        n = min(x.size, y.size)
        matches += int((x[:n] == y[:n]).sum())
        at_a, at_b = max(at_a, end), max(at_b, other + end - first)
    return p0 - left[0], at_a + right[0], q0 - left[1], at_b + right[1], matches + right[2]


def _equal_parts(a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], trim: bool = True) -> list[tuple[int, int, int]]:
    """(start, end in a, start in b) of a chain's equal stretches; its outer ones go on while words are equal."""
    out: list[tuple[int, int, int]] = []
    at_a = at_b = 0
    for i, (first, last, other) in enumerate(runs):
        skip = max(at_a - first, at_b - other, 0) if trim else 0
        end = last + K
        x, y = a[first + skip : end], b[other + skip : other + end - first]
        n = min(x.size, y.size)
        same = np.concatenate([[False], x[:n] == y[:n], [False]])
        edges = np.flatnonzero(same[1:] != same[:-1])
        parts = [(first + skip + int(s), first + skip + int(e), other + skip + int(s)) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        if parts and (i == 0 or not trim) and parts[0][0] == first:
            s, e, o = parts[0]
            m = min(s, o, REACH)
            differ = np.flatnonzero(a[s - m : s][::-1] != b[o - m : o][::-1])
            m = int(differ[0]) if differ.size else m
            parts[0] = (s - m, e, o - m)
        if parts and (i == len(runs) - 1 or not trim) and parts[-1][1] == end:
            s, e, o = parts[-1]
            x, y = a[e : e + REACH], b[o + e - s : o + e - s + REACH]
            m = min(x.size, y.size)
            differ = np.flatnonzero(x[:m] != y[:m])
            parts[-1] = (s, e + (int(differ[0]) if differ.size else m), o)
        out += parts
        at_a, at_b = max(at_a, end), max(at_b, other + end - first)
    return out


def passages(
    a: np.ndarray, b: np.ndarray, runs: list[tuple[int, int, int]], min_words: int, identity: float, ends: list[tuple[int, int, int]] | None = None
) -> list[tuple[int, int, int, int, int]]:
    """(start, end in a, start, end in b, matches) of a chain's passages.

    That is the entire chain, or if it misses the identity, each part from one equal stretch to another
    that reaches it and is inside no longer such part.
    """

    def fits(x: tuple[int, int, int, int, int]) -> bool:
        return x[1] - x[0] >= min_words and x[4] / max(x[1] - x[0], x[3] - x[2]) >= identity

    whole = align(a, b, runs, ends)
    if fits(whole):
        return [whole]
    found: list[tuple[int, int, int, int, int]] = []

    def add(part: list[tuple[int, int, int]], exact: tuple[int, int, int, int, int]) -> None:
        for x in (align(a, b, [(s, e - K, o) for s, e, o in part]), exact):
            if fits(x):
                found.append(x)
                return

    parts = _equal_parts(a, b, runs)
    if parts:
        s, e, o = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        size = e - s
        gaps = [_common(a[e[i] : s[i + 1]], b[o[i] + size[i] : o[i + 1]]) for i in range(s.size - 1)]
        total = np.cumsum(size + np.array([0, *gaps]))  # matches up to the end of each part
        reached = -1
        for i in range(s.size):
            matches = total[i:] - total[i] + size[i]
            longer = np.maximum(e[i:] - s[i], o[i:] + size[i:] - o[i])
            j = i + int(np.flatnonzero(matches >= identity * longer)[-1])
            # a part that reaches beyond its outer words can be that much longer
            if j > reached and e[j] - s[i] >= min_words - 2 * REACH:
                add(parts[i : j + 1], (int(s[i]), int(e[j]), int(o[i]), int(o[j] + size[j]), int(matches[j - i])))
            reached = max(reached, j)
    for s0, e0, o0 in _equal_parts(a, b, runs, trim=False):  # runs that overlap were trimmed above
        if e0 - s0 >= min_words and not any(x[0] <= s0 and e0 <= x[1] for x in found):
            add([(s0, e0, o0)], (s0, e0, o0, o0 + e0 - s0, e0 - s0))
    return found


def _one_row_each(docs: DataFrame) -> DataFrame:
    """Of rows with one doc_id, a row with the text of the least hash; texts move only where ids repeat."""
    twice = docs.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min(F.xxhash64("text")).alias("chosen"))
    twice = materialize(twice.where("rows > 1").drop("rows"), "repeated-ids")
    if twice.isEmpty():
        return docs
    marked = bitmaps.mark(docs, "doc_id", twice.select("doc_id"))
    alone = marked.where("not _hit").select("doc_id", "text")
    some = marked.where("_hit").select("doc_id", "text").join(twice, "doc_id", "left")
    some = some.where(F.col("chosen").isNull() | (F.xxhash64("text") == F.col("chosen")))
    return alone.union(some.dropDuplicates(["doc_id"]).select("doc_id", "text"))


_KEY = ["a_doc", "a_at", "b_doc", "b_at"]


def _cut_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted rows (key, doc_id, begin, end in words) with the words' hashes and the first one's number.

    A text stands once before the rows that want it. Rows that want one document are dealt to
    ``SLOTS`` tasks by the document they come from, so the source of a common passage is no hot key.
    """
    slot = F.pmod(F.xxhash64("a_doc"), F.lit(SLOTS)).cast("int").alias("slot")
    wanted = wanted.select("doc_id", slot, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text"), "side", *_KEY, "begin", "end")
    asked = wanted.select("doc_id", "slot").distinct()
    none = [F.lit(None).cast(wanted.schema[c].dataType).alias(c) for c in ("side", *_KEY, "begin", "end")]
    texts = docs.join(asked, "doc_id").select("doc_id", "slot", F.lit(0).alias("kind"), "text", *none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.zeros(0, np.uint64)
        for batch in _slices(batches):
            head = np.flatnonzero(batch.column("kind").to_numpy() == 0)
            for low, high in zip(np.concatenate([[0], head]), np.append(head, batch.num_rows), strict=True):
                if low < high and low in head:
                    value = ta.words(*ta.column_bytes(batch.column("text").slice(low, 1)))[0]
                    low += 1
                rows = batch.slice(low, high - low)
                if not rows.num_rows:
                    continue
                first = np.maximum(rows.column("begin").to_numpy(), 0)
                parts = [value[i:j].tobytes() for i, j in zip(first, rows.column("end").to_numpy(), strict=True)]
                out = {c: rows.column(c) for c in ("side", *_KEY)}
                yield pa.record_batch(out | {"first": pa.array(first, pa.int32()), "words": pa.array(parts, pa.binary())})

    dealt = texts.union(wanted).repartition("doc_id", "slot").sortWithinPartitions("doc_id", "slot", "kind")
    schema = "side int, a_doc long, a_at int, b_doc long, b_at int, first int, words binary"
    return dealt.mapInArrow(run, schema)


_SPAN = (
    "doc_id long, start_word int, end_word int, src_doc_id long, src_start_word int, src_end_word int, "
    "matches int, identity double"
)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, identity: float = IDENTITY) -> DataFrame:
    """Passages that an earlier document (less doc_id) has, exactly or nearly.

    Rows (doc_id, start_word, end_word, src_doc_id, src_start_word, src_end_word, matches, identity):
    words ``start_word`` to ``end_word`` (exclusive, counted from 0) of doc_id align with those of
    src_doc_id. Words are runs without ASCII white space, A-Z lower-cased. Reported are passages of
    ``min_words`` or more with matches / longer side at least ``identity``. Repeats inside one
    document don't count. Of rows with one doc_id the one whose text has the least hash counts. Rows without doc_id, and null, empty or
    shorter texts have no passages; an empty table gives none; other columns are ignored. Every run of
    ``min_words`` words that an earlier document has is inside reported passages. Another passage is
    found if it shares a run of K + WINDOW - 1 = 24 words with the place that has its seeds first.
    """
    docs = _one_row_each(docs.where("doc_id is not null").select("doc_id", "text"))
    places = _seeds(docs).groupBy("seed").agg(
        F.min("doc_id").alias("src_doc_id"), F.min_by("pos", "doc_id").alias("src_pos"), F.max("doc_id").alias("last"), F.min_by("more", "doc_id").alias("src_more")
    )
    shared = materialize(places.where("last > src_doc_id").drop("last"), "shared-seeds")
    bits = bitmaps.build(shared, "seed", hashed=True)
    anchors = _seeds(docs, bits).join(shared, "seed").where("doc_id > src_doc_id")
    anchors = anchors.select("doc_id", "pos", "src_doc_id", "src_pos", F.least("more", "src_more").alias("more"), "seed")
    anchors = materialize(anchors, "anchors")
    pairs = anchors.select(F.expr(f"seed ^ ((doc_id & {bitmaps.BITS - 1}) * {SALT}L)").alias("pair"))
    spans = materialize(_aligned(docs, anchors.drop("seed"), min_words, identity), "spans")
    uncovered = materialize(_uncovered(_stretches(docs, bitmaps.build(pairs, "pair", hashed=True), min_words), spans, min_words), "uncovered")
    later = materialize(_open_windows(docs, uncovered, min_words), "open-windows")
    if later.isEmpty():
        return spans
    known = _window_places(docs, bits, bitmaps.build(later, "key", hashed=True), min_words)
    known = known.groupBy("key").agg(F.min(F.struct("doc_id", "pos")).alias("at"))
    known = known.select("key", F.col("at.doc_id").alias("src_doc_id"), F.col("at.pos").alias("src_pos"))
    anchors = later.join(known, "key").where("doc_id > src_doc_id")
    anchors = anchors.select("doc_id", "pos", "src_doc_id", "src_pos", F.lit(max(min_words - K, 0)).alias("more"))
    return spans.union(_aligned(docs, anchors, min_words, identity)).distinct()


def _aligned(docs: DataFrame, anchors: DataFrame, min_words: int, identity: float) -> DataFrame:
    """The passages of the anchors (doc_id, pos, src_doc_id, src_pos, more)."""
    found = materialize(_chained(anchors, min_words), "chains")
    key = [F.col("doc_id").alias("a_doc"), F.col("p").alias("a_at"), F.col("src_doc_id").alias("b_doc"), F.col("q").alias("b_at")]
    side = lambda n, doc, a, b: found.select(
        F.lit(n).alias("side"), *key, F.col(doc).alias("doc_id"), (F.col(a) - REACH).alias("begin"), (F.col(b) + REACH).alias("end")
    )
    wanted = side(0, "doc_id", "p", "p_end").union(side(1, "src_doc_id", "q", "q_end"))
    texts = bitmaps.mark(docs, "doc_id", wanted.select("doc_id")).where("_hit").select("doc_id", "text")
    cut = materialize(_cut_texts(texts, wanted), "cut-texts")
    names = _KEY
    a = cut.where("side = 0").select(*names, F.col("first").alias("a_first"), F.col("words").alias("a_words"))
    b = cut.where("side = 1").select(*names, F.col("first").alias("b_first"), F.col("words").alias("b_words"))
    runs = found.select(*key, "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            rows, chained = [], []
            for r in batch.to_pylist():
                x, y = np.frombuffer(r["a_words"], np.uint64), np.frombuffer(r["b_words"], np.uint64)
                f, g, flat = r["a_first"], r["b_first"], r["runs"]
                chained.append((x, y, [(flat[i] - f, flat[i + 1] - f, flat[i + 2] - g) for i in range(0, len(flat), 3)]))
            ends = extend_all([end for c in chained for end in _ends(*c)])
            for i, (r, (x, y, steps)) in enumerate(zip(batch.select(["a_doc", "a_first", "b_doc", "b_first"]).to_pylist(), chained, strict=True)):
                f, g = r["a_first"], r["b_first"]
                for s, e, t, u, matches in passages(x, y, steps, min_words, identity, ends[2 * i : 2 * i + 2]):
                    share = matches / max(e - s, u - t)
                    rows.append((r["a_doc"], s + f, e + f, r["b_doc"], t + g, u + g, matches, min(share, 1.0)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            heads = [x.split()[0] for x in _SPAN.split(", ")]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], heads)

    return a.join(b, names).join(runs, names).mapInArrow(run, _SPAN).distinct()


def without_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans (doc_id, start_word, end_word) cut out of ``text``.

    A space is left between what stands before and behind. Texts without spans stay in their tasks,
    unchanged; other columns stay. A text of which nothing but white space is left becomes empty.
    """
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "end_word")).alias("_cuts"))
    marked = bitmaps.mark(docs, "doc_id", spans.select("doc_id"))
    rest = marked.where("not _hit").drop("_hit")
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for i, cuts in enumerate(batch.column("_cuts").to_pylist()):
                data, offsets = ta.column_bytes(batch.column("text").slice(i, 1))
                _, _, start, end = ta.words(data, offsets)
                keep = np.ones(data.size, bool)
                out = data.copy()
                for c in cuts or []:
                    if c["start_word"] < min(c["end_word"], start.size):
                        a, b = start[c["start_word"]], end[min(c["end_word"], start.size) - 1]
                        keep[a:b] = False
                        if a > 0 and b < data.size:
                            keep[a], out[a] = True, 0x20
                left = out[keep].tobytes().decode()
                texts.append(batch.column("text")[i].as_py() if not cuts else left if left.strip(" \t\n\v\f\r") else "")
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in schema.names]
            yield pa.record_batch(columns, schema.names)

    hit = marked.where("_hit").drop("_hit").join(listed, "doc_id", "left").select(*schema.names, "_cuts")
    return rest.select(*schema.names).union(hit.mapInArrow(run, schema))
