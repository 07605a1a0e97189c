"""Language proportions of each document by expectation maximisation over character n-grams.

A language is a distribution over hashed 3-byte n-grams, counted on all labelled rows. A document's
n-grams are drawn from a mixture of languages; EM estimates the proportions, first over all
languages, then over the best one, two, ... of them. The set with the best penalised likelihood
(half of log n for each further language) is the document's language set. Where even that set makes
the n-grams e times less likely each than drawing them evenly, no learned language explains the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.llm import text_arrays as ta

#: Cells of the n-gram table, bytes of an n-gram, EM rounds, smoothing; rows counted at a time.
CELLS, N, ROUNDS, ALPHA, ROWS = 4096, 3, 15, 0.5, 256

#: A-Z lower-cased, other ASCII that is no letter as a blank, the bytes of other characters as they are.
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[65:91] += 32
_LETTER[:128][~((_LETTER[:128] >= 97) & (_LETTER[:128] <= 122))] = 32


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the rows' n-grams, one line of ``CELLS`` for each row."""
    rows = offsets.size - 1
    counts = np.zeros(rows * CELLS, np.int64)
    for begin in range(0, max(data.size - N + 1, 0), ta.PIECE):
        part = _LETTER[data[begin : begin + ta.PIECE + N - 1]]
        at = np.arange(begin, begin + part.size - N + 1)
        row = np.searchsorted(offsets, at, "right") - 1
        blank = (part == 32).astype(np.int8)
        code, blanks = np.zeros(at.size, np.uint32), np.zeros(at.size, np.int8)
        for j in range(N):
            code = (code << np.uint32(8)) | part[j : j + at.size]
            blanks += blank[j : j + at.size]
        good = (at + N <= offsets[row + 1]) & (blanks < 2)
        cell = (code * np.uint32(2654435761)) >> np.uint32(32 - CELLS.bit_length() + 1)
        counts += np.bincount(row[good] * CELLS + cell[good], minlength=counts.size)
    return counts.reshape(rows, CELLS)


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, np.ndarray] = {}
    for batch in batches:
        data, offsets = ta.column_bytes(batch.column("text"))
        lang = np.array(batch.column("lang").to_pylist(), object)
        for first, last in ta.row_groups(offsets, most=ROWS):
            counts = _grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            for name in set(lang[first:last]):
                found[name] = found.get(name, 0) + counts[lang[first:last] == name].sum(0)
    for name, counts in found.items():
        cell = np.flatnonzero(counts)
        yield pa.record_batch(
            {"lang": pa.array([name] * cell.size, pa.string()), "cell": cell.astype(np.int32), "n": counts[cell]}
        )


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their n-gram distributions, from all rows (text, lang) whose text and lang aren't null.

    The model has ``CELLS`` numbers for each language label.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", "lang")
    counted = rows.mapInArrow(_count_rows, "lang string, cell int, n long")
    found = counted.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in found})
    table = np.full((len(langs), CELLS), ALPHA)
    place = {name: k for k, name in enumerate(langs)}
    for r in found:
        table[place[r["lang"]], r["cell"]] += r["n"]
    return langs, (table / table.sum(1, keepdims=True)).astype(np.float32)


def _likelihood(counts, shares, table) -> np.ndarray:
    return (counts * np.log(np.maximum(shares @ table, 1e-30))).sum(1)


def _em(counts: np.ndarray, shares: np.ndarray, table: np.ndarray) -> np.ndarray:
    total = np.maximum(counts.sum(1, keepdims=True), 1)
    for _ in range(ROUNDS):
        shares = shares * ((counts / np.maximum(shares @ table, 1e-30)) @ table.T) / total
    return shares / np.maximum(shares.sum(1, keepdims=True), 1e-30)


def mixtures(counts: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(proportions, explained) of each line of n-gram counts; languages outside the set have 0."""
    rows, k = counts.shape[0], table.shape[0]
    n = counts.sum(1)
    counts = counts.astype(np.float32)
    wide = _em(counts, np.full((rows, k), 1 / k, np.float32), table)
    order = np.argsort(-wide, 1, kind="stable")
    best = np.zeros((rows, k), np.float32)
    best[np.arange(rows), order[:, 0]] = 1
    # overlapping n-grams: N of them say as much as one
    value = _likelihood(counts, best, table) / N
    explained = value > n * (np.log(1 / CELLS) - 1) / N
    alive = np.arange(rows)
    for size in range(2, k + 1):
        member = np.zeros((alive.size, k), bool)
        np.put_along_axis(member, order[alive, :size], True, 1)
        start = np.where(member, np.maximum(wide[alive], 1e-3), 0).astype(np.float32)
        shares = _em(counts[alive], start / start.sum(1, keepdims=True), table)
        penalty = 0.5 * (size - 1) * np.log(np.maximum(n[alive] / N, 2))
        now = _likelihood(counts[alive], shares, table) / N - penalty
        better = now > value[alive]
        alive, shares, now = alive[better], shares[better], now[better]
        if not alive.size:
            break
        best[alive], value[alive] = shares, now
    return best, explained


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *keep: str) -> DataFrame:
    """The columns ``keep`` with lang_pred, score, languages, proportions and explained.

    lang_pred is the language of the greatest proportion (ties: the first in code point order), score
    its proportion. languages and proportions list the chosen set, greatest first. Text that is null,
    empty or without a letter, and any text if nothing was learned, is ``und`` with score 0, an empty
    set and explained false; so are texts of one or two bytes, which have no n-gram, but for their
    language: the first. Whole texts are read; repeated rows get equal results.
    """
    langs, table = model
    held = docs.sparkSession.sparkContext.broadcast(table)
    names = np.array(langs, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.column_bytes(batch.column("text"))
            lettered = batch.column("_lettered").to_numpy(zero_copy_only=False).astype(bool)
            for first, last in ta.row_groups(offsets, most=ROWS):
                counts = _grams(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                shares, explained = mixtures(counts, held.value) if langs else (np.zeros((last - first, 1)), np.zeros(last - first, bool))
                order = np.argsort(-shares, 1, kind="stable")
                ok = lettered[first:last] & bool(langs)
                top = order[:, 0]
                sets = [[x for x in o if s[x] > 0] if good else [] for o, s, good in zip(order, shares, ok, strict=True)]
                out = {c: batch.column(c).slice(first, last - first) for c in keep}
                out |= {
                    "lang_pred": pa.array(np.where(ok, names[top] if langs else "und", "und"), pa.string()),
                    "score": np.where(ok, np.clip(shares[np.arange(last - first), top], 0, 1), 0).astype(np.float64),
                    "languages": pa.array([[langs[x] for x in s] for s in sets], pa.list_(pa.string())),
                    "proportions": pa.array([[float(p[x]) for x in s] for p, s in zip(shares, sets, strict=True)], pa.list_(pa.float64())),
                    "explained": explained & ok & (counts.sum(1) > 0),
                }
                yield pa.record_batch(out)

    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_lettered")
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    schema += "lang_pred string, score double, languages array<string>, proportions array<double>, explained boolean"
    return docs.select(*dict.fromkeys([*keep, "text"]), lettered).mapInArrow(run, schema)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """The fold that is not learned from: crc32 of the id as text, modulo 4, is 2. Without an id: held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(True))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages, proportions, explained), learned from the other folds."""
    marked = docs.select("doc_id", "text", "lang", held_out().alias("held_out"))
    return predict(marked, learn(marked.where("not held_out")), "doc_id", "held_out")
