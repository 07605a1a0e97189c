"""Text columns: normalisation, tokens, n-grams, highlights. All JVM expressions except NFC and highlights."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

# Unicode whitespace (the characters str.isspace() accepts), URL and token patterns.
SPACE_CLASS = (
    r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
# Two ranges hold all of the class and rule most letters out before its many parts are tried.
SPACES = rf"[[\x{{00}}-\x{{20}}\x{{7f}}-\x{{3000}}]&&[{SPACE_CLASS}]]+"
EDGE_SPACES = f"^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$"
URL = f"https?://[^{SPACE_CLASS}]+"
# Lower-cased ASCII first, which is cheaper to test than the categories that have it too.
WORD = r"[a-z0-9_\p{L}\p{N}]{2,}"
HIGHLIGHT_WORD = r"[a-zA-Z\x{900}-\x{97F}']+"
TOP_ROWS = 1024

# Words too common to explain a prediction.
STOP_WORDS = [
    "the", "a", "an", "to", "of", "and", "or", "in", "on", "for", "is", "it",
    "my", "me", "i", "please", "pls", "hai", "ho", "ke", "ki", "ka",
]

# Code points that NFC can never change on their own or next to each other: Latin below the
# combining marks, Devanagari without nukta / virama / stress marks / nukta letters, general
# punctuation and currency signs. One virama between such letters is safe too.
NFC_INERT = (
    r"\x{00}-\x{2ff}\x{900}-\x{93b}\x{93d}-\x{94c}\x{94e}-\x{950}\x{955}-\x{957}\x{960}-\x{97f}"
    r"\x{2010}-\x{2027}\x{2030}-\x{205e}\x{20a0}-\x{20c0}"
)
BEYOND_LATIN = r"[^\x{00}-\x{2ff}]"
NEEDS_NFC = rf"[^{NFC_INERT}\x{{94d}}]|\x{{94d}}{{2}}"


@F.arrow_udf(StringType())
def _nfc(text: pa.Array) -> pa.Array:
    if text.null_count == len(text):
        return text
    # pyarrow's utf8_normalize leaves sequences decomposed, so each different text goes through the standard library
    found = text.dictionary_encode()
    composed = [unicodedata.normalize("NFC", t) for t in found.dictionary.to_pylist()]
    return pa.array(composed, pa.string()).take(found.indices)


def nfc(text: Column) -> Column:
    """Unicode NFC. Spark has no built-in; only rows that could change are sent to Arrow.

    The one-range test comes first because it is many times faster than the full set.
    """
    may_change = F.regexp_like(text, F.lit(BEYOND_LATIN)) & F.regexp_like(text, F.lit(NEEDS_NFC))
    suspect = F.when(may_change, text)
    return F.coalesce(_nfc(suspect), text)


def normalize(text: Column) -> Column:
    """NULL to '', NFC, URLs and whitespace runs to one space, trimmed."""
    return collapse_spaces(F.regexp_replace(F.coalesce(nfc(text), F.lit("")), URL, " "))


def collapse_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, SPACES, " "))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGE_SPACES, "")


def is_blank(text: Column) -> Column:
    return ~F.regexp_like(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]"))


def snippet(text: Column, length: int = 140) -> Column:
    """One-line quote of the ticket; whole text is read, the quote is cut in code points."""
    return F.substring(collapse_spaces(F.coalesce(text, F.lit(""))), 1, length)


def preview(text: Column, length: int = 240) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def word_tokens(norm: Column) -> Column:
    """Lower-cased words of two or more letters, digits or underscores, in order."""
    return F.regexp_extract_all(F.lower(norm), F.lit(WORD), F.lit(0))


def word_ngrams(tokens: Column) -> Column:
    """Unigrams followed by space-joined bigrams."""
    pairs = F.zip_with(
        F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))),
        F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.concat(tokens, pairs)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _run_starts(n: Column, same_as_before) -> Column:
    """1-based positions in a sorted array of ``n`` items where a new value begins."""
    return F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~same_as_before(i))


def count_items(items: Column) -> Column:
    """Array of strings -> array of (item, n), ordered by item.

    Sort and run-length instead of a lookup per distinct item, so one long text costs n log n, and
    nothing leaves the row.
    """

    def runs(s: Column) -> Column:
        return bind(
            _run_starts(F.size(s), lambda i: F.get(s, i - 1) == F.get(s, i - 2)),
            lambda st: F.transform(
                st,
                lambda b, j: F.struct(
                    F.get(s, b - 1).alias("item"), (F.coalesce(F.get(st, j + 1), F.size(s) + 1) - b).alias("n")
                ),
            ),
        )

    empty = F.array().cast("array<struct<item:string,n:int>>")
    return F.when(F.size(items) > 0, bind(F.sort_array(items), runs)).otherwise(empty)


def count_placed_items(items: Column) -> Column:
    """Like ``count_items``, with the first position of every item: array of (item, n, pos)."""
    placed = F.array_sort(F.transform(items, lambda x, i: F.struct(x.alias("item"), i.alias("pos"))))

    def runs(s: Column) -> Column:
        return bind(
            _run_starts(F.size(s), lambda i: F.get(s, i - 1)["item"] == F.get(s, i - 2)["item"]),
            lambda st: F.transform(
                st,
                lambda b, j: F.struct(
                    F.get(s, b - 1)["item"].alias("item"),
                    (F.coalesce(F.get(st, j + 1), F.size(s) + 1) - b).alias("n"),
                    F.get(s, b - 1)["pos"].alias("pos"),
                ),
            ),
        )

    empty = F.array().cast("array<struct<item:string,n:int,pos:int>>")
    return F.when(F.size(items) > 0, bind(placed, runs)).otherwise(empty)


def top_words(n: int):
    """Arrow column function: tokens of a row -> its ``n`` most frequent meaningful ones; equal counts keep the order of appearance."""

    def rows_of(tokens: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        stop = pc.is_in(words.dictionary, value_set=pa.array(STOP_WORDS, words.dictionary.type))
        meant = pc.and_(pc.greater(pc.utf8_length(words.dictionary), 2), pc.invert(stop)).to_numpy(zero_copy_only=False)
        code = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        kept = np.flatnonzero(meant[code])
        row, size = np.repeat(np.arange(len(tokens)), lengths)[kept], max(len(meant), 1)
        cells, first, counts = np.unique(row * size + code[kept], return_index=True, return_counts=True)
        row = cells // size
        order = np.lexsort((first, -counts, row))
        row, cells = row[order], cells[order]
        best = np.arange(len(row)) - np.searchsorted(row, row) < n
        offsets = np.concatenate([[0], np.cumsum(np.bincount(row[best], minlength=len(tokens)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.dictionary.take(pa.array(cells[best] % size)))

    @F.arrow_udf(ArrayType(StringType()))
    def top(tokens: pa.Array) -> pa.Array:
        return pa.concat_arrays([rows_of(tokens.slice(i, TOP_ROWS)) for i in range(0, max(len(tokens), 1), TOP_ROWS)])

    return top


def token_highlight(norm: Column, n: int = 8) -> Column:
    """The ``n`` most frequent meaningful words; equal counts keep the order of appearance."""
    return top_words(n)(F.regexp_extract_all(F.lower(norm), F.lit(HIGHLIGHT_WORD), F.lit(0)))
