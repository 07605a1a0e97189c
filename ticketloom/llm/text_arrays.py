"""Words, word hashes and word windows of whole text columns, on numpy arrays.

Everything works on pieces of about ``PIECE`` bytes, cut between documents, or between words of a
longer document, so the memory of a task does not depend on the length of its texts.
Hashes have 64 bits; different words, shingles or sets count as equal only if these bits agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits depend on all input bits."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(256, dtype=np.uint64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """The first ``n`` powers of the base, or of its inverse, modulo 2^64."""
    if kind not in _powers or _powers[kind].size < n:
        base = _BASE if kind == "base" else np.uint64(pow(int(_BASE), -1, 1 << 64))
        steps = np.full(max(n, PIECE + 1024), base, np.uint64)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=np.uint64)
    return _powers[kind][:n]


def rolling(data: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of the bytes follows."""
    sums = np.zeros(data.size + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power("base", data.size), out=sums[1:])
    return sums


def value_sums(values: np.ndarray) -> np.ndarray:
    """Sums from which the hash of any span of 64-bit values follows."""
    sums = np.zeros(values.size + 1, np.uint64)
    np.cumsum(values * _power("base", values.size), out=sums[1:])
    return sums


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each span; its place doesn't matter, its length must be mixed in by the caller."""
    return (sums[ends] - sums[starts]) * _power("inverse", sums.size)[starts]


def column_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_groups(offsets: np.ndarray, limit: int = PIECE, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``limit`` bytes together, and ``most`` rows at most."""
    first, rows = 0, offsets.size - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), first + most, rows)
        yield first, last
        first = last


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """The rows as one piece, or a long row as several that are cut at white space."""
    if offsets.size != 2 or data.size <= 2 * PIECE:
        yield data, offsets, 0, 0
        return
    at = 0
    while at < data.size:
        end = min(at + PIECE, data.size)
        if end < data.size:
            gaps = np.flatnonzero(SPACE[data[at:end]])
            if gaps.size:
                end = at + int(gaps[-1]) + 1
            else:
                while end < data.size and not SPACE[data[end]]:
                    end += 1
        yield data[at:end], np.array([0, end - at]), 0, at
        at = end


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, ...]:
    """(hash, row, start, end) of each maximal run of bytes other than 0x20 and 0x09-0x0D.

    A-Z are lower-cased before hashing, if asked for. Starts and ends are byte positions in ``data``.
    """
    out = []
    for piece, at, row0, shift in _pieces(data, offsets):
        if not piece.size:
            continue
        solid = ~SPACE[piece]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        first = at[:-1][at[:-1] < piece.size]
        begins[first] |= solid[first]
        starts = np.flatnonzero(begins)
        if not starts.size:
            continue
        stops = solid.copy()
        stops[:-1] &= ~solid[1:]
        last = at[1:][at[1:] > 0] - 1
        stops[last] |= solid[last]
        ends = np.flatnonzero(stops) + 1
        value = span_hash(rolling(LOWER[piece] if lower else piece), starts, ends)
        rows = np.searchsorted(at, starts, "right") - 1
        out.append((mix(value ^ (ends - starts).astype(np.uint64)), rows + row0, starts + shift, ends + shift))
    if not out:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if len(out) > 1 else out[0]


def window_hash(hashes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive hashes that begin at each place."""
    acc = np.full(at.size, n, np.uint64)
    for j in range(n):
        acc = acc * _BASE + hashes[at + j]
    return mix(acc)


def windows(hashes: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Places where ``n`` words of one row begin."""
    if hashes.size < n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(rows[: hashes.size - n + 1] == rows[n - 1 :])


def shingle_sets(hashes: np.ndarray, rows: np.ndarray, n: int, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles (hash, row), ordered by row and hash.

    A row with fewer words has its whole sequence as its only shingle, one without words has none.
    """
    at = windows(hashes, rows, n)
    found, owner = [window_hash(hashes, at, n)], [rows[at]]
    per_row = np.bincount(rows, minlength=n_rows)
    begin = np.cumsum(per_row) - per_row
    for short in range(1, n):
        which = np.flatnonzero(per_row == short)
        if which.size:
            found.append(window_hash(hashes, begin[which], short))
            owner.append(which)
    value, row = np.concatenate(found), np.concatenate(owner)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    if value.size:
        fresh = np.ones(value.size, bool)
        fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[fresh], row[fresh]
    return value, row


def starts_of(rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Offsets of the rows in an array ordered by row (one more than rows)."""
    return np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=n_rows))]).astype(np.int64)
