"""Unigram encoding of texts into pieces, and back.

The best segmentation is the path of the greatest sum of piece scores (Viterbi). Pieces are found in
a double-array trie over UTF-8 bytes. No piece holds a blank behind another character, so a text
falls into units (blanks and the word behind them) whose best paths don't depend on each other; the
different units of a stretch of text are solved together, position by position, on numpy arrays.
Characters without a piece become pieces of their bytes. A blank stands for the whitespace marker,
and a marker in the text itself goes by its bytes, so decoding gives back every text exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketloom.llm import text_arrays as ta

MARKER = "▁"
NORMAL, UNKNOWN, USER_DEFINED, BYTE = 1, 2, 4, 6
#: Score of a character without a piece, below the least score.
UNKNOWN_PENALTY = 10.0
_BLANK = 0x20


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """Field number and value of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}[kind] if kind != 2 else varint()
        yield tag >> 3, data[at : at + size]
        at += size


def read_model(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) of a model file, in the order of ids.

    Only models without a normalisation table, that add a blank in front and keep all blanks, can be
    coded exactly; others are refused.
    """
    with open(path, "rb") as f:
        data = f.read()
    pieces, spec = [], {}
    for number, value in _fields(data):
        if number == 1:
            found = dict(_fields(value))
            score = float(np.frombuffer(found.get(2, b"\0\0\0\0"), np.float32)[0])
            pieces.append((found[1].decode(), score, found.get(3, NORMAL)))
        elif number == 3:
            spec = dict(_fields(value))
    if spec.get(2) or not spec.get(3, 1) or spec.get(4, 1) or not spec.get(5, 1):
        raise ValueError(f"{path}: this model changes texts before it cuts them")
    return pieces


class Codec(NamedTuple):
    """The arrays that encoding and decoding need; about 2 MB for 32,000 pieces."""

    base: np.ndarray
    check: np.ndarray
    leaf: np.ndarray
    score: np.ndarray
    byte_ids: np.ndarray
    unknown: float
    spelled: np.ndarray
    spelled_at: np.ndarray


def _double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and leaf: the child of node s by byte b is t = base[s] + b where check[t] = s."""
    children: list[dict[int, int]] = [{}]
    ids = [-1]
    for key, number in keys.items():
        node = 0
        for b in key:
            if b not in children[node]:
                children[node][b] = len(children)
                children.append({})
                ids.append(-1)
            node = children[node][b]
        ids[node] = number
    size = 4 * len(children) + 4096
    base, check, leaf = np.full(size, size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    place = {0: 0}
    free = tried = 257  # a hole further down can't be reached by every byte
    for node, below in enumerate(children):  # parents come before their children
        at = place[node]
        leaf[at] = ids[node]
        if not below:
            continue  # its base leads nowhere
        labels = np.array(sorted(below))
        while used[free]:
            free += 1
        if labels.size == 1:  # fills the first hole
            offset = free - int(labels[0])
        else:
            offset = tried
            while True:
                fits = ~used[offset + np.arange(256)[:, None] + labels].any(1)
                if fits.any():
                    offset += int(fits.argmax())
                    break
                offset += 256
            tried = max(offset - 128, tried)
        base[at] = offset
        used[offset + labels] = True
        check[offset + labels] = at
        place.update((below[b], offset + int(b)) for b in below)
    pad = np.full(256, -1, np.int32)
    return base, np.concatenate([check, pad]), np.concatenate([leaf, pad])


def build_codec(pieces: list[tuple[str, float, int]]) -> Codec:
    """Trie, scores and spellings of the pieces (piece, log score, type)."""
    spelled = [bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARKER, " ").encode() for p, _, kind in pieces]
    keys = {}
    score = np.array([s for _, s, _ in pieces], np.float64)
    usable = [i for i, (_, _, kind) in enumerate(pieces) if kind in (NORMAL, USER_DEFINED)]
    top = max(score[i] for i in usable)
    for i in usable:
        p, _, kind = pieces[i]
        if " " in spelled[i].lstrip(b" ").decode():
            raise ValueError(f"piece {p!r} holds a blank behind another character")
        keys.setdefault(spelled[i], i)
        if kind == USER_DEFINED:
            score[i] = len(p) * top - 0.1
    byte_ids = np.full(256, -1, np.int32)
    for i, (p, _, kind) in enumerate(pieces):
        if kind == BYTE:
            byte_ids[int(p[1:-1], 16)] = i
    if (byte_ids < 0).any():
        raise ValueError("the model has no pieces for bytes")
    for i, (_, _, kind) in enumerate(pieces):
        if kind not in (NORMAL, USER_DEFINED, BYTE):
            spelled[i] = b""
    base, check, leaf = _double_array(keys)
    least = min(score[i] for i in usable)
    at = np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
    return Codec(base, check, leaf, score, byte_ids, least - UNKNOWN_PENALTY, np.frombuffer(b"".join(spelled), np.uint8), at)


def _solve(text: np.ndarray, start: np.ndarray, size: np.ndarray, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of the units: (ids of all units in order, how many each has)."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    cell = np.concatenate([[0], np.cumsum(size + 1)])[:-1]  # a cell for each place between bytes
    best = np.full(int((size + 1).sum()), -np.inf)
    best[cell] = 0
    back = np.zeros(best.size, np.int32)
    piece = np.full(best.size, -1, np.int32)
    lead = np.array([1] * 192 + [2] * 32 + [3] * 16 + [4] * 16, np.int64)
    for p in range(int(size[0]) if size.size else 0):
        n = int(np.searchsorted(-size, -p, "left"))  # units longer than p
        lane = np.flatnonzero(best[cell[:n] + p] > -np.inf)
        if not lane.size:
            continue
        origin = best[cell[lane] + p]
        wide = np.minimum(lead[text[start[lane] + p]], size[lane] - p)
        single = np.zeros(lane.size, bool)
        live, node, depth = np.arange(lane.size), np.zeros(lane.size, np.int64), 0
        while live.size:
            child = codec.base[node] + text[start[lane[live]] + p + depth]
            good = codec.check[child] == node
            live, node = live[good], child[good].astype(np.int64)
            depth += 1
            number = codec.leaf[node]
            hit = number >= 0
            if hit.any():
                who, what = live[hit], number[hit]
                single[who] |= wide[who] == depth
                to = cell[lane[who]] + p + depth
                value = origin[who] + codec.score[what]
                better = value > best[to]
                to = to[better]
                best[to], back[to], piece[to] = value[better], p, what[better]
            more = size[lane[live]] > p + depth
            live, node = live[more], node[more]
        who = np.flatnonzero(~single)
        to = cell[lane[who]] + p + wide[who]
        value = origin[who] + codec.unknown
        better = value > best[to]
        to = to[better]
        best[to], back[to], piece[to] = value[better], p, -1
    mark = np.full(best.size, -1, np.int32)
    at, lane = size.copy(), np.flatnonzero(size > 0)
    while lane.size:
        here = cell[lane] + at[lane]
        mark[here] = piece[here]
        begin = back[here]
        for j in range(4):
            spell = (piece[here] < 0) & (begin + j < at[lane])
            mark[cell[lane[spell]] + begin[spell] + j + 1] = codec.byte_ids[text[start[lane[spell]] + begin[spell] + j]]
        at[lane] = begin
        lane = lane[begin > 0]
    unit = np.repeat(np.arange(size.size), size + 1)
    used = mark >= 0
    ids, counts = mark[used], np.bincount(unit[used], minlength=size.size)
    first = np.cumsum(counts) - counts
    back_order = np.empty_like(order)
    back_order[order] = np.arange(order.size)
    return ids[_spans(first[back_order], counts[back_order])], counts[back_order]


def _spans(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places first, first + 1, ... of each span, one after the other."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _encode_piece(data: np.ndarray, offsets: np.ndarray, front: bool, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    rows = offsets.size - 1
    length = np.diff(offsets)
    extra = ((length > 0) & front).astype(np.int64)
    text = np.full(data.size + int(extra.sum()), _BLANK, np.uint8)
    row = np.repeat(np.arange(rows), length)
    text[np.arange(data.size) + np.cumsum(extra)[row]] = data
    if not text.size:
        return np.zeros(0, np.int32), np.zeros(rows, np.int64)
    bounds = offsets + np.concatenate([[0], np.cumsum(extra)])
    blank = text == _BLANK
    begins = blank.copy()
    begins[1:] &= ~blank[:-1]
    begins[bounds[:-1][bounds[:-1] < text.size]] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, text.size))
    code = ta.rolling(text)
    name = ta.mix(ta.span_hash(code, start, start + size) ^ size.astype(np.uint64))
    _, once, again = np.unique(name, return_index=True, return_inverse=True)
    ids, counts = _solve(text, start[once], size[once], codec)
    first = np.cumsum(counts) - counts
    out = ids[_spans(first[again], counts[again])]
    owner = np.searchsorted(bounds, start, "right") - 1
    return out, np.bincount(owner, weights=counts[again], minlength=rows).astype(np.int64)


def encode_bytes(data: np.ndarray, offsets: np.ndarray, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows, how many each has); a row longer than a piece is cut between its units."""
    if offsets.size != 2 or data.size <= 2 * ta.PIECE:
        return _encode_piece(data, offsets, True, codec)
    blank = data == _BLANK
    inner = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    cuts = [0]
    for c in inner[np.unique(np.searchsorted(inner, np.arange(ta.PIECE, data.size, ta.PIECE)).clip(max=max(inner.size - 1, 0)))] if inner.size else []:
        cuts.append(int(c))
    cuts = [*dict.fromkeys(cuts), data.size]
    ids = [_encode_piece(data[a:b], np.array([0, b - a]), a == 0, codec)[0] for a, b in zip(cuts, cuts[1:], strict=False)]
    ids = np.concatenate(ids)
    return ids, np.array([ids.size])


def decode_bytes(ids: np.ndarray, counts: np.ndarray, codec: Codec) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets); the blank that encoding puts in front is taken off."""
    size = np.diff(codec.spelled_at)[ids]
    out = codec.spelled[_spans(codec.spelled_at[ids], size)]
    ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])]
    first = ends[:-1][ends[1:] > ends[:-1]]
    keep = np.ones(out.size, bool)
    keep[first[out[first] == _BLANK]] = False
    return out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]


def _lists(ids: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, codec: Codec, *keep: str) -> DataFrame:
    """The columns ``keep`` with ids, n_tokens, n_byte_pieces and exact, one row for each row.

    ``exact`` says that decoding the ids gives the text again, byte for byte. A null or empty text has
    no ids. Whole texts are coded; repeated rows give equal rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        is_byte = np.zeros(codec.score.size, bool)
        is_byte[codec.byte_ids] = True
        for batch in batches:
            data, offsets = ta.column_bytes(batch.column("text"))
            for first, last in ta.row_groups(offsets):
                part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                ids, counts = encode_bytes(part, at, codec)
                again, at2 = decode_bytes(ids, counts, codec)
                row = np.repeat(np.arange(last - first), counts)
                same = np.diff(at2) == np.diff(at)
                if same.all():
                    wrong = np.repeat(np.arange(last - first), np.diff(at))[part != again]
                    same[wrong] = False
                else:
                    for i in np.flatnonzero(same):
                        same[i] = (part[at[i] : at[i + 1]] == again[at2[i] : at2[i + 1]]).all()
                out = {c: batch.column(c).slice(first, last - first) for c in keep}
                out |= {
                    "ids": _lists(ids, counts),
                    "n_tokens": counts,
                    "n_byte_pieces": np.bincount(row[is_byte[ids]], minlength=last - first),
                    "exact": same,
                }
                yield pa.record_batch(out)

    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema + "ids array<int>, n_tokens long, n_byte_pieces long, exact boolean")


def decode(coded: DataFrame, codec: Codec, *keep: str) -> DataFrame:
    """The columns ``keep`` with text, decoded from ids. Null ids, or none, give the empty text.

    Bytes that make no UTF-8, which encoding never puts out, become replacement characters; an id
    that the model doesn't have fails.
    """
    held = coded.sparkSession.sparkContext.broadcast(codec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            counts = np.array([len(x) for x in lists], np.int64)
            ids = np.array([i for x in lists for i in x], np.int64)
            out, at = decode_bytes(ids, counts, held.value)
            raw = out.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.record_batch({c: batch.column(c) for c in keep} | {"text": pa.array(texts, pa.string())})

    schema = "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in keep)
    return coded.select(*keep, "ids").mapInArrow(run, schema + "text string")
