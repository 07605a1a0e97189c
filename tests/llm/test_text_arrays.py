import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketloom.llm import text_arrays as ta

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@settings(deadline=None)
@given(st.lists(st.text(alphabet=" \tAaBbé\n日", max_size=30) | st.none(), max_size=8))
def test_words_are_runs_without_blanks(texts):
    data, offsets = ta.column_bytes(pa.array(texts, pa.string()))
    hashes, rows, start, end = ta.words(data, offsets)
    got = [(int(r), data[a:b].tobytes().decode()) for r, a, b in zip(rows, start, end, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in WORD.findall(t or "")]
    seen = {}
    for (_, word), h in zip(got, hashes, strict=True):
        assert seen.setdefault(lower(word), h) == h
    assert len(set(seen.values())) == len(seen)


def test_long_text_is_cut_between_words(monkeypatch):
    text = " ".join(f"w{i}" for i in range(500)) + " " + "x" * 300
    data, offsets = ta.column_bytes(pa.array([text]))
    whole = ta.words(data, offsets)
    monkeypatch.setattr(ta, "PIECE", 64)
    for a, b in zip(whole, ta.words(data, offsets), strict=True):
        assert (a == b).all()


def test_shingles_of_short_and_repeated_sequences():
    data, offsets = ta.column_bytes(pa.array(["a b a b a b", "a", None, "b a", "", "a b c d"]))
    value, row, _, _ = ta.words(data, offsets)
    members, owner = ta.shingle_sets(value, row, 3, 6)
    assert np.bincount(owner, minlength=6).tolist() == [2, 1, 0, 1, 0, 2]
