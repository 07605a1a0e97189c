import math
import os
from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ticketloom.llm import backoff_lm, sentencepiece_codec as sc
from ticketloom.llm import text_arrays as ta
from ticketloom.llm.queries import PIECE_MODEL

BYTES = [(f"<0x{b:02X}>", 0.0, sc.BYTE) for b in range(256)]
TINY = [("<unk>", 0.0, 2), *BYTES] + [
    (p, s, sc.NORMAL)
    for p, s in [("▁", -2.0), ("▁▁", -2.5), ("a", -1.5), ("b", -1.7), ("ab", -2.9), ("▁a", -2.2), ("aba", -3.5), ("é", -2.0), ("bé", -3.1), ("▁ab", -3.3)]
]


def best_by_hand(text, pieces):
    """Viterbi over whole texts, characters at a time."""
    text = (" " + text).replace(" ", "▁") if text else ""
    score = {p: (s, i) for i, (p, s, kind) in enumerate(pieces) if kind == sc.NORMAL}
    least = min(s for s, _ in score.values()) - sc.UNKNOWN_PENALTY
    best = [(0.0, [])] + [(-math.inf, [])] * len(text)
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            piece = text[i:j]
            if piece in score:
                value, ids = best[i][0] + score[piece][0], [score[piece][1]]
            elif j == i + 1:
                value, ids = best[i][0] + least, [1 + b for b in piece.encode()]
            else:
                continue
            if value > best[j][0]:
                best[j] = (value, best[i][1] + ids)
    return best[-1][1]


def coded(texts, codec):
    data, offsets = ta.column_bytes(pa.array(texts, pa.string()))
    ids, counts = sc.encode_bytes(data, offsets, codec)
    out, at = sc.decode_bytes(ids, counts, codec)
    ends = counts.cumsum()
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts, strict=True)], [out[a:b].tobytes().decode() for a, b in zip(at[:-1], at[1:], strict=True)]


@settings(deadline=None)
@given(st.lists(st.text(alphabet="ab é日𝄞\n", max_size=14), max_size=6))
def test_best_path_and_round_trip(texts):
    ids, back = coded(texts, sc.build_codec(TINY))
    assert ids == [best_by_hand(t, TINY) for t in texts] and back == texts


def test_markers_in_a_text_survive():
    ids, back = coded(["▁a ▁", None, " "], sc.build_codec(TINY))
    assert back == ["▁a ▁", "", " "] and ids[1] == []


def test_long_text_is_cut_between_units(monkeypatch):
    text = " ".join(["ab", "ba bab", "  é日"] * 60)
    whole = coded([text], sc.build_codec(TINY))
    monkeypatch.setattr(ta, "PIECE", 32)
    assert coded([text], sc.build_codec(TINY)) == whole


needs_model = pytest.mark.skipif(not os.path.exists(PIECE_MODEL), reason="no public model here")


@needs_model
def test_equals_the_library(documents):
    library = pytest.importorskip("sentencepiece")
    proto = pytest.importorskip("sentencepiece.sentencepiece_model_pb2").ModelProto()
    with open(PIECE_MODEL, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:  # the library adds up 32-bit numbers, in which -1e9 hides all others
        p.score = max(p.score, -40000.0)
    theirs = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    pieces = [(p, max(s, -40000.0), kind) for p, s, kind in sc.read_model(PIECE_MODEL)]
    texts = [r.text or "" for r in documents.collect()] + ["  a  b ", "日本語 €𝄞", ""]
    ids, back = coded(texts, sc.build_codec(pieces))
    assert ids == [theirs.encode(t) for t in texts] and back == texts


def test_operators_keep_rows(make):
    codec = sc.build_codec(TINY)
    rows = make([(1, "ab a"), (1, "ab a"), (2, None), (None, ""), (4, "日 " * 40)])
    found = sc.encode(rows, codec, "doc_id", "root", "text")
    assert found.count() == 5 and all(r.exact and r.n_tokens == len(r.ids) for r in found.collect())
    again = sc.decode(found, codec, "doc_id").collect()
    assert sorted((r.doc_id or 0, r.text) for r in again) == [(0, ""), (1, "ab a"), (1, "ab a"), (2, ""), (4, "日 " * 40)]
    assert sc.encode(make([]), codec, "doc_id").count() == 0
    with pytest.raises(ValueError, match="blank"):
        sc.build_codec([*TINY, ("a▁b", -1.0, sc.NORMAL)])


def scores_by_hand(texts):
    """Each text by counts made anew of all others."""
    ids = [best_by_hand(t or "", TINY) for t in texts]
    out = []
    for k, x in enumerate(ids):
        two, one, before = Counter(), Counter(), Counter()
        for y in ids[:k] + ids[k + 1 :]:
            two.update(zip([-1, *y], y, strict=False))
            one.update(y)
            before.update(y + [-1] * bool(y))
        score = back = unseen = 0
        for a, b in zip([-1, *x], x, strict=False):
            if two[a, b]:
                score += math.log10(two[a, b] / before[a])
            else:
                score += math.log10(0.4 * one[b] / sum(one.values()) if one[b] else 0.16 / len(TINY))
                back += 1
                unseen += not one[b]
        out.append((len(x), round(score, 9), back, unseen))
    return out


@pytest.mark.parametrize("hot", [1 << 16, 8])
def test_scores_equal_brute_force(make, monkeypatch, hot):
    monkeypatch.setattr(backoff_lm, "HOT", hot)
    monkeypatch.setattr(backoff_lm, "FLUSH", 20)
    texts = ["ab ab a", "ab ab a", "aba b é", "", None, "b" * 50, "日 ab", "a"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "ab")]
    got = backoff_lm.score_documents(make(rows), sc.build_codec(TINY)).collect()
    want = scores_by_hand([t for _, t in rows])
    assert sorted(((r.doc_id if r.doc_id is not None else -1), r.n_tokens, round(r.log_score, 9), r.n_backoff, r.n_unseen) for r in got) == sorted(
        ((i if i is not None else -1), *w) for (i, _), w in zip(rows, want, strict=True)
    )
    assert all((r.per_token is None) == (r.n_tokens == 0) for r in got)
    assert any(r.n_unseen for r in got) and any(r.n_backoff > r.n_unseen for r in got)
    alone = backoff_lm.score_documents(make([(7, "ab é")]), sc.build_codec(TINY)).first()
    assert (alone.n_tokens, alone.n_backoff, alone.n_unseen) == (3, 3, 3)
    assert backoff_lm.score_documents(make([]), sc.build_codec(TINY)).count() == 0
