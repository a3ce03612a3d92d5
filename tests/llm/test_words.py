import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import texts, words

from stratocast.llm import words as W

ALPHABET = st.text(alphabet="ab \t\n\r\x0b\x0c\x1c\x85\xa0ä漢😀", max_size=40)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), ALPHABET), max_size=8))
def test_words_are_those_of_the_pattern(column):
    got = []
    for _, _, w in W.chunks(pa.array(column, pa.string())):
        body = w.data.tobytes()
        got += [[body[a:b].decode() for a, b in zip(w.starts[i:j], w.ends[i:j])] for i, j in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in column]


def test_small_chunks_give_the_same(monkeypatch):
    column = pa.array(texts(1))
    whole = [h for _, _, w in W.chunks(column) for h in w.hashes()]
    monkeypatch.setattr(W, "CHUNK_BYTES", 50)
    assert whole == [h for _, _, w in W.chunks(column) for h in w.hashes()]


def test_windows_and_hashes_tell_sequences_apart():
    (_, _, w), = W.chunks(pa.array(texts(2)))
    body = w.data.tobytes()
    names = [body[a:b] for a, b in zip(w.starts, w.ends)]
    assert len(set(w.hashes().tolist())) == len(set(names))
    at = np.flatnonzero(W.inside(w, 4))
    h = W.windows(w.hashes(), 4)
    pairs = {(tuple(names[k : k + 4]), int(h[k])) for k in at}
    assert len(pairs) == len({p[0] for p in pairs}) == len({p[1] for p in pairs})


def test_equal_windows_have_equal_anchors():
    (_, _, w), = W.chunks(pa.array(texts(3)))
    hashes = w.hashes()
    at, anchor = W.minimisers(w, 7, 3, hashes)
    assert at.tolist() == np.flatnonzero(W.inside(w, 7)).tolist()
    place = {}
    for h, k, a in zip(W.windows(hashes, 7)[at].tolist(), at, anchor):
        assert 0 <= a - k <= 4
        assert place.setdefault(h, a - k) == a - k


def test_joined_and_distinct():
    (_, _, w), = W.chunks(pa.array(["a  b\n", "", "c", " d e"]))
    text, starts, ends = w.joined()
    assert text.tobytes() == b"a b c d e "
    assert [text[a:b].tobytes() for a, b in zip(starts, ends)] == [b"a", b"b", b"c", b"d", b"e"]
    assert W.distinct(np.array([3, 1, 3, 2])).tolist() == [1, 2, 3]
    assert W.distinct(np.zeros(0)).tolist() == []


def test_no_rows():
    assert list(W.chunks(pa.array([], pa.string()))) == []


@pytest.mark.parametrize("which", [0, 1, 2, 3])
def test_inverse_powers(which):
    with np.errstate(over="ignore"):
        assert (W.powers(which, 100) * W.powers(which, 100, inverse=True) == 1).all()
