import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF, awkward, frame

from stratocast.llm import bpe
from stratocast.llm import words as W
from stratocast.llm.common import NULL_ID, documents

PATH = bpe.default_path()
PARTS = ["ab", " ", "  ", "\n", "\n\n", "'s", " don't", "12", "é", "漢字", "😀", " ", " ", "　", " ", "\x1c", "\x85", ",.", "<|endoftext|>", "<|endof", "The", "\r\n", "\t"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=14).map("".join)


def library(texts):
    return [e.ids for e in bpe.Encoder.of(PATH).tokenizer.encode_batch(list(texts), add_special_tokens=False)]


def mine(texts):
    encoder, out, back = bpe.Encoder.of(PATH), [], []
    for _, _, w in W.chunks(pa.array(texts, pa.string())):
        ids, bounds = encoder.encode(w)
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
        back += bpe.Decoder.of(PATH).decode(ids.astype(np.int64), bounds)
    return out, back


@settings(max_examples=400, deadline=None)
@given(st.lists(TEXT, min_size=1, max_size=6))
def test_as_the_library(texts):
    out, back = mine(texts)
    assert out == library(texts) and back == texts


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abthein1.,'é😀", min_size=1, max_size=300), st.integers(1, 40))
def test_trees_agree_with_the_whole(text, leaf):
    old, bpe.LEAF = bpe.LEAF, leaf
    try:
        assert bpe.Encoder.of(PATH).long(text) == library([text])[0]
    finally:
        bpe.LEAF = old


def test_memory_that_overflows(monkeypatch):
    monkeypatch.setattr(bpe, "ROOM", 600)
    monkeypatch.setattr(bpe, "SLOTS", 6)
    monkeypatch.setattr(bpe, "AT_ONCE", 7)
    monkeypatch.setattr(bpe.Encoder, "_open", {})
    monkeypatch.setattr(W, "CHUNK_BYTES", 300)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 60))) for _ in range(120)]
    assert mine(texts)[0] == library(texts)


def test_bytes_that_are_no_text():
    ids = [i for i in range(256)]
    tokenizer = bpe.Encoder.of(PATH).tokenizer
    assert bpe.Decoder.of(PATH).decode(np.array(ids), np.array([0, len(ids)])) == [tokenizer.decode(ids, skip_special_tokens=False)]


def rows_with_long_words():
    long = "x1" * 3000 + "<|endoftext|>" + "é" * 2500
    return awkward() + [(9000, long), (9000, long), (9001, "a b " + long + " c  "), (None, "q" * 9000), (9002, "<|endoftext|> x<|endoftext|>")]


def test_awkward_rows(spark):
    rows = rows_with_long_words()
    got = sorted((r.id, r.token_ids, r.decoded) for r in bpe.decode(bpe.encode(frame(spark, rows))).collect())
    assert got == sorted((NULL_ID if i is None else i, ids, t or "") for (i, t), ids in zip(rows, library(t or "" for _, t in rows)))


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = sorted((i, len(ids), sha(",".join(map(str, ids))), sha(t)) for (i, t), ids in zip(rows, library(t for _, t in rows)))
    assert sorted(tuple(r) for r in bpe.op4_bpe(spark, SF).collect()) == want


def test_stage_adds_columns(spark):
    rows = rows_with_long_words()
    df = frame(spark, rows)
    out = bpe.tokenised(df)
    assert out.columns == [*df.columns, "n_tokens", "_token_ids"]
    got = sorted((str(r.doc_id), r.text, r.n_tokens, r._token_ids) for r in out.collect())
    assert got == sorted((str(i), t or "", len(ids), ids) for (i, t), ids in zip(rows, library(t or "" for _, t in rows)))


@pytest.mark.parametrize("fn", [bpe.encode, bpe.tokenised])
def test_empty_table(spark, fn):
    assert fn(frame(spark, [])).count() == 0
