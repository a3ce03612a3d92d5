import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF, awkward, frame

from stratocast.llm import bpe
from stratocast.llm import token_files as T
from stratocast.llm.common import NULL_ID, documents


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**32 - 1)), max_size=300), st.integers(1, 80))
def test_round_trip(ids, block):
    blocks, starts = T.pack_blocks(np.array(ids, dtype=np.int64), block)
    out = [x for k in range(len(starts) - 1) for x in T.unpack_block(blocks[int(starts[k]) : int(starts[k + 1])], min(block, len(ids) - k * block))]
    assert out == ids


def test_any_part_of_a_file():
    ids = np.random.default_rng(1).integers(0, 50_000, 5000)
    file = T.TokenFile.of(T.pack_file(np.array([4, 9]), np.array([3000, 2000]), ids))
    assert file.doc_ids.tolist() == [4, 9] and file.counts.tolist() == [3000, 2000]
    for a, b in ((0, 5000), (0, 0), (1023, 1025), (3000, 5000), (4999, 5000)):
        assert file.ids(a, b).tolist() == ids[a:b].tolist()
    with pytest.raises(ValueError):
        T.TokenFile.of(b"nothing of the kind")


def test_outliers_are_exceptions():
    ids = np.full(1024, 7)
    ids[5] = 2**31
    blocks, _ = T.pack_blocks(ids)
    assert len(blocks) == 12 + 8  # width 0 and one exception


def plain(rows):
    rows = sorted(((NULL_ID if i is None else i, t or "") for i, t in rows), key=lambda r: r[0])
    ids = [e.ids + [0] for e in bpe.Encoder.of(bpe.default_path()).tokenizer.encode_batch([t for _, t in rows], add_special_tokens=False)]
    starts = np.cumsum([0, *map(len, ids)])
    return [(i, int(s), len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for (i, _), s, x in zip(rows, starts, ids)]


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in T.op2_token_files(spark, SF).collect()) == plain(rows)


def test_awkward_rows_in_many_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_IDS", 500)
    rows = awkward()
    folder = f"file://{tmp_path}/ids"
    files = T.write_token_files(frame(spark, rows), folder)
    got = sorted((r.id, r.start, r.n_tokens, r.ids_crc32) for r in T.read_token_files(spark, folder, files).collect())
    want = plain(rows)
    # rows that repeat an id may stand in either order; together they fill the same place
    assert [(i, s) for i, s, *_ in got][0] == (NULL_ID, 0)
    assert sorted((i, n, c) for i, _, n, c in got) == sorted((i, n, c) for i, _, n, c in want)
    assert sorted(s for _, s, _, _ in got) == [int(x) for x in np.cumsum([0] + [n for _, _, n, _ in sorted(got, key=lambda r: r[1])])[:-1]]
    once = {i for i, *_ in want if [w[0] for w in want].count(i) == 1}
    assert {r for r in got if r[0] in once} == {r for r in want if r[0] in once}


def test_empty_table(spark, tmp_path):
    files = T.write_token_files(frame(spark, []), f"file://{tmp_path}/none")
    assert files.count() == 0
