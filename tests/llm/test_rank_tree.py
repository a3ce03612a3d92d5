import hashlib
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tables import SF, awkward, frame

from __spark_entry__ import queries
from stratocast.llm import words as W
from stratocast.llm.common import documents
from stratocast.llm.rank_tree import TreeEncoder, decode_ranks, default_path, default_pattern, encode_ranks, read_ranks


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=read_ranks(default_path()), special_tokens={})


def row_of(library, i, text):
    ids = library.encode_ordinary(text or "")
    return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_whole_table_against_library(spark, library):
    want = sorted(row_of(library, r.doc_id, r.text) for r in documents(spark, SF).collect())
    got = sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries()["op12_rank_tree"](spark, SF).collect())
    assert got == want


def test_awkward_rows_and_no_rows(spark, library):
    rows = awkward()
    out = decode_ranks(encode_ranks(frame(spark, rows))).collect()
    got = sorted((r.id, list(r.token_ids), bytes(r.decoded)) for r in out)
    low = -(2**63)
    assert got == sorted((low if i is None else i, library.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows)
    assert decode_ranks(encode_ranks(frame(spark, []))).count() == 0


def test_null_ids_decode_to_null(spark):
    rows = spark.createDataFrame([(1, 2, None), (1, 3, [])], "id long, th long, token_ids array<int>")
    got = {r.th: (r.packed, r.decoded) for r in decode_ranks(rows).collect()}
    assert got[2] == (None, None) and tuple(map(bytes, got[3])) == (b"", b"")


def test_random_texts(library):
    encoder = TreeEncoder(default_path(), default_pattern())
    rng = random.Random(3)
    parts = ["'s", "×", "÷", "ñ", ";", ":", "?", "!", "…", "'ll", " ", "  ", "\n", "\t", "\x85", "\xa0", "\x1c", " ", "é", "漢", "😀", *"abcdeABC019.,!"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 120))) for _ in range(800)]
    made += [" " * 3000, "\n" * 200 + "a", "ab" * 4000, "".join(rng.choice("abcdefghij") for _ in range(9000))]
    for low, high, words in W.chunks(pa.array(made)):
        ids, bounds = encoder.encode(words)
        for k in range(low, high):
            assert ids[bounds[k - low] : bounds[k - low + 1]].tolist() == library.encode_ordinary(made[k])


def test_trees_merge_leftmost_smallest_first():
    """Both trees against merging by a plain scan for the leftmost pair of the smallest rank."""
    encoder = TreeEncoder(default_path(), default_pattern())

    def plain(data):
        parts = [data[k : k + 1] for k in range(len(data))]
        while True:
            ranked = [(encoder.ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in encoder.ranks]
            if not ranked:
                return [encoder.ranks[p] for p in parts]
            _, k = min(ranked)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(5)
    for n in (1, 2, 3, 7, 16, 33, 100, 128):
        data = [bytes(rng.choice(b"abcdefghi \xc3\xa9") for _ in range(n)) for _ in range(20)]
        want = [plain(d) for d in data]
        assert [encoder.merge_one(d) for d in data] == want
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        token = encoder.merge_many(flat, np.arange(20) * n, np.full(20, n), 1 << max(0, (n - 1).bit_length()))
        assert [[t for t in row if t >= 0] for row in token.tolist()] == want


def test_vocabulary_without_all_bytes_is_refused(tmp_path):
    path = tmp_path / "some.tiktoken"
    path.write_bytes(b"YQ== 0\n")
    with pytest.raises(ValueError):
        TreeEncoder(str(path), default_pattern())
