import collections
import zlib

import numpy as np
import pytest
from tables import SF, awkward, frame

from stratocast.llm.common import documents
from stratocast.llm.sharding import assign_shards, jump, op8_sharding, spread, write_shards


def plain_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop():
    keys = np.random.default_rng(1).integers(0, 2**63, 500).astype(np.uint64)
    for n in (1, 2, 24, 25, 1000):
        assert jump(keys, n).tolist() == [plain_jump(int(k), n) for k in keys]
    with pytest.raises(ValueError):
        jump(keys, 0)


def test_shards_are_even_and_growth_moves_few():
    keys = spread(np.arange(-50_000, 150_000))
    a, b = jump(keys, 24), jump(keys, 25)
    n = np.bincount(a)
    assert n.min() > 0.95 * n.mean() and n.max() < 1.05 * n.mean()
    assert set(b[a != b].tolist()) == {24} and abs((a != b).mean() - 1 / 25) < 0.002


def check(rows, got):
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in got) == collections.Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        key = spread(np.array([-(2**63) if r.doc_id is None else r.doc_id]))
        assert (r.shard, r.grown_shard) == (jump(key, 24)[0], jump(key, 25)[0])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_awkward_rows(spark):
    rows = awkward() + [(77, "same")] * 200
    check(rows, assign_shards(frame(spark, rows), 24).collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    got = op8_sharding(spark, SF).collect()
    check(rows, got)
    assert {r.law for r in got} == {"key"}


def test_empty_table(spark):
    assert assign_shards(frame(spark, []), 24).count() == 0


def test_written_shards_hold_all_columns(spark, tmp_path):
    df = frame(spark, awkward())
    write_shards(df, 5, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*df.columns, "_shard"}  # df has a column shard of its own
    assert back.select(df.columns).exceptAll(df).count() == 0 and back.count() == df.count()
