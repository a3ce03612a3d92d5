import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF, awkward, frame, words

from stratocast.llm import simhash
from stratocast.llm.common import NULL_ID, documents
from stratocast.llm.components import components, forest, roots
from stratocast.llm.xxh import xxh64

LOWER = {k: k + 32 for k in range(65, 91)}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=90), min_size=1, max_size=20), st.integers(0, 2**64 - 1))
def test_xxh64(parts, seed):
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum([len(p) for p in parts])
    got = xxh64(data, ends - [len(p) for p in parts], ends, seed)
    assert got.tolist() == [xxhash.xxh64_intdigest(p, seed) for p in parts]


def plain_fingerprint(text, shingle):
    w = words((text or "").translate(LOWER))
    if not w:
        return 0
    parts = [" ".join(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(ids, fps):
    parent = list(range(len(ids)))

    def top(k):
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    x = np.array(fps, dtype=np.uint64)
    for k in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(x[k] ^ x[k + 1 :]) <= 4):
            parent[top(k + 1 + int(j))] = top(k)
    low = {}
    for k, i in enumerate(ids):
        low[top(k)] = min(low.get(top(k), i), i)
    return [low[top(k)] for k in range(len(ids))]


def check(rows, got):
    ids = [NULL_ID if i is None else i for i, _ in rows]
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    want = sorted(zip(ids, fps, plain_components(ids, fps)))
    assert sorted((r.id, r.fp % 2**64, r.component) for r in got) == want


def test_awkward_rows(spark):
    rows = awkward()
    check(rows, simhash.near_copies(frame(spark, rows)).collect())


def test_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, SF).collect()}
    fps = [plain_fingerprint(t, 4) for _, t in rows]
    ids = [i for i, _ in rows]
    assert got == set(zip(ids, (f"{x:016x}" for x in fps), plain_components(ids, fps)))


def clusters(seed, n):
    """Fingerprints in dense clusters and chains, and some far ones."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        base = rng.choice(out) if out and rng.random() < 0.8 else rng.getrandbits(64)
        for b in rng.sample(range(64), rng.randint(0, 6)):
            base ^= 1 << b
        out.append(base)
    return sorted(set(out))


@pytest.mark.parametrize("block", [3, 40, 2048])
def test_links_connect_what_is_near(spark, monkeypatch, block):
    """Also where keys hold more fingerprints than are compared at once."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = clusters(block, 400)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    found = [(r.a % 2**64, r.b % 2**64) for r in simhash.links(df).collect()]
    assert all((a ^ b).bit_count() <= 1000 for a, b in found)
    node = {f: k for k, f in enumerate(fps)}
    want = plain_components(list(range(len(fps))), fps)
    top = dict(zip(*(x.tolist() for x in roots(np.array([node[a] for a, _ in found]), np.array([node[b] for _, b in found])))))
    assert [top.get(k, k) for k in range(len(fps))] == want


def test_chains_keep_all_near_pairs():
    """No pair within the distance is lost by the keys or by the budgets of the chains."""
    rng = np.random.default_rng(2)
    a = rng.integers(0, 2**63, 4000).astype(np.uint64)
    b = a.copy()
    for k in range(4):
        flip = rng.random(4000) < 0.9
        b[flip] ^= np.uint64(1) << rng.integers(0, 64, flip.sum()).astype(np.uint64)
    ka, kb = simhash.chain_keys(a.view(np.int64)), simhash.chain_keys(b.view(np.int64))
    hit = ka == kb
    kept = np.zeros(len(a), dtype=bool)
    for column in range(25):
        rows = np.flatnonzero(hit[:, column])
        kept[rows] |= simhash.close(a[rows].view(np.int64), b[rows].view(np.int64), np.full(len(rows), column // 5))
    assert kept.all()


def test_forest_keeps_components():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 300, 400), rng.integers(0, 300, 400)
    n1, r1 = roots(a, b)
    fa, fb = forest(a, b)
    assert len(fa) < len(n1)
    n2, r2 = roots(np.concatenate([fa, n1]), np.concatenate([fb, n1]))
    assert (n1 == n2).all() and (r1 == r2).all()


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(100, 300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {got[k] for k in range(100, 301)} == {100} and {got[k] for k in range(1000, 1200)} == {1000} and got.get(5, 5) == 5


def test_one_of_each_group_stays(spark):
    rows = awkward()
    df = frame(spark, rows)
    out = simhash.first_of_groups(df, shingle=5)
    assert out.columns == df.columns
    ids = [NULL_ID if i is None else i for i, _ in rows]
    comp = plain_components(ids, [plain_fingerprint(t, 5) for _, t in rows])
    assert sorted(NULL_ID if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(set(comp))


def test_empty_table(spark):
    assert simhash.near_copies(frame(spark, [])).count() == 0
    assert simhash.first_of_groups(frame(spark, [])).count() == 0
