import random
import re
from collections import Counter

import numpy as np
import pytest
from tables import awkward, frame, texts

from stratocast.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string"


def plain(rows, least=10, longest=3, top=2000, inside=50):
    """Rows straight from the definition: (lang, rank, phrase, a, l, r, n, score)."""
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    cand = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = []
    for lang in sorted(n):
        mine = []
        for (of, w), a in cand.items():
            if of != lang:
                continue
            longer = [b for (x, v), b in cand.items() if x == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
            if any(100 * b >= inside * a for b in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            mine.append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(mine)[:top])]
    return out


def rows_of(df):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect())


def made(seed=0):
    rng = random.Random(seed)
    rows = [(i, t, rng.choice(["en", "en", None, "und", "f r"])) for i, t in awkward(seed)]
    return rows + [(2000 + i, t.replace("z", ", Z") + "! the End\x0bof it", rng.choice(["en", "x\ty"])) for i, t in enumerate(texts(seed + 1, n=80, vocabulary=30))]


def test_against_definition(spark):
    rows = made()
    got = rows_of(C.collocations(frame(spark, rows, columns=COLUMNS)))
    assert got == sorted(plain(rows)) and len(got) > 100


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_every_number_of_shards_counts_the_same(spark, shards):
    rows = made(7)
    assert rows_of(C.collocations(frame(spark, rows, columns=COLUMNS), shards=shards, least=4, top=50)) == sorted(plain(rows, least=4, top=50))


def test_longer_phrases(spark):
    rows = [(i, t, "en") for i, t in enumerate(texts(3, n=60, vocabulary=6))]
    assert rows_of(C.collocations(frame(spark, rows, columns=COLUMNS), longest=4, inside=30)) == sorted(plain(rows, longest=4, inside=30))


def test_no_rows(spark):
    assert C.collocations(frame(spark, [], columns=COLUMNS)).count() == 0
    assert C.collocations(frame(spark, [(1, None, None), (2, "", "en"), (3, "one", "en")], columns=COLUMNS)).count() == 0


def test_shared_buckets_change_nothing(spark, monkeypatch):
    """With few buckets most phrases are taken up for nothing; the counts stay exact."""
    monkeypatch.setattr(C, "BITS", 6)
    known = {1: np.full(64, C.NEVER, dtype=np.uint8), 2: np.full(64, C.NEVER, dtype=np.uint8)}
    rng = np.random.default_rng(1)
    vocabulary = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shards = [rng.choice(vocabulary, 400) for _ in range(3)]
    count, want = Counter(), Counter()
    for h in shards:
        for k in (1, 2, 3):
            want.update((k, x) for x in C.phrase_hashes(h, np.arange(len(h) - k + 1), k).tolist())
    step = last = 0
    while step < last + 3:
        h = shards[step % 3]
        length = np.minimum(np.arange(len(h), 0, -1), 255)
        for k, _, keys, _ in C.under_way(h, length, known, step, 3, 3):
            count.update((k, x) for x in keys.tolist())
        for k, taken in known.items():
            reached = np.zeros(64, dtype=bool)
            reached[C.bucket(np.array([x for (m, x), c in count.items() if m == k and c >= 5], dtype=np.uint64))] = True
            fresh = reached & (taken == C.NEVER)
            if fresh.any():
                taken[fresh] = step + 1
                last = step + 1
        step += 1
    assert all(count[key] == c for key, c in want.items() if c >= 5)
    assert all(c == want[key] for key, c in count.items())


def test_products_beyond_64_bits(spark):
    df = spark.createDataFrame([(900_000_000_000, 950_000_000_000, 990_000_000_001)], "c long, l long, r long")
    over = "cast(c as decimal(15,0)) * cast(c as decimal(15,0)) * cast(1000000 as decimal(7,0))"
    got = df.selectExpr(f"({over}) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0))) as score").first().score
    assert got == 1_000_000 * 900_000_000_000**2 // (950_000_000_000 * 990_000_000_001)
