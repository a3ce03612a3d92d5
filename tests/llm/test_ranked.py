import math
import random
import re
from collections import Counter

import numpy as np
from tables import awkward, frame, texts

from stratocast.llm.ranked import Best, length_norm, ranked
from stratocast.llm.sharing import share

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def low(i):
    return -(2**63) if i is None else i


def plain(docs, items, top=10):
    """(item, rank, doc, score) rows straight from the formula."""
    have = [(i, Counter(terms(t))) for i, t in docs]
    have = [(i, c, sum(c.values())) for i, c in have if c]
    n_docs, n_terms = len(have), sum(n for *_, n in have)
    df = Counter(t for _, c, _ in have for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c, n in have:
            m = 100 - 90 + (90 * n * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in sorted(set(terms(text))) if c[t])
            if score > 0:
                found.append((-score, low(i), i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found, key=lambda x: x[:2])[:top])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


def test_awkward_rows(spark):
    docs = [(i, t if t is None else t.replace("z", "Z ").replace("x", "-x_")) for i, t in awkward(4)]
    items = [(1, docs[2][1]), (2, "az AZ bx"), (None, "cy ay"), (3, None), (4, ""), (5, "..."), (2, "az AZ bx"), (6, docs[9][1]), (6, "漢 äz")]
    got = rows_of(ranked(frame(spark, docs), frame(spark, items, columns="item_id long, text string")))
    assert got == plain(docs, items) and len(got) > 30


def test_blocks_give_the_same_rows(spark):
    docs = list(enumerate(texts(8, n=80, vocabulary=40)))
    items = [(k, t[: 20 + 13 * k]) for k, t in enumerate(texts(9, n=25, vocabulary=40))]
    d, q = frame(spark, docs), frame(spark, items, columns="item_id long, text string")
    want = plain(docs, items, 3)
    assert rows_of(ranked(d, q, top=3)) == want
    assert rows_of(ranked(d, q, top=3, block_terms=40)) == want


def test_no_rows(spark):
    none, some = frame(spark, []), frame(spark, [(1, "a b c")])
    items = frame(spark, [(1, "a")], columns="item_id long, text string")
    assert ranked(none, items).count() == 0
    assert ranked(some, frame(spark, [], columns="item_id long, text string")).count() == 0
    assert ranked(some, frame(spark, [(1, None)], columns="item_id long, text string")).count() == 0


def test_ties_by_id(spark):
    docs = [(i, "same words here") for i in (9, 4, None, 7, 4)] + [(k, f"other{k}") for k in range(20, 40)]
    items = [(1, "words")]
    got = rows_of(ranked(frame(spark, docs), frame(spark, items, columns="item_id long, text string"), top=4))
    assert [(r, i) for _, r, i, _ in got] == [(1, None), (2, 4), (3, 4), (4, 7)]


def test_graph_gives_every_query_its_sum():
    rng = random.Random(2)
    for n_terms, n_queries in ((1, 1), (30, 12), (200, 60), (5, 0)):
        common = [rng.sample(range(n_terms), min(n_terms, rng.randint(1, 9))) for _ in range(6)]
        queries = [np.unique(sum((rng.choice(common) for _ in range(3)), rng.sample(range(n_terms), min(n_terms, rng.randint(0, 6))))).astype(int) for _ in range(n_queries)]
        graph = share(queries, n_terms)
        values = np.array([[rng.randint(0, 10**12) for _ in range(7)] for _ in range(n_terms)], dtype=np.int64)
        sums = np.zeros((graph.n_groups, 7), dtype=np.int64)
        np.add.at(sums, graph.group, values)
        want = [values[q].sum(axis=0) for q in queries]
        assert np.array_equal(graph.totals(sums), np.array(want).reshape(n_queries, 7))
    # what several queries hold is computed once
    shared = share([np.arange(0, 40), np.arange(0, 50), np.arange(20, 60), np.arange(0, 60)], 60)
    assert shared.n_groups < 10 and shared.unions


def test_exact_length_norm():
    n = np.array([5, 10**9])
    assert length_norm(n, 10**12, 10**14).tolist() == [10 + 90 * x * 10**12 // 10**14 for x in n.tolist()]


def test_best_keeps_ties_in_order():
    best = Best(1, 2)
    best.add(np.array([[5, 5, 0, 7]]), np.array([8, 3, 1, 9]))
    best.keep()
    best.add(np.array([[5, 5]]), np.array([2, 30]))
    best.keep()
    assert list(zip(best.score.tolist(), best.id.tolist())) == [(7, 9), (5, 2)]
