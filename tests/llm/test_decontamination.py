import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tables import SF, awkward, frame

from stratocast.llm import decontamination as d
from stratocast.llm.common import NULL_ID, documents


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def plain_tiles(item, doc, shortest):
    """Greedy tiling word by word: the longest free common run, again and again."""
    free_i, free_d, total = [True] * len(item), [True] * len(doc), 0
    while True:
        best = (shortest - 1, 0, 0)
        for i in range(len(item)):
            for j in range(len(doc)):
                n = 0
                while i + n < len(item) and j + n < len(doc) and free_i[i + n] and free_d[j + n] and item[i + n] == doc[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < shortest:
            return total
        free_i[i : i + n] = free_d[j : j + n] = [False] * n
        total += n


WORDS = st.lists(st.integers(1, 6), max_size=30)


@settings(max_examples=200, deadline=None)
@given(WORDS, WORDS, st.integers(2, 4))
def test_tiles_are_disjoint_equal_runs(item, doc, shortest):
    a, b = np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64)
    seen_i, seen_d = set(), set()
    for i, run, j, n in d.tiles(a, [b], shortest):
        assert run == 0 and n >= shortest and item[i : i + n] == doc[j : j + n]
        assert not seen_i & set(range(i, i + n)) and not seen_d & set(range(j, j + n))
        seen_i |= set(range(i, i + n))
        seen_d |= set(range(j, j + n))


@settings(max_examples=100, deadline=None)
@given(st.permutations(list(range(1, 25))), st.permutations(list(range(1, 25))), st.integers(2, 4))
def test_tiles_cover_as_plain_tiling_without_repeated_words(item, doc, shortest):
    a, b = np.array(item, dtype=np.uint64), np.array(doc, dtype=np.uint64)
    assert sum(n for *_, n in d.tiles(a, [b], shortest)) == plain_tiles(item, doc, shortest)


def test_repeated_words_and_phrases_are_tiled_at_once():
    began = time.process_time()
    for item, doc in ((np.ones(1600), np.ones(8000)), (np.tile(np.arange(7), 200), np.tile(np.arange(7), 2000))):
        found = d.tiles(item.astype(np.uint64), [doc.astype(np.uint64)], 4)
        assert sum(n for *_, n in found) == len(item)
    assert time.process_time() - began < 2


def test_runs_are_kept_apart():
    item = np.arange(1, 13, dtype=np.uint64)
    runs = [item[:0], item[:6], item[:0], item[6:], item[2:9]]
    assert d.tiles(item, runs, 4) == [(2, 4, 0, 7)]
    assert d.tiles(item, runs[:4], 4) == [(0, 1, 0, 6), (6, 3, 0, 6)]


@pytest.mark.parametrize("send", [d.SEND_CHARS, -1])
def test_short_items_leak_where_their_words_stand_in_a_row(spark, send):
    items = [(1, "Answer"), (2, "two words"), (3, "three words, here"), (3, "three words, here"), (4, ""), (5, None), (6, "four words stand here")]
    rows = [(1, "The ANSWER is."), (2, "one two. Words"), (3, "two other words"), (4, "three words here, and two words"), (5, "answer"), (5, "answer"), (6, ""), (7, None), (8, "four words stand here")]
    found = d.leaks(frame(spark, rows), frame(spark, items, columns="item_id long, text string"), send_chars=send).collect()
    want = [(1, 1, 1, 1), (2, 2, 2, 2), (4, 2, 2, 2), (4, 3, 3, 3), (4, 3, 3, 3), (5, 1, 1, 1), (5, 1, 1, 1), (8, 6, 4, 4)]
    assert sorted((r.id, r.item_id, r.item_words, r.covered_words) for r in found) == want


def test_reordered_text_is_covered():
    item = np.arange(1, 41, dtype=np.uint64)
    doc = np.concatenate([item[20:], item[10:20], item[:10]])
    assert sorted(d.tiles(item, [doc], 4)) == [(0, 0, 30, 10), (10, 0, 20, 10), (20, 0, 0, 20)]


def bench(spark):
    return [(r.item_id, r.text) for r in documents(spark, SF, "benchmark").collect()]


def planted(items, rng):
    """Documents with whole, reordered, upper-case and partial items, and clean ones."""
    rows, leaks = [], set()
    for k, (i, text) in enumerate(items):
        parts = text.split(". ")
        rng.shuffle(parts)
        for n, passage in enumerate((text, ". ".join(parts).upper(), re.sub(r"\s+", " — ", text))):
            rows.append((10 * k + n, f"Own words before it. {passage} And after it."))
            leaks.add((10 * k + n, i))
        rows.append((10 * k + 5, " ".join(text.split()[: len(text.split()) // 4]) + " and other words"))
        rows.append((10 * k + 6, None))
    return rows, leaks


@pytest.mark.parametrize("send", [d.SEND_CHARS, -1])
def test_planted_leaks(spark, send):
    items = bench(spark)
    rows, leaks = planted(items, random.Random(1))
    table = frame(spark, items, columns="item_id long, text string")
    found = {(r.id, r.item_id) for r in d.leaks(frame(spark, rows), table, send_chars=send).collect()}
    assert leaks - found == set() or len(leaks - found) < 0.02 * len(leaks)
    assert not {f for f in found if f[0] % 10 >= 5}


def test_both_ways_agree_with_plain_tiling(spark):
    docs = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    items = bench(spark)
    want = set()
    grams = lambda w: {tuple(w[k : k + 4]) for k in range(len(w) - 3)}
    tested = {i: plain_words(t) for i, t in items}
    for doc, text in docs:
        w = plain_words(text)
        g = grams(w)
        for i, item in tested.items():
            own = grams(item) & g
            if len(own) < 3:
                continue
            keep = sorted({j for k in range(len(w) - 3) if tuple(w[k : k + 4]) in own for j in range(k, k + 4)})
            cut, last = [], None  # what lies between cannot be in a tile
            for j in keep:
                if last is not None and j != last + 1:
                    cut.append(object())
                cut.append(w[j])
                last = j
            if plain_tiles(item, cut, 4) >= d.COVERAGE * len(item):
                want.add((doc, i))
    assert {(r.doc_id, r.item_id) for r in d.op10_decontamination(spark, SF).collect()} == want
    joined = d.leaks(documents(spark, SF), documents(spark, SF, "benchmark"), send_chars=-1)
    assert {(r.id, r.item_id) for r in joined.collect()} == want


@pytest.mark.parametrize("send", [d.SEND_CHARS, -1])
def test_awkward_rows(spark, send):
    some = awkward()
    items = [(1, None), (None, some[5][1]), (2, ""), (3, "one two"), (4, some[5][1]), (4, some[5][1]), (5, "a " * 50)]
    rows = some + [(77, "a " * 500), (78, "a a a a a")]
    found = d.leaks(frame(spark, rows), frame(spark, items, columns="item_id long, text string"), send_chars=send).collect()
    assert {(r.id, r.item_id) for r in found if r.item_id == 5} == {(77, 5)}
    assert (5, 4) in {(r.id, r.item_id) for r in found} or len(plain_words(some[5][1])) < 4
    assert all(r.covered_words <= r.item_words for r in found)


def test_no_benchmark_and_no_documents(spark):
    none = frame(spark, [], columns="item_id long, text string")
    for send in (d.SEND_CHARS, -1):
        assert d.leaks(frame(spark, awkward()), none, send_chars=send).count() == 0
        assert d.leaks(frame(spark, []), frame(spark, [(1, "a b c d e f")], columns="item_id long, text string"), send_chars=send).count() == 0


def test_stage_keeps_clean_rows(spark):
    items = bench(spark)[:5]
    rows = awkward() + [(5000, items[0][1]), (5001, "clean words only here")]
    df = frame(spark, rows)
    out = d.decontaminated(df, frame(spark, items, columns="item_id long, text string"))
    assert out.columns == df.columns
    assert sorted(NULL_ID if r.doc_id is None else r.doc_id for r in out.collect()) == sorted(NULL_ID if i is None else i for i, _ in rows if i != 5000)


def test_words_without_punctuation():
    got = []
    for _, _, w in d.plain_words(pa.array(["Ä-b_c «D»… x’y 漢。字", None, "1,2"])):
        body = w.data.tobytes()
        got += [[body[p:q].decode() for p, q in zip(w.starts[m:n], w.ends[m:n])] for m, n in zip(w.first[:-1], w.first[1:])]
    assert got == [["ä", "b", "c", "d", "x", "y", "漢", "字"], [], ["1", "2"]]


@pytest.mark.parametrize("copies", [1, 2, 3])
def test_repeated_items_are_found_both_ways(spark, copies):
    """Half of an item, its parts in another order and all of it, in documents that may be copies themselves."""
    item = [f"word{k}" for k in range(40)]
    parts = [item[k : k + 5] for k in range(0, 40, 5)]
    shuffled = [w for k in (3, 0, 6, 2, 7, 4, 1, 5) for w in parts[k]]
    rows = [(1, " ".join(["before", *item[:20], "after"])), (2, " ".join(shuffled)), (3, " ".join(item)), (3, " ".join(item)), (4, " ".join(item[:19])), (5, "other words only")]
    items = [(9, " ".join(item))] * copies + [(10, "one two three four five")]
    table = frame(spark, items, columns="item_id long, text string")
    want = sorted([(1, 9, 40, 20), (2, 9, 40, 40), (3, 9, 40, 40), (3, 9, 40, 40)] * copies)
    for send in (d.SEND_CHARS, -1):
        found = d.leaks(frame(spark, rows), table, send_chars=send).collect()
        assert sorted((r.id, r.item_id, r.item_words, r.covered_words) for r in found) == want
