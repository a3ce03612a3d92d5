import collections
import hashlib

import pytest
from tables import SF, WORD, awkward, frame, words

from stratocast.llm import passages
from stratocast.llm.common import NULL_ID, documents
from stratocast.llm.doubling import drop_windows, op6_substring_dedup, repeated_lengths
from stratocast.llm.suffixes import drop_repeats, op5_suffix_dedup, without_repeats


def plain(rows, length):
    """(id, words, removed, kept words) of each row: windows that start earlier elsewhere are removed."""
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - length + 1):
            g = tuple(w[k : k + length])
            first[g] = min(first.get(g, (i, k)), (i, k))
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - length + 1):
            if first[tuple(w[k : k + length])] != (i, k):
                gone[k : k + length] = [True] * length
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def keyed(rows):
    return [(NULL_ID if i is None else i, t) for i, t in rows]


def got(df):
    return sorted((r.id, r.n_words, r.n_removed, r.text) for r in df.collect())


@pytest.mark.parametrize("length", [2, 5, 20])
def test_doubling_on_awkward_rows(spark, length):
    rows = awkward(length)
    assert got(drop_windows(frame(spark, rows), length, joined=True)) == plain(keyed(rows), length)


@pytest.mark.parametrize("length, seed", [(4, 2), (9, 4), (12, 1), (50, 25)])
def test_suffixes_on_awkward_rows(spark, length, seed):
    rows = awkward(length)
    assert got(drop_repeats(frame(spark, rows), length, seed, joined=True)) == plain(keyed(rows), length)


@pytest.mark.parametrize("query, length", [(op6_substring_dedup, 20), (op5_suffix_dedup, 50)])
def test_whole_table(spark, query, length):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    want = [(i, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for i, n, gone, kept in plain(rows, length)]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in query(spark, SF).collect()) == want


def test_small_chunks_and_batches(spark, monkeypatch):
    rows = awkward(3)
    want = plain(keyed(rows), 6)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert got(drop_windows(frame(spark, rows), 6, joined=True)) == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)


def test_spans_and_text_agree(spark):
    rows = awkward(5)
    texts = {(NULL_ID if i is None else i, t or "") for i, t in rows}
    for r in drop_repeats(frame(spark, rows), 8, 4).collect():
        source = [t for i, t in texts if i == r.id]
        kept = [w for t in source for w in [[x for k, x in enumerate(words(t)) if not any(s.first <= k < s.first + s.words for s in r.spans)]] if words(r.text) == w]
        assert kept and sum(s.words for s in r.spans) == r.n_removed
        if not r.n_removed:
            assert r.text in source


def test_levels_until_none_survive(spark):
    rows = awkward(2)
    counts = collections.Counter()
    places = collections.defaultdict(list)
    length = 2
    while length == 2 or any(len(found) > 1 for found in places.values()):
        length *= 2
        places.clear()
        for i, t in keyed(rows):
            w = WORD.findall(t or "")
            for k in range(len(w) - length + 1):
                places[tuple(w[k : k + length])].append(i)
        for found in places.values():
            if len(found) > 1:
                counts.update((i, length) for i in found)
    out = repeated_lengths(frame(spark, rows), 4).groupBy("id", "length").sum("windows").collect()
    assert {(r.id, r.length): r[2] for r in out} == dict(counts)


def test_stage_keeps_columns(spark):
    rows = awkward(4)
    df = frame(spark, rows).selectExpr("*", "1 AS n_chars")
    out = without_repeats(df)
    assert out.columns == df.columns and out.dtypes == df.dtypes
    want = [(i, k.split()) for i, n, gone, k in plain(keyed(rows), 50) if n == 0 or gone < n]
    have = [(NULL_ID if r.doc_id is None else r.doc_id, words(r.text)) for r in out.collect()]
    assert sorted(have) == sorted(want)
    assert all(r.n_chars == len(r.text) and r.key == "7" for r in out.collect())


def test_one_hot_passage_in_many_documents(spark):
    """A passage in every document costs a row per chunk of text before the shuffle, not one per occurrence."""
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"a{k} b{k} {passage} c{k} d{k}") for k in range(500)]
    out = drop_repeats(frame(spark, rows, extra=False).coalesce(1)).collect()
    assert sorted(r.n_removed for r in out) == [0] + [60] * 499
    own = passages.keyed_rows(frame(spark, rows, extra=False).coalesce(1))
    suffixes = passages.place_rows(own, passages.seed_places(50, 25), later=False)
    assert suffixes.where(f"kind <> {passages.SETTLED}").groupBy("key").count().agg({"count": "max"}).first()[0] <= 2


@pytest.mark.parametrize("fn", [drop_windows, drop_repeats, without_repeats, repeated_lengths])
def test_empty_table(spark, fn):
    assert fn(frame(spark, [])).count() == 0
