import corpus_pipeline
from tables import SF, awkward, frame, words
from test_bpe import library
from test_passages import plain as plain_passages
from test_quality import plain as plain_quality
from test_simhash import plain_components, plain_fingerprint

from __spark_entry__ import oracle_sql, queries
from stratocast.llm import decontamination
from stratocast.llm.common import documents


def test_stages_and_registration():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "decontaminate", "tokenise"]
    names = queries()
    assert {"pipeline", *(n for n in names if n.startswith("op"))} <= set(names)
    assert sorted(int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()) == list(range(1, 14))
    assert "op1_chat" in oracle_sql()


def test_against_plain_stages(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark, SF).collect()]
    items = documents(spark, SF, "benchmark")
    # quality
    judged = [(i, plain_quality(t)) for i, t in rows]
    rows = sorted((i, q[3]) for i, q in judged if q[2])
    # near copies: the smallest id of each group
    top = plain_components([i for i, _ in rows], [plain_fingerprint(t, 4) for _, t in rows])
    rows = [r for r, c in zip(rows, top) if r[0] == c]
    # repeated passages
    kept = {i: k for i, n, gone, k in plain_passages(rows, 50) if n == 0 or gone < n}
    rows = [(i, kept[i]) for i, _ in rows if i in kept]
    # benchmark items (tested against plain tiling on their own)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bad = {r.id for r in decontamination.leaks(df, items).collect()}
    want = {i: k.split() for i, k in rows if i not in bad}
    out = queries()["pipeline"](spark, SF).collect()
    assert {r.doc_id: words(r.text) for r in out} == want and len(out) == len(want)
    assert [r.token_ids for r in out] == library(r.text for r in out)
    assert all(r.n_tokens == len(r.token_ids) and r.n_chars == len(r.text) for r in out)


def test_awkward_rows_and_no_rows(spark):
    for rows in (awkward(), []):
        docs = frame(spark, rows)
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF)
            if name != "tokenise":
                assert docs.columns == columns
        assert docs.columns[: len(columns)] == columns
        assert docs.count() <= len(rows)
