"""Ranked search of a set of queries over all documents, with the terms that queries share evaluated once.

The queries are taken in blocks of bounded size. For a block, each document's terms that some query holds are written
once with their counts: the document's part of every accumulator. From that table come the documents per term, and in a
second pass over it every task sums, for some documents side by side, each shared term set once and combines the sums
along the graph of `sharing` to the scores of all queries. A task keeps the best documents of each query; what all
tasks keep is ranked in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.llm import words as W
from stratocast.llm.common import documents, keyed, map_arrow, real_id
from stratocast.llm.sharing import share
from stratocast.session import cut_lineage

TOP = 10
#: Terms of all queries of a block. A block's terms and graph are sent to every task.
BLOCK_TERMS = 500_000
#: Cells of the accumulators that a task holds at once, and candidates that it holds before it keeps the best.
CELLS, HOLD = 1 << 22, 1 << 20
#: Tasks whose best documents are ranked together before all are.
SALTS = 64

_TERM = np.zeros(256, dtype=bool)
_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _between(data: np.ndarray) -> np.ndarray:
    return ~_TERM[data]


def _hashes(words: W.Words) -> np.ndarray:
    return W.range_hashes(W.CODES[_LOWER[words.data]], words.starts, words.ends, 0).view(np.int64)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, terms): the different terms of each query as hashes, and one row for copies of a query."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(2), _between):
            h = _hashes(words)
            terms = [np.unique(h[a:b]) for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(terms, pa.list_(pa.int64()))], names=["id", "th", "terms"])

    return map_arrow(keyed(queries, id_col, text_col).dropDuplicates(["id", "th"]), work, StructType.fromDDL("id long, th long, terms array<long>"))


def occurrences(docs: DataFrame, terms: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, tf) for every document with a term: how many terms it has, and which of `terms` (sorted hashes) it
    holds, by their place, how often."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    bits = max(8, min(20, (8 * len(terms)).bit_length()))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = sent.value
        shift = np.uint64(64 - bits)
        maybe = np.zeros(1 << bits, dtype=bool)
        maybe[(known.view(np.uint64) >> shift).astype(np.int64)] = True
        for low, high, words in W.chunks(batch.column(1), _between):
            h = _hashes(words)
            near = np.flatnonzero(maybe[(h.view(np.uint64) >> shift).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, h[near]), max(len(known) - 1, 0))
            hit = known[at] == h[near] if len(known) else np.zeros(0, dtype=bool)
            doc = np.searchsorted(words.first, near[hit], side="right") - 1
            key, tf = np.unique(doc * max(len(known), 1) + at[hit], return_counts=True)
            doc, term = np.divmod(key, max(len(known), 1))
            rows = np.flatnonzero(words.counts)
            bounds = np.searchsorted(doc, np.concatenate([rows, [words.n]])).astype(np.int32)
            ids = batch.column(0).slice(low, high - low).take(pa.array(rows))
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(words.counts[rows].astype(np.int64)), *lists], names=["id", "n", "terms", "tf"])

    rows = keyed(docs, id_col, text_col).select("id", "text")
    return map_arrow(rows, work, StructType.fromDDL("id long, n long, terms array<int>, tf array<int>"))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """10 + (90 * n * n_docs) div n_terms, exact also where the product passes 64 bits."""
    if len(n) and int(n.max()) * n_docs >= 1 << 56:
        return np.array([10 + 90 * x * n_docs // n_terms for x in n.tolist()], dtype=np.int64)
    return 10 + 90 * n * n_docs // max(n_terms, 1)


class Best:
    """The best `top` documents of each query among those seen: by score, then the smallest id."""

    def __init__(self, n_queries: int, top: int):
        self.top, self.floor = top, np.ones(n_queries, dtype=np.int64)
        self.query, self.score, self.id = (np.zeros(0, dtype=np.int64) for _ in range(3))
        self.waiting, self.held = [], 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """Scores (queries, documents)."""
        q, d = np.nonzero(scores >= self.floor[:, None])
        self.waiting.append((q, scores[q, d], ids[d]))
        self.held += len(q)
        if self.held > HOLD:
            self.keep()

    def keep(self) -> None:
        q, s, i = (np.concatenate([a, *b]) for a, b in zip((self.query, self.score, self.id), zip(*self.waiting))) if self.waiting else (self.query, self.score, self.id)
        order = np.lexsort((i, -s, q))
        q, s, i = q[order], s[order], i[order]
        first = np.searchsorted(q, q)
        place = np.arange(len(q)) - first
        stay = place < self.top
        last = np.flatnonzero(place == self.top - 1)
        self.floor[q[last]] = s[last]
        self.query, self.score, self.id = q[stay], s[stay], i[stay]
        self.waiting, self.held = [], 0


def _best(found: DataFrame, by: list[str], top: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def ranked(docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` best documents of each query with a score above 0, equal scores by
    ascending id.

    Null texts have no terms: such documents count nowhere, such queries have no rows. Null ids come first among equal
    scores and stay null. Rows that repeat an id, and copies of a row, are documents of their own; a query that stands
    more than once has its rows as often. Empty tables give no rows; other columns are left out."""
    spark = docs.sparkSession
    items = cut_lineage(query_terms(queries, query_id, query_text))
    size = items.agg(F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()[0]
    blocks = max(1, -(-2 * size // block_terms)) if size > block_terms else 1
    parts = [_block(docs, items.where(F.pmod(F.xxhash64("id", "th"), F.lit(blocks)) == b), top, id_col, text_col) for b in range(blocks)]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    times = keyed(queries, query_id, query_text).groupBy("id", "th").agg(F.count("*").cast("int").alias("times")).where("times > 1")
    out = found.join(times, ["id", "th"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    return out.select(real_id().alias("item_id"), "rank", real_id("doc").alias("doc_id"), "score")


def _block(docs: DataFrame, items: DataFrame, top: int, id_col: str, text_col: str) -> DataFrame:
    """(id, th, rank, doc, score) for the queries of one block, whose terms are bounded."""
    spark = docs.sparkSession
    rows = sorted(((r.id, r.th, np.array(r.terms, dtype=np.int64)) for r in items.where(F.size("terms") > 0).collect()), key=lambda r: r[:2])
    terms = np.unique(np.concatenate([r[2] for r in rows])) if rows else np.zeros(0, dtype=np.int64)
    names = [(r[0], r[1]) for r in rows]
    graph = share([np.searchsorted(terms, r[2]) for r in rows], len(terms))
    held = cut_lineage(occurrences(docs, terms, id_col, text_col))
    n_docs, n_terms = held.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(terms), dtype=np.int64)
    for r in held.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        df[r["term"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
    sent = spark.sparkContext.broadcast((graph, weight, names))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, weight, names = sent.value
        best = Best(len(names), top)
        width = max(1, CELLS // max(graph.n_sets + len(graph.parts), 1))
        for batch in batches:
            for low in range(0, batch.num_rows, width):
                part = batch.slice(low, width)
                ids, n = (part.column(k).to_numpy() for k in (0, 1))
                term, tf = (part.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
                doc = np.repeat(np.arange(len(n)), part.column(2).value_lengths().to_numpy())
                m = length_norm(n, n_docs, n_terms)
                gain = weight[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
                sums = np.zeros(graph.n_groups * len(n), dtype=np.int64)
                np.add.at(sums, graph.group[term] * len(n) + doc, gain)
                best.add(graph.totals(sums.reshape(graph.n_groups, len(n))), ids)
        best.keep()
        where = np.array(names, dtype=np.int64).reshape(-1, 2)[best.query]
        yield pa.RecordBatch.from_arrays([pa.array(where[:, 0]), pa.array(where[:, 1]), pa.array(best.id), pa.array(best.score)], names=["id", "th", "doc", "score"])

    found = held.mapInArrow(scores, "id long, th long, doc long, score long")
    some = _best(found.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))), ["id", "th", "salt"], top)
    return _best(some.drop("rank"), ["id", "th"], top).drop("salt")


#: The same rows in DuckDB.
OP11_SQL = r"""
WITH word AS (
  SELECT d, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS d, doc_id, text FROM documents)),
tf AS (SELECT d, doc_id, term, count(*) AS tf FROM word GROUP BY ALL),
size AS (SELECT d, count(*) AS n FROM word GROUP BY d),
total AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM size),
weight AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, total GROUP BY term, n_docs),
item AS (
  SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS i, item_id, text FROM benchmark)),
score AS (
  SELECT i, item_id, d, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM item JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (d), total GROUP BY ALL),
best AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM best WHERE rank <= 10"""


def op11_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
