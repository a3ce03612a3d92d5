"""Collocations by dynamic itemset counting over shards of the corpus.

The documents are dealt to shards that are scanned in turn, again and again. Words are counted from the first scan. A
longer phrase is counted from the scan after both of its halves (all words but the last, all but the first) have been
seen often enough, at the same time as the shorter ones, and for one whole cycle: every shard once. A scan therefore counts
phrases of all lengths that are under way, and the work ends when every phrase that was taken up has had its cycle.

What is known of the halves goes to the tasks as one byte for each of 2**BITS hash buckets: the scan after which a
phrase of that bucket first reached the threshold. Phrases that share a bucket are taken up together; that starts some
counts for nothing, but a phrase's first scan depends on its words alone, so each count still covers every shard once.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.llm import words as W
from stratocast.llm.common import documents, keyed, map_arrow
from stratocast.session import cut_lineage, shared_folder

#: Shards of a cycle; buckets for what is known of phrases of one length, as a power of two; phrases that a task holds
#: before it counts them.
SHARDS, BITS, HOLD = 3, 23, 1 << 21
#: Occurrences that make a candidate, words of the longest phrase, phrases of a language in the report, and of 100 occurrences
#: of a candidate so many in one longer candidate drop it.
LEAST, LONGEST, TOP, INSIDE = 10, 3, 2000, 50
#: Stands for "not taken up".
NEVER = 255

_SPLIT = np.zeros(256, dtype=bool)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True
_BETWEEN = _SPLIT | _BLANK
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _between(data: np.ndarray) -> np.ndarray:
    return _BETWEEN[data]


def word_hashes(words: W.Words, lang: np.ndarray) -> np.ndarray:
    """A hash of each word in lower case and the language of its text (a hash for each text)."""
    own = W.range_hashes(W.CODES[_LOWER[words.data]], words.starts, words.ends, 0)
    return W.mix(own + np.repeat(lang.view(np.uint64), words.counts) * np.uint64(0x9E3779B97F4A7C15))


def phrase_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    return h[at] if k == 1 else W.range_hashes(h, at, at + k, 1)


def runs(words: W.Words) -> np.ndarray:
    """How many words from each word on stand in the same piece, at most 255."""
    n = len(words.starts)
    split = np.concatenate([[0], np.cumsum(_SPLIT[words.data])])
    together = np.zeros(n, dtype=bool)
    together[:-1] = split[words.starts[1:]] == split[words.ends[:-1]]
    last = words.first[1:][words.counts > 0] - 1
    together[last] = False
    # the distance to the next word that ends a piece
    ends = np.flatnonzero(~together)
    return np.minimum(ends[np.searchsorted(ends, np.arange(n))] - np.arange(n) + 1, 255) if n else np.zeros(0, dtype=np.int64)


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def sent_to_tasks(spark: SparkSession, tables: dict[int, np.ndarray]) -> Broadcast:
    """Tables of one byte a bucket, mostly of one value: sent compressed. Each task opens them with `opened`."""
    return spark.sparkContext.broadcast({k: zlib.compress(x.view(np.uint8).tobytes(), 1) for k, x in tables.items()})


def opened(sent: Broadcast) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(zlib.decompress(x), dtype=np.uint8) for k, x in sent.value.items()}


def under_way(h: np.ndarray, length: np.ndarray, known: dict[int, np.ndarray], step: int, shards: int, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, places, hashes, first scans) of the phrases of k words that scan `step` counts."""
    at = np.arange(len(h))
    keys = h
    first = np.zeros(len(h), dtype=np.int64)
    for k in range(1, longest + 1):
        live = step < first + shards
        yield k, at[live], keys[live], first[live]
        if k == longest:
            return
        # a phrase is taken up once both halves are; both have been under way before
        mine = np.full(len(h) + 1, NEVER, dtype=np.int64)
        mine[at] = np.maximum(first, known[k][bucket(keys)])
        at = at[length[at] > k]
        first = np.maximum(mine[at], mine[at + 1])
        on = first <= step
        at, first = at[on], first[on]
        keys = phrase_hashes(h, at, k + 1)


#: Length and first scan of a phrase as one number: fewer columns to shuffle.
LENGTH, FIRST = "shiftright(kf, 8)", "(kf & 255)"


def pack(k: int, first: np.ndarray) -> np.ndarray:
    return (k * 256 + first).astype(np.int32)


class Tally:
    """Counts of phrases (length, hash, first scan), combined as they come."""

    def __init__(self):
        self.parts: dict[int, list] = {}
        self.held = 0

    def add(self, k: int, keys: np.ndarray, first: np.ndarray) -> None:
        self.parts.setdefault(k, []).append((keys, first, np.ones(len(keys), dtype=np.int64)))
        self.held += len(keys)

    def combine(self) -> None:
        for k, parts in self.parts.items():
            keys, first, c = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(keys)
            keys = keys[order]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
            c = np.add.reduceat(c[order], heads) if len(heads) else c[:0]
            self.parts[k] = [(keys[heads], first[order[heads]], c)]
        self.held = sum(len(p[0][0]) for p in self.parts.values())

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.combine()
        for k, [(keys, first, c)] in self.parts.items():
            for low in range(0, len(keys), 1 << 16):
                cut = slice(low, low + (1 << 16))
                n = len(keys[cut])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pack(k, first[cut])), pa.array(keys[cut].view(np.int64)), pa.array(c[cut])],
                    names=["kf", "h", "c"],
                )
        self.parts, self.held = {}, 0


def scan(shard: DataFrame, sent: Broadcast, step: int, shards: int, longest: int) -> DataFrame:
    """(kf, h, c): what the tasks of one scan count, by length and first scan and hash. While words are counted, length 0
    has the words of a language, whose hash is h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, tally, sizes = opened(sent), Tally(), {}
        for batch in batches:
            for low, high, words in W.chunks(batch.column(1), _between):
                lang = batch.column(0).slice(low, high - low).to_numpy()
                if step < shards:
                    for key, n in zip(lang.tolist(), words.counts.tolist()):
                        sizes[key] = sizes.get(key, 0) + n
                for k, _, keys, first in under_way(word_hashes(words, lang), runs(words), known, step, shards, longest):
                    tally.add(k, keys, first)
                if tally.held > HOLD:
                    tally.combine()
                    if tally.held > HOLD // 2:
                        yield from tally.rows()
        yield from tally.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(len(sizes), dtype=np.int32)), pa.array(list(sizes), pa.int64()), pa.array(list(sizes.values()), pa.int64())],
            names=["kf", "h", "c"],
        )

    return shard.select("lang_hash", "text").mapInArrow(run, "kf int, h long, c long")


def _marked(phrases: DataFrame) -> np.ndarray:
    """For each bucket whether it holds a phrase of `phrases` (h). At most 2**BITS bits reach the driver."""
    place = f"shiftrightunsigned(h, {64 - BITS})"
    words = phrases.selectExpr(f"cast(shiftright({place}, 5) as int) as w", f"shiftleft(1L, cast({place} & 31 as int)) as b")
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    bits = np.zeros(1 << (BITS - 5), dtype="<u4")
    bits[found.column("w").to_numpy()] = found.column("b").to_numpy().astype("<u4")
    return np.unpackbits(bits.view(np.uint8), bitorder="little").astype(bool)


def counted(corpus: DataFrame, shards: int, least: int, longest: int) -> DataFrame:
    """(k, h, c): all words (k = 1) and phrases of 2 to `longest` words with `least` occurrences or more, and for k = 0 the
    words of every language. `corpus` has the columns shard, lang_hash and text."""
    known = {k: np.full(1 << BITS, NEVER, dtype=np.uint8) for k in range(1, longest)}
    have, step, last = None, 0, 0
    while step < last + shards:
        sent = sent_to_tasks(corpus.sparkSession, known)
        new = scan(corpus.where(F.col("shard") == step % shards), sent, step, shards, longest)
        both = new if have is None else have.unionByName(new)
        sums = both.groupBy("h", "kf").agg(F.sum("c").alias("c"))
        # a phrase whose cycle is over stays if it has been seen often enough
        have = cut_lineage(sums.where(f"{LENGTH} = 0 or c >= {least} or {FIRST} + {shards} - 1 > {step}"))
        sent.destroy()
        for k, taken in known.items():
            reached = _marked(have.where(f"{LENGTH} = {k} and c >= {least}"))
            fresh = reached & (taken == NEVER)
            if fresh.any():
                taken[fresh] = step + 1
                last = step + 1
        step += 1
    return have.selectExpr(f"cast({LENGTH} as byte) as k", "h", "c")


def _texts_of(words: W.Words, at: np.ndarray, k: int) -> pa.Array:
    """The words at, at + 1 ... as phrases in lower case with one space between them."""
    text, starts, ends = words.joined()
    low, sizes = starts[at], ends[at + k - 1] - starts[at]
    total = np.concatenate([[0], np.cumsum(sizes)])
    body = _LOWER[text][np.repeat(low - total[:-1], sizes) + np.arange(total[-1])]
    return pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(total.astype(np.int64)), pa.py_buffer(body)]).cast(pa.string())


def named(corpus: DataFrame, phrases: DataFrame, shards: int, longest: int) -> DataFrame:
    """(k, h, c, lang, lang_hash, phrase) for the phrases (k, h, c), read from the texts shard by shard; what one shard
    has named is not looked for in the next."""
    spark = corpus.sparkSession
    done = None
    for j in range(shards):
        open_ = phrases if done is None else phrases.join(done.select("k", "h"), ["k", "h"], "left_anti")
        sent = sent_to_tasks(spark, {k: _marked(open_.where(F.col("k") == k)) for k in range(2, longest + 1)})

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            open_buckets = {k: x.view(bool) for k, x in opened(sent).items()}
            seen = {k: np.zeros(0, dtype=np.uint64) for k in open_buckets}
            for batch in batches:
                for low, high, words in W.chunks(batch.column(2), _between):
                    codes = batch.column(0).slice(low, high - low).to_numpy()
                    h, length = word_hashes(words, codes), runs(words)
                    doc = words.doc_of()
                    for k, wanted in open_buckets.items():
                        at = np.flatnonzero(length >= k)
                        keys = phrase_hashes(h, at, k)
                        hit = wanted[bucket(keys)]
                        keys, lead = np.unique(keys[hit], return_index=True)
                        near = np.minimum(np.searchsorted(seen[k], keys), max(len(seen[k]) - 1, 0))
                        new = seen[k][near] != keys if len(seen[k]) else np.ones(len(keys), dtype=bool)
                        keys, at = keys[new], at[hit][lead[new]]
                        if not len(keys):
                            continue
                        # forgetting costs a repeated row, not a wrong one
                        seen[k] = keys if len(seen[k]) > HOLD // 2 else np.sort(np.concatenate([seen[k], keys]))
                        rows = pa.array(low + doc[at])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), k, dtype=np.int8)), pa.array(keys.view(np.int64)), batch.column(1).take(rows), pa.array(codes[doc[at]]), _texts_of(words, at, k)],
                            names=["k", "h", "lang", "lang_hash", "phrase"],
                        )

        texts = corpus.where(F.col("shard") == j).select("lang_hash", "lang", "text")
        found = texts.mapInArrow(run, "k byte, h long, lang string, lang_hash long, phrase string")
        one = found.groupBy("k", "h").agg(F.min(F.struct("lang", "lang_hash", "phrase")).alias("p"))
        part = cut_lineage(open_.join(one, ["k", "h"]).select("k", "h", "c", "p.*"))
        sent.destroy()
        done = part if done is None else done.unionByName(part)
    return done


def cuts_of(phrases: DataFrame) -> DataFrame:
    """(k, h, cut, lk, lh, rk, rh): every way to cut a phrase in two, with the lengths and hashes of both sides."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(3), lambda data: data == 0x20):
            part = batch.slice(low, high - low)
            h = word_hashes(words, part.column(2).to_numpy())
            size = part.column(0).to_numpy().astype(np.int64)
            for k in np.unique(size).tolist():
                rows = np.flatnonzero(size == k)
                at = words.first[rows]
                for cut in range(1, k):
                    out = [part.column(0).take(pa.array(rows)), part.column(1).take(pa.array(rows))]
                    for value in (cut, cut):
                        out.append(pa.array(np.full(len(rows), value, dtype=np.int8)))
                    out.append(pa.array(phrase_hashes(h, at, cut).view(np.int64)))
                    out.append(pa.array(np.full(len(rows), k - cut, dtype=np.int8)))
                    out.append(pa.array(phrase_hashes(h, at + cut, k - cut).view(np.int64)))
                    yield pa.RecordBatch.from_arrays(out, names=["k", "h", "cut", "lk", "lh", "rk", "rh"])

    return map_arrow(phrases.select("k", "h", "lang_hash", "phrase"), work, StructType.fromDDL("k byte, h long, cut byte, lk byte, lh long, rk byte, rh long"))


def insides_of(phrases: DataFrame, longest: int) -> DataFrame:
    """(k, h, m): for each phrase of 2 words or more that stands inside a longer one of `phrases` the most occurrences of
    such a one."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(2), lambda data: data == 0x20):
            part = batch.slice(low, high - low)
            h = word_hashes(words, part.column(1).to_numpy())
            size = words.counts
            for k in range(2, longest):
                for shift in range(longest - k + 1):
                    rows = np.flatnonzero((size > k) & (size >= k + shift))
                    inner = phrase_hashes(h, words.first[rows] + shift, k)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), k, dtype=np.int8)), pa.array(inner.view(np.int64)), part.column(0).take(pa.array(rows))], names=["k", "h", "m"])

    longer = map_arrow(phrases.where("k > 2").select("c", "lang_hash", "phrase"), work, StructType.fromDDL("k byte, h long, m long"))
    return longer.groupBy("k", "h").agg(F.max("m").alias("m"))


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, inside: int = INSIDE, shards: int = SHARDS, text_col: str = "text", lang_col: str = "lang"
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the `top` phrases of 2 to `longest` words.

    A phrase is a run of words in one piece of a text, its score floor(1000000 * a * a / (l * r)) for its lowest-scoring
    cut (of equals the first): a, l and r are the occurrences of the phrase and of both sides, n all words of the
    language. Phrases with fewer than `least` occurrences, and those of which `inside` percent or more stand in one longer
    candidate, are not ranked. Equal scores go by a, then by phrase in the order of UTF-8 bytes.

    Null texts are empty; the null language is `und` and one with a language of that name. Repeated rows and ids count as
    often as they stand; a table without phrases gives no rows; other columns are left out."""
    spark = docs.sparkSession
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    rest = keyed(docs.select(lang.alias("lang"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("at")), "at", "text", rest=True)
    # rows are dealt by place and text, so copies of a text are not one shard
    dealt = rest.select(F.pmod(F.xxhash64("id", "th"), F.lit(shards)).cast("int").alias("shard"), F.col("rest.lang").alias("lang"), "text")
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    dealt.select(F.xxhash64("lang").alias("lang_hash"), "lang", "text", "shard").write.partitionBy("shard").parquet(path)
    corpus = spark.read.schema("lang_hash long, lang string, text string, shard int").parquet(path)

    counts = counted(corpus, shards, least, longest)
    phrases = cut_lineage(named(corpus, counts.where("k > 1"), shards, longest))
    known = counts.where("k > 0")
    cut = cuts_of(phrases)
    sides = cut.join(known.toDF("lk", "lh", "l"), ["lk", "lh"]).join(known.toDF("rk", "rh", "r"), ["rk", "rh"])
    exact = lambda c: F.col(c).cast("decimal(15,0)")
    scored = (
        sides.join(phrases.select("k", "h", "c"), ["k", "h"])
        .withColumns({"over": exact("c") * exact("c") * F.lit(1_000_000).cast("decimal(7,0)"), "under": exact("l") * exact("r")})
        .withColumn("score", F.expr("over div under"))
    )
    lowest = scored.groupBy("k", "h").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s"))
    wholes = phrases.join(insides_of(phrases, longest), ["k", "h"], "left").where(F.coalesce(100 * F.col("m") < inside * F.col("c"), F.lit(True)))
    sizes = counts.where("k = 0").select(F.col("h").alias("lang_hash"), F.col("c").alias("n"))
    rows = wholes.join(lowest, ["k", "h"]).select("lang", "lang_hash", "phrase", F.col("c").alias("a"), "s.l", "s.r", "s.score")
    w = Window.partitionBy("lang", "lang_hash").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return best.join(sizes, "lang_hash").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


#: The same rows in DuckDB.
OP13_SQL = r"""
WITH piece AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
words AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM piece),
word AS (SELECT lang, p, generate_subscripts(w, 1) AS pos, unnest(w) AS x FROM words),
near AS (SELECT lang, x, lead(x) OVER o AS y, lead(x, 2) OVER o AS z FROM word WINDOW o AS (PARTITION BY p ORDER BY pos)),
occurrence AS (
  SELECT lang, 1 AS k, x AS phrase FROM near
  UNION ALL SELECT lang, 2, x || ' ' || y FROM near WHERE y IS NOT NULL
  UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM near WHERE z IS NOT NULL),
f AS MATERIALIZED (SELECT lang, k, phrase, lang || chr(9) || phrase AS key, count(*) AS c FROM occurrence GROUP BY ALL),
size AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, c AS a FROM f WHERE k > 1 AND c >= 10),
cut AS (SELECT lang, k, phrase, a, w, unnest(generate_series(1, k - 1)) AS pos FROM cand),
scored AS (
  SELECT cut.lang, cut.k, cut.phrase, a, pos, l.c AS l, r.c AS r,
    CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.c AS HUGEINT) * r.c) AS BIGINT) AS score
  FROM cut JOIN f l ON l.key = cut.lang || chr(9) || array_to_string(cut.w[1:pos], ' ')
  JOIN f r ON r.key = cut.lang || chr(9) || array_to_string(cut.w[pos + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) AS nth FROM scored),
longer AS (
  SELECT lang, inner_, max(a) AS m FROM (
    SELECT lang, a, array_to_string(w[1:2], ' ') AS inner_ FROM cand WHERE k = 3
    UNION ALL SELECT lang, a, array_to_string(w[2:3], ' ') FROM cand WHERE k = 3) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.inner_ = b.phrase WHERE nth = 1 AND NOT (o.m IS NOT NULL AND 100 * o.m >= 50 * b.a)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN size USING (lang) WHERE rank <= 2000"""


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))
