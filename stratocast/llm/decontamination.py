"""Benchmark decontamination by greedy string tiling.

Texts are compared as lower-case words without punctuation. Documents and benchmark items that share a seed, a run of
SEED words, are tiled: the longest runs that both have are marked, longest first, so that no word is used twice. An
item leaks into a document when tiles cover enough of it, in whatever order its parts stand there. An item of fewer
than SEED words is one seed, and leaks where all its words stand in a row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.common import documents, id_key, keyed, map_arrow, real_id, text_of, unpacked, without_rows

#: Words of a seed, which is the shortest tile, and the share of an item's words that makes it a leak.
SEED, COVERAGE = 4, 0.5
#: Characters and rows of a benchmark that is sent to every task whole; a larger one is joined.
SEND_CHARS, SEND_ITEMS = 16 << 20, 200_000
#: Bits of the filter of seeds, whatever the benchmark's size.
FILTER_BITS = 21

_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def between_words(data: np.ndarray) -> np.ndarray:
    """ASCII but letters and digits, and the punctuation blocks at U+0080, U+2000 and U+3000."""
    out = ~_LETTER[data]
    c2 = np.flatnonzero(data[:-1] == 0xC2)
    out[c2] = out[c2 + 1] = True
    three = np.flatnonzero(((data[:-2] == 0xE2) | (data[:-2] == 0xE3)) & (data[1:-1] == 0x80)) if len(data) > 2 else c2[:0]
    out[three] = out[three + 1] = out[three + 2] = True
    return out


def plain_words(texts: pa.Array) -> Iterator[tuple[int, int, W.Words]]:
    return W.chunks(pc.utf8_lower(texts.cast(pa.large_string())), between_words)


def tiles(item: np.ndarray, runs: list[np.ndarray], shortest: int) -> list[tuple[int, int, int, int]]:
    """Tiles (place in the item, run, place in the run, words) of the item's word hashes with those of some runs.

    Running Karp-Rabin: windows of the search length that hold no marked word are hashed on both sides; equal ones
    are extended as far as words agree and are free; the longest are marked first. A match much longer than the search
    length raises it; otherwise it is halved down to `shortest`. Ties go to the first place in the item, then the
    first run and place in it. Only equal windows with different words before them begin a match, so a repeated word
    or phrase costs one match for each end of its runs, not one for each pair of its places.
    """
    first = np.cumsum([0, *map(len, runs)])
    doc = np.concatenate([*runs, item[:0]])
    text = np.concatenate([item, doc])  # the item, then the runs: one array, so that one hash compares both
    n = len(item)
    starts = np.concatenate([[0], n + first[:-1]])[[True, *(len(r) > 0 for r in runs)]]
    free = np.ones(len(text), dtype=bool)
    hashed = W.Ranges(text, 2)
    out: list[tuple[int, int, int, int]] = []
    size = max(shortest, n // 2)
    while True:
        room = _room(free, starts)
        i, j = _beginnings(text, hashed, room, starts, n, size)
        length = _agreeing(hashed, i, j, np.minimum(room[i], room[j]), size)
        raised = int(length.max(initial=0))
        if raised > 2 * size:
            size = raised
            continue
        order = np.lexsort((j, i, -length))
        again = False
        for a, b, k in zip(i[order].tolist(), j[order].tolist(), length[order].tolist()):
            ends = free[a] and free[a + k - 1] and free[b] and free[b + k - 1]
            if not ends or not (free[a : a + k].all() and free[b : b + k].all()):
                again |= k > size  # what is left of it may still be long enough
                continue
            free[a : a + k] = free[b : b + k] = False
            r = int(np.searchsorted(first, b - n, side="right")) - 1
            out.append((a, r, b - n - int(first[r]), k))
        if again:
            continue
        if size == shortest:
            return out
        size = max(shortest, size // 2)


def _room(free: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many words from each place are free and in the same run."""
    at = np.arange(len(free))
    stop = np.full(len(free) + 1, len(free))
    stop[:-1][~free] = at[~free]
    stop[starts] = np.minimum(stop[starts], starts)
    after = np.minimum.accumulate(stop[::-1])[::-1]
    return np.where(free, np.minimum(after[1:], len(free)) - at, 0)


def _beginnings(text: np.ndarray, hashed: W.Ranges, room: np.ndarray, starts: np.ndarray, n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the item, in the runs) at which equal free windows of `size` words stand that do not go on from equal
    free words before them."""
    at = np.flatnonzero(room >= size)
    names, window = np.unique(hashed(at, at + size), return_inverse=True)
    before = np.zeros(len(at), dtype=np.int64)  # 0: no free word of the same run stands before
    goes_on = (at > 0) & (room[at - 1] > room[at])
    before[goes_on] = 1 + np.unique(text[at[goes_on] - 1], return_inverse=True)[1]
    split = int(np.searchsorted(at, n))
    order = np.lexsort((before, window))
    mine, theirs = order[order < split], order[order >= split]
    # every place of the item meets the places of its window in the runs, but for the block with the same word before
    key = window * (before.max(initial=0) + 1) + before
    low, high = (np.searchsorted(window[theirs], window[mine], side=s) for s in ("left", "right"))
    skip, skip_to = (np.searchsorted(key[theirs], key[mine], side=s) for s in ("left", "right"))
    none = before[mine] == 0
    skip, skip_to = np.where(none, high, skip), np.where(none, high, skip_to)
    i = np.concatenate([np.repeat(at[mine], skip - low), np.repeat(at[mine], high - skip_to)])
    j = np.concatenate([_spans(low, skip), _spans(skip_to, high)])
    return i, at[theirs[j]]


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0], ..., high[0] - 1, low[1], ..."""
    count = high - low
    total = np.concatenate([[0], np.cumsum(count)])
    return np.repeat(low - total[:-1], count) + np.arange(total[-1])


def _agreeing(hashed: W.Ranges, i: np.ndarray, j: np.ndarray, most: np.ndarray, least: int) -> np.ndarray:
    """How many words agree from i and j on, at least `least` and at most `most`, by halving."""
    low, high = np.full(len(i), least), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = hashed(i, i + middle) == hashed(j, j + middle)
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


@dataclass
class Items:
    """Benchmark items by row: ids, word hashes, and the seeds that find candidates."""

    ids: list[int | None]
    hashes: list[np.ndarray]
    seeds: np.ndarray  # sorted
    owner: np.ndarray  # the item of each seed
    filter: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)  # by words: sorted hashes, their items

    @classmethod
    def of(cls, ids: list[int | None], texts: pa.Array) -> Items:
        hashes: list[np.ndarray] = []
        for _, _, words in plain_words(texts):
            h = words.hashes()
            hashes += [h[a:b] for a, b in zip(words.first[:-1], words.first[1:])]
        keep = [k for k, h in enumerate(hashes) if len(h) >= SEED]
        grams = [np.unique(W.windows(hashes[k], SEED)) for k in keep]
        every = np.concatenate([*grams, np.zeros(0, dtype=np.uint64)])
        names, count = np.unique(every, return_counts=True)
        seeds, owner = [], []
        for k, g in zip(keep, grams):
            chosen = finders(g, count[np.searchsorted(names, g)], len(hashes[k]))
            seeds.append(chosen)
            owner.append(np.full(len(chosen), k))
        flat = np.concatenate([*seeds, every[:0]])
        order = np.argsort(flat, kind="stable")
        short = {}
        for n in range(1, SEED):
            of = np.array([k for k, h in enumerate(hashes) if len(h) == n], dtype=np.int64)
            if len(of):
                whole = np.concatenate([W.windows(hashes[k], n) for k in of])
                by = np.argsort(whole, kind="stable")
                short[n] = whole[by], of[by]
        return cls(ids, hashes, flat[order], np.concatenate([*owner, np.zeros(0, dtype=np.int64)])[order], seed_filter(flat), short)

    def candidates(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `grams`, item) for each of the windows that is a seed."""
        at = np.flatnonzero(self.filter[grams >> np.uint64(64 - FILTER_BITS)])
        return _met(at, grams[at], self.seeds, self.owner)

    def short_found(self, words: W.Words, hashes: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of the short items that stand in the texts, each once."""
        for n, (names, owner) in self.short.items():
            at = np.flatnonzero(W.inside(words, n))
            at, item = _met(at, W.windows(hashes, n)[at], names, owner)
            doc = np.searchsorted(words.first, at, side="right") - 1
            yield from np.unique(np.stack([doc, item], axis=1), axis=0).tolist()


def _met(at: np.ndarray, grams: np.ndarray, names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.searchsorted(names, grams, side="left"), np.searchsorted(names, grams, side="right")
    return np.repeat(at, high - low), owner[_spans(low, high)]


def seed_filter(seeds: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER_BITS, dtype=bool)
    out[seeds >> np.uint64(64 - FILTER_BITS)] = True
    return out


def finders(grams: np.ndarray, items_with: np.ndarray, n_words: int) -> np.ndarray:
    """The item's seeds that are enough to find it: tiles that cover it hold at least `least` different places, so
    of the distinct seeds all but the least - 1 places' most frequent ones are looked for. Repeated seeds inside
    an item count once, which only keeps more of them."""
    places = n_words - SEED + 1
    least = int(np.ceil(COVERAGE * n_words / SEED))
    spare = max(0, least - 1 - (places - len(grams)))
    order = np.lexsort((grams, items_with))
    return grams[order[: max(1, len(grams) - spare)]]


def covered(item: np.ndarray, doc: np.ndarray, grams: np.ndarray) -> int:
    """Words of the item that tiles with the document cover. `grams` are the document's windows of SEED words."""
    if len(item) < SEED:
        return len(item) if len(item) and np.isin(W.windows(item, len(item)), W.windows(doc, len(item)))[0] else 0
    own = np.unique(W.windows(item, SEED))
    hit = np.flatnonzero(np.isin(grams, own))
    if len(np.unique(grams[hit])) == 0:
        return 0
    inside = np.zeros(len(doc) + 1, dtype=np.int64)
    inside[hit] += 1
    inside[hit + SEED] -= 1
    inside = np.cumsum(inside[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.view(np.int8), [0]])))
    return sum(n for _, _, _, n in tiles(item, [doc[a:b] for a, b in zip(edges[::2], edges[1::2])], SEED))


SCHEMA = "id long, th long, item_id long, item_words long, covered_words long"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 5, names=["id", "th", "item_id", "item_words", "covered_words"])


def _sent(rows: DataFrame, items: Items) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(items)

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for low, _, words in plain_words(batch.column(2)):
            h = words.hashes()
            grams = W.windows(h, SEED)
            fits = W.inside(words, SEED)
            at, item = known.candidates(grams)
            at, item = at[fits[at]], item[fits[at]]
            doc = np.searchsorted(words.first, at, side="right") - 1
            out = []
            for d, k in np.unique(np.stack([doc, item], axis=1), axis=0).tolist():
                a, b = words.first[d], words.first[d + 1]
                n = covered(known.hashes[k], h[a:b], grams[a : max(a, b - SEED + 1)])
                if n >= COVERAGE * len(known.hashes[k]):
                    out.append((d, k, n))
            out += [(d, k, len(known.hashes[k])) for d, k in known.short_found(words, h)]
            yield _rows([(batch.column(0)[low + d].as_py(), batch.column(1)[low + d].as_py(), known.ids[k], len(known.hashes[k]), n) for d, k, n in out])

    return map_arrow(rows, work, SCHEMA)


def _joined(rows: DataFrame, items: DataFrame) -> DataFrame:
    """The same for a benchmark of any size: documents and items meet by the seeds that they share."""

    def grams_of(sizes: Sequence[int], whole: bool) -> Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]:
        """The different runs of so many words of each text; `whole`: short runs only of texts that they are all of."""

        def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for low, _, words in plain_words(batch.column(2)):
                h, count = words.hashes(), np.diff(words.first)
                for n in sizes:
                    at = np.flatnonzero(W.inside(words, n))
                    doc = np.searchsorted(words.first, at, side="right") - 1
                    if whole and n < SEED:
                        at, doc = at[count[doc] == n], doc[count[doc] == n]
                    pairs = np.unique(np.stack([doc.astype(np.uint64), W.windows(h, n)[at]], axis=1), axis=0) if len(at) else np.zeros((0, 2), dtype=np.uint64)
                    of = pairs[:, 0].astype(np.int64)
                    ids = (batch.column(c).take(pa.array(low + of)) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 1].view(np.int64)), *ids, pa.array(count[of])], names=["gram", "id", "th", "size"])

        return work

    def tile(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        docs = [w.hashes() for k in range(batch.num_rows) for _, _, w in plain_words(batch.column(2).slice(k, 1))]
        items_h = [w.hashes() for k in range(batch.num_rows) for _, _, w in plain_words(batch.column(4).slice(k, 1))]
        out = []
        for k, (d, i) in enumerate(zip(docs, items_h)):
            n = covered(i, d, W.windows(d, SEED))
            if n >= COVERAGE * len(i):
                out.append((batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(3)[k].as_py(), len(i), n))
        yield _rows(out)

    schema = "gram long, id long, th long, size long"
    named = items.select(id_key("id").alias("item_id"), F.xxhash64("text").alias("item_th"), F.col("text").alias("item_text"))
    # copies of an item count once, or its seeds would seem to repeat; `named` brings each copy back
    once = named.select("item_id", "item_th", "item_text").distinct()
    seeds = map_arrow(once, grams_of(range(1, SEED + 1), True), schema).toDF("gram", "item_id", "item_th", "size")
    short = [r[0] for r in seeds.where(F.col("size") < SEED).select("size").distinct().collect()]  # SEED - 1 rows at most
    found = map_arrow(rows, grams_of([*short, SEED], False), schema).select("gram", "id", "th").join(seeds.select("gram", "item_id", "item_th"), "gram")
    # a leak shares so many different seeds with the item, unless the item repeats itself
    own = seeds.groupBy("item_id", "item_th", "size").agg(F.count("*").alias("own"))
    hits = found.groupBy("id", "th", "item_id", "item_th").agg(F.count("*").alias("hits")).join(own, ["item_id", "item_th"])
    least = F.when(F.col("size") < SEED, 1).otherwise(F.ceil(F.col("size") * COVERAGE / SEED) - (F.col("size") - SEED + 1 - F.col("own")))
    pairs = hits.where(F.col("hits") >= least).select("id", "th", "item_id", "item_th")
    met = pairs.join(rows, ["id", "th"]).join(named, ["item_id", "item_th"])
    return map_arrow(met.select("id", "th", "text", "item_id", "item_text"), tile, SCHEMA).withColumn("item_id", real_id("item_id"))


def leaks(docs: DataFrame, benchmark: DataFrame, send_chars: int = SEND_CHARS, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(id, th, item_id, item_words, covered_words) of every document and item of which tiles cover COVERAGE or more.

    A benchmark of at most `send_chars` characters is sent to every task, where documents are read once and not
    moved; a larger one meets the documents by joins on seeds. Both ways give the same rows. Null and empty texts have
    no leaks; an item of one to three words leaks into every document in which they stand in a row; null document ids come as -2**63; rows that repeat an id are
    tested each; repeated items are reported each, and no benchmark gives no rows.
    """
    rows = keyed(docs, id_col, text_col)
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    size, count = items.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)), F.count("*")).first()
    if size <= send_chars and count <= SEND_ITEMS:
        held = items.toArrow()
        return _sent(rows, Items.of(held["id"].to_pylist(), held["text"].combine_chunks() if held["text"].num_chunks else pa.array([], pa.string())))
    return _joined(rows, items)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))
    return found.select(real_id().alias("doc_id"), "item_id", "item_words", "covered_words", (F.col("covered_words") / F.col("item_words")).alias("coverage"))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without leaks, with all their columns."""
    return without_rows(keyed(docs, rest=True), leaks(docs, benchmark)).select(*unpacked(docs))
