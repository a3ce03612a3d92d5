"""Word windows that occur more than once: what suffix and doubling deduplication share.

Only words at content-selected places are moved between tasks: every window of `length` words is represented by the
smallest-hashing run of `seed` words in it, which lies at the same place in every copy of the window. A task first
settles what it can among the texts it holds, so a run that fills a third of the corpus costs one row per chunk of
text, not one per occurrence. Rows are sorted by key, and neighbours are compared as they stream by.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.llm import words as W
from stratocast.llm.common import id_key, map_arrow, packed, salted_join, text_of

ROWS = "key long, kind byte, id long, th int, at int"
NAMES = ["key", "kind", "id", "th", "at"]
#: A place to be compared; a sign that its key occurs elsewhere; a place that its task has settled.
OPEN, SIGN, SETTLED = 0, 1, 2
#: Stands for all places of a document.
EVERY = -1


def keyed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(id, th, text), and the other columns as `rest` if asked for. The id orders the documents, null first. `th` tells rows apart that repeat an id: it is a hash
    of the text, or zero throughout when no id repeats, which moves fewer bytes."""
    ids = docs.select(id_key(id_col).alias("id")).groupBy("id").count()
    unique = ids.where("count > 1").limit(1).isEmpty()
    th = F.lit(0) if unique else F.hash(text_of(text_col))
    rows = [id_key(id_col).alias("id"), th.alias("th"), text_of(text_col).alias("text")]
    return docs.select(*rows, *([packed(docs, text_col).alias("rest")] if rest else []))


def later_copies(rows: DataFrame) -> DataFrame:
    """(id, th, copy) of the documents whose whole text a smaller id has. All of their windows start earlier too, so
    they need no comparison. Texts are reduced to digests before they move, and digests to their first id; a digest
    that very many documents have is spread over tasks."""
    texts = rows.select("id", "th", F.unhex(F.sha2("text", 256)).alias("digest"))
    first = texts.groupBy("digest").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("last > first")
    return salted_join(texts, first.drop("last"), "digest", "id").where("id > first").select("id", "th").distinct().withColumn("copy", F.lit(True))


def own_texts(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """The rows that are no later copies. The text moves by (id, th), as it does in all joins that follow, so that
    one shuffle of the documents serves all of them."""
    return rows.join(copies, ["id", "th"], "left").where("copy is null").drop("copy")


def _batch(key: np.ndarray, kind: np.ndarray, ids: np.ndarray, th: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key), pa.array(kind.astype(np.int8)), pa.array(ids), pa.array(th.astype(np.int32)), pa.array(at.astype(np.int32))], names=NAMES)


def _keys(h: np.ndarray, settled: np.ndarray, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sort key of each row. Settled rows are dealt by their place; the lowest bit keeps them apart."""
    place = W.mix(ids.view(np.uint64) ^ W.mix(at.astype(np.uint64)))
    return np.where(settled, place | np.uint64(1), h & ~np.uint64(1)).view(np.int64)


def _repeated_rows(h: np.ndarray, ids: np.ndarray, th: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """For finding keys that occur twice: places whose key repeats here are settled, with one sign for others."""
    _, lead, inverse, counts = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    settled = counts[inverse] > 1
    signs = lead[counts > 1]
    key = np.concatenate([_keys(h, settled, ids, at), (h[signs] & ~np.uint64(1)).view(np.int64)])
    kind = np.concatenate([np.where(settled, SETTLED, OPEN), np.full(len(signs), SIGN)])
    return _batch(key, kind, *(np.concatenate([x, np.zeros(len(signs), dtype=x.dtype)]) for x in (ids, th, at)))


def _later_rows(h: np.ndarray, ids: np.ndarray, th: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """For finding all but the first place of a key: places after the first one here are settled."""
    order = np.lexsort((at, ids, h))
    h, ids, th, at = h[order], ids[order], th[order], at[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(h)), 0))
    settled = (ids != ids[lead]) | (at != at[lead])
    return _batch(_keys(h, settled, ids, at), np.where(settled, SETTLED, OPEN), ids, th, at)


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(i).to_numpy(zero_copy_only=False) for i in range(5)]


def _places(cols: list[np.ndarray], keep: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(cols[i][keep]) for i in (2, 3, 4)], names=["id", "th", "at"])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places whose key has another row beside it. The last row waits for the next batch."""
    held, known = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        if held is not None:
            cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
        same = cols[0][1:] == cols[0][:-1]
        twice = np.zeros(len(cols[0]), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        twice[0] |= known
        keep = (twice & (cols[1] == OPEN)) | (cols[1] == SETTLED)
        held, known = [c[-1:] for c in cols], bool(twice[-1])
        keep[-1] = False
        yield _places(cols, keep)
    if held is not None:
        yield _places(held, (known & (held[1] == OPEN)) | (held[1] == SETTLED))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places after the first of their key; rows are sorted by key, id and place."""
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _columns(batch)
        n = 0 if first is None else 1
        if n:
            cols = [np.concatenate([a, b]) for a, b in zip(first, cols)]
        key, kind, ids, _, at = cols
        head = np.concatenate([[True], key[1:] != key[:-1]])
        lead = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0))
        keep = (kind == SETTLED) | (ids != ids[lead]) | (at != at[lead])
        keep[:n] = False
        first = [c[lead[-1] : lead[-1] + 1] for c in cols]
        yield _places(cols, keep)


def repeated_places(rows: DataFrame) -> DataFrame:
    """(id, th, at) of all places whose key occurs at another place too."""
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "id long, th int, at int")


def later_places(rows: DataFrame) -> DataFrame:
    """(id, th, at) of all places whose key occurs earlier: at a smaller id, or at the same id further ahead."""
    return rows.repartition("key").sortWithinPartitions("key", "id", "at").mapInArrow(_later, "id long, th int, at int")


def by_document(places: DataFrame) -> DataFrame:
    """(id, th, places): the places of a document in one array, which its own length bounds."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None

        def out(ids: np.ndarray, th: np.ndarray, at: np.ndarray, heads: np.ndarray) -> pa.RecordBatch:
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([heads, [len(ids)]]).astype(np.int32)), pa.array(at))
            return pa.RecordBatch.from_arrays([pa.array(ids[heads]), pa.array(th[heads]), lists], names=["id", "th", "places"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(i).to_numpy() for i in range(3)]
            if held is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(held, cols)]
            ids, th, at = cols
            heads = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (th[1:] != th[:-1])]))
            last = heads[-1]
            held = [c[last:] for c in cols]
            if last:
                yield out(ids[:last], th[:last], at[:last], heads[:-1])
        if held is not None:
            yield out(*held, np.zeros(1, dtype=np.int64))

    return places.repartition("id", "th").sortWithinPartitions("id", "th", "at").mapInArrow(pack, "id long, th int, places array<int>")


def with_places(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(id, th, text, places) for every row of (id, th, text), and `rest` if it has one."""
    return rows.join(by_document(places), ["id", "th"], "left").select("id", "th", "text", "places", *(c for c in rows.columns if c == "rest"))


def with_all_places(rows: DataFrame, copies: DataFrame, places: DataFrame) -> DataFrame:
    """The same for later copies as well: their one place is EVERY."""
    marked = rows.join(copies, ["id", "th"], "left").join(by_document(places), ["id", "th"], "left")
    every = F.when(F.col("copy"), F.array(F.lit(EVERY))).otherwise(F.col("places"))
    return marked.select("id", "th", "text", every.alias("places"), *(c for c in rows.columns if c == "rest"))


Emit = Callable[[W.Words, np.ndarray], tuple[np.ndarray, np.ndarray]]


def place_rows(rows: DataFrame, emit: Emit, later: bool) -> DataFrame:
    """Rows to be sorted, from (id, th, text) or (id, th, text, places). `emit(words, marked)` gives (words at which
    something starts, hash of it); `marked` says for each word whether it is one of its document's places."""
    make = _later_rows if later else _repeated_rows
    listed = "places" in rows.columns

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if listed:
            batch = batch.filter(batch.column(3).is_valid())
        all_ids, all_th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for low, high, words in W.chunks(batch.column(2)):
            marked = np.zeros(len(words.starts), dtype=bool)
            if listed:
                lists = batch.column(3).slice(low, high - low)
                marked[np.repeat(words.first[:-1], lists.value_lengths().to_numpy()) + lists.flatten().to_numpy()] = True
            at, h = emit(words, marked)
            doc = np.searchsorted(words.first, at, side="right") - 1
            yield make(h, all_ids[low + doc], all_th[low + doc], at - words.first[doc])

    return map_arrow(rows, work, ROWS)


def seed_places(length: int, seed: int) -> Emit:
    """The seeds that represent the windows of `length` words."""

    def emit(words: W.Words, _: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = words.hashes()
        anchors = W.distinct(W.minimisers(words, length, seed, hashes)[1])
        return anchors, W.windows(hashes, seed)[anchors]

    return emit


def windows_of_seeds(length: int, seed: int) -> Emit:
    """The windows of `length` words whose seed is marked."""

    def emit(words: W.Words, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes = words.hashes()
        at, anchors = W.minimisers(words, length, seed, hashes)
        at = at[marked[anchors]]
        return at, W.windows(hashes, length, 3)[at]

    return emit


KEPT = "id long, th int, n_words long, n_removed long, spans array<struct<first:int,words:int>>, text string"


def without(rows: DataFrame, length: int, joined: bool) -> DataFrame:
    """Each document without the words that its marked windows of `length` words cover: what was removed as runs of
    words, and the text that stays. `joined` puts one space between the words that stay; otherwise all white space
    stays but for that after a removed word."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(2)):
            lists = batch.column(3).slice(low, high - low).fill_null([])
            total = len(words.starts)
            cover = np.zeros(total + 1, dtype=np.int64)
            doc, place = np.repeat(np.arange(words.n), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()
            begin = W.distinct(words.first[doc[place != EVERY]] + place[place != EVERY])
            whole = np.zeros(words.n, dtype=bool)
            whole[doc[place == EVERY]] = True
            if whole.any():
                fits = np.flatnonzero(W.inside(words, length))
                begin = W.distinct(np.concatenate([begin, fits[np.repeat(whole, words.counts)[fits]]]))
            cover[begin] += 1
            cover[begin + length] -= 1
            gone = np.cumsum(cover[:-1]) > 0
            docs = words.doc_of()
            removed = np.bincount(docs[gone], minlength=words.n)
            edge = np.ones(total, dtype=bool)
            edge[1:] = (gone[1:] != gone[:-1]) | (docs[1:] != docs[:-1])
            run = np.flatnonzero(edge & gone)
            stop = np.concatenate([np.flatnonzero(edge), [total]])
            size = stop[np.searchsorted(stop, run, side="right")] - run
            spans = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(docs[run], np.arange(words.n + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array((run - words.first[docs[run]]).astype(np.int32)), pa.array(size.astype(np.int32))], names=["first", "words"]),
            )
            texts = _joined(words, gone) if joined else _cut(words, gone, run, run + size)
            part = batch.slice(low, high - low)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(words.counts), pa.array(removed.astype(np.int64)), spans, pa.array(texts, pa.string()), *part.columns[4:]],
                names=["id", "th", "n_words", "n_removed", "spans", "text", *(["rest"] if part.num_columns > 4 else [])],
            )

    extra = [f for f in rows.schema.fields if f.name == "rest"]
    return map_arrow(rows, work, StructType([*StructType.fromDDL(KEPT).fields, *extra]))


def _joined(words: W.Words, gone: np.ndarray) -> list[str]:
    text, starts, ends = words.joined()
    keep = np.repeat(~gone, ends - starts + 1)
    body = text[keep].tobytes()
    sizes = np.concatenate([[0], np.cumsum(np.where(gone, 0, ends - starts + 1))])[words.first]
    return [body[a : max(a, b - 1)].decode() for a, b in zip(sizes[:-1], sizes[1:])]


def _cut(words: W.Words, gone: np.ndarray, first: np.ndarray, last: np.ndarray) -> list[str]:
    out, body = [], words.data.tobytes()
    bounds = np.searchsorted(first, words.first)
    for d in range(words.n):
        low, high = int(words.offsets[d]), int(words.offsets[d + 1])
        if bounds[d] == bounds[d + 1]:
            out.append(body[low:high].decode())
            continue
        parts, at = [], low
        for a, b in zip(first[bounds[d] : bounds[d + 1]], last[bounds[d] : bounds[d + 1]]):
            end_of_text = b == words.first[d + 1]
            parts.append(body[at : words.ends[a - 1] if end_of_text and a > words.first[d] else words.starts[a]])
            at = high if end_of_text else int(words.starts[b])
        parts.append(body[at:high])
        out.append(b"".join(parts).decode())
    return out
