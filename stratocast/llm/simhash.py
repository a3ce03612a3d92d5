"""Near copies by 64-bit fingerprints of word shingles, with pigeonring filtering of the candidates.

A fingerprint is a ring of RING segments. If two differ in at most DISTANCE bits, then from some segment on every
chain of l consecutive segments differs in at most floor(l * DISTANCE / RING) bits. With five segments and four bits
the budgets are 0, 1, 2, 3, 4. The first three steps make the index: the first segment is equal, and of the four
halves of the next two at least two are equal, one of them in the second segment. Rows with an equal key then have to
keep the budgets of all chains from that segment before their distance is counted in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.common import documents, keyed, map_arrow, real_id, unpacked, without_rows
from stratocast.llm.components import HOLD, forest, grouped
from stratocast.llm.shingles import shingles_of
from stratocast.session import cut_lineage

DISTANCE = 4
#: Segments of the ring as (first bit, bits).
RING = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Which halves of the second and third segment of a chain are equal: 0, 1 of the second and 2, 3 of the third.
HALVES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))
#: Fingerprints of one key that are compared in one task; larger keys are cut into blocks and compared by pairs of blocks.
BLOCK = 2048

_LANES = np.uint64(0x0101010101010101)


def fingerprints_of(words: W.Words, shingle: int) -> np.ndarray:
    """One unsigned fingerprint for each text; zero for a text without words."""
    h, runs = shingles_of(words, shingle)
    bound = np.concatenate([[0], np.cumsum(runs)])

    # sums of bits: eight byte counters in a word, over blocks of at most 255 shingles of a text
    blocks = -(-runs // 255)
    block_bound = np.concatenate([[0], np.cumsum(blocks)])
    cut = np.repeat(bound[:-1] - 255 * block_bound[:-1], blocks) + 255 * np.arange(block_bound[-1])
    out = np.zeros(words.n, dtype=np.uint64)
    full = np.flatnonzero(runs)
    if not len(full):
        return out
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, cut)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), block_bound[full], axis=0)
        bits = (2 * sums > runs[full][:, None]).astype(np.uint64)
        out[full] |= (bits << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp) for every row: the id with null as the lowest number, a hash of the text, the fingerprint's bits."""

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(2)):
            fp = fingerprints_of(words, shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), pa.array(fp)], names=["id", "th", "fp"])

    return map_arrow(keyed(docs, id_col, text_col), work, "id long, th long, fp long")


def chain_keys(fp: np.ndarray) -> np.ndarray:
    """25 keys of each fingerprint, one in a column for each start of a chain and choice of halves."""
    x = fp.view(np.uint64)
    parts = [(x >> np.uint64(low)) & np.uint64((1 << bits) - 1) for low, bits in RING]
    keys = []
    for start in range(len(RING)):
        head, second, third = (parts[(start + k) % len(RING)] for k in range(3))
        halves = (second & np.uint64(63), second >> np.uint64(6), third & np.uint64(63), third >> np.uint64(6))
        for choice, (p, q) in enumerate(HALVES):
            name = np.uint64(start * len(HALVES) + choice)
            keys.append((name << np.uint64(32)) | (head << np.uint64(14)) | (halves[p] << np.uint64(7)) | halves[q])
    return np.stack(keys, axis=1)


def close(a: np.ndarray, b: np.ndarray, start: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Whether pairs keep the budget of every chain from their start segment, and then their whole distance."""
    x = (a ^ b).view(np.uint64)
    alive = np.arange(len(x))
    spent = np.zeros(len(x), dtype=np.int64)
    low = np.array([s[0] for s in RING], dtype=np.uint64)
    mask = np.array([(1 << s[1]) - 1 for s in RING], dtype=np.uint64)
    for step in range(len(RING)):
        at = (start[alive] + step) % len(RING)
        spent[alive] += np.bitwise_count((x[alive] >> low[at]) & mask[at])
        alive = alive[spent[alive] <= (step + 1) * distance // len(RING)]
    out = np.zeros(len(x), dtype=bool)
    out[alive] = np.bitwise_count(x[alive]) <= distance
    return out


def _links_of(keys: np.ndarray, sides: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links between fingerprints with an equal key. Rows are sorted by key. Of two blocks
    (side 0 and 1) only pairs across are compared; side -1 is compared with itself."""
    a = b = np.zeros(0, dtype=np.int64)
    have_a, have_b, held = [], [], 0
    start = ((keys >> 32) & 31) // len(HALVES)
    at = np.arange(len(keys))
    step = 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        pair = at[(sides[at] < 0) | (sides[at] != sides[at + step])]
        hit = pair[close(fps[pair], fps[pair + step], start[pair])]
        have_a.append(fps[hit])
        have_b.append(fps[hit + step])
        held += len(hit)
        if held > HOLD:
            a, b = forest(np.concatenate([a, *have_a]), np.concatenate([b, *have_b]))
            have_a, have_b, held = [], [], len(a)
        step += 1
    return forest(np.concatenate([a, *have_a]), np.concatenate([b, *have_b]))


def _rows(a: np.ndarray, b: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    key = pa.nulls(len(a), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), key], names=["a", "b", "key"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, side, fp) sorted by key to links (a, b, null). The rows of a key with more than BLOCK
    fingerprints on a side are handed on as (fp, fp, key)."""
    none = np.zeros(0, dtype=np.int64)
    keys, sides, fps = none, none, none
    large = None

    def done(upto: int) -> Iterator[pa.RecordBatch]:
        nonlocal keys, sides, fps
        if upto:
            yield _rows(*_links_of(keys[:upto], sides[:upto], fps[:upto]))
            keys, sides, fps = keys[upto:], sides[upto:], fps[upto:]

    for batch in batches:
        new = [batch.column(i).to_numpy().astype(np.int64) for i in range(3)]
        if large is not None:
            more = int(np.searchsorted(new[0] != large, True)) if (new[0] != large).any() else len(new[0])
            yield _rows(new[2][:more], new[2][:more], np.full(more, large))
            new = [x[more:] for x in new]
            if not len(new[0]):
                continue
            large = None
        keys, sides, fps = (np.concatenate(x) for x in zip((keys, sides, fps), new))
        heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else none
        sizes = np.diff(np.concatenate([heads, [len(keys)]]))
        big = heads[(sizes > BLOCK) & (sides[heads] == -1)]
        if len(big):
            out = np.isin(keys, keys[big])
            yield _rows(fps[out], fps[out], keys[out])
            large = keys[-1] if out[-1] else None
            keys, sides, fps = keys[~out], sides[~out], fps[~out]
            heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else none
        if len(keys) > HOLD // 4 and len(heads) > 1:
            yield from done(int(heads[-1]))
    yield from done(len(keys))


def _sorted_compare(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "side", "fp").mapInArrow(_compare, "a long, b long, key long")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` that connect exactly those within DISTANCE bits: a
    forest of them, not all pairs. A key that holds very many fingerprints is cut into blocks that are compared
    two by two, so that no task compares more than 2 * BLOCK fingerprints of it at once."""

    def expand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low in range(0, batch.num_rows, 1 << 16):
            fp = batch.column(0).slice(low, 1 << 16).to_numpy()
            keys = chain_keys(fp).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.full(keys.size, -1)), pa.array(np.repeat(fp, keys.shape[1]))], names=["key", "side", "fp"])

    first = cut_lineage(_sorted_compare(map_arrow(fps.select("fp"), expand, "key long, side long, fp long")))
    large = first.where("key is not null").select("key", F.col("a").alias("fp"))
    sizes = large.groupBy("key").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("long").alias("blocks"))
    block = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    cut = large.join(sizes, "key").select("key", "blocks", "fp", block.alias("own")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(F.col("own") == F.col("other"), F.lit(-2)).otherwise((F.col("own") > F.col("other")).cast("long"))
    # the key keeps its chain in bits 32 to 36; the pair of blocks goes above
    pair = F.col("key").bitwiseOR(F.shiftleft(F.xxhash64("key", low, high), 37))
    second = _sorted_compare(cut.select(pair.alias("key"), side.cast("long").alias("side"), "fp"))
    return first.where("key is null").select("a", "b").unionByName(second.select("a", "b"))


def near_copies(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, fp, component): each row's fingerprint and the smallest id that it reaches over links, its own
    included. Rows without words have fingerprint zero and link like others. Null ids count as the lowest id and
    come back as null in `op3`; rows that repeat an id are rows of their own. No rows give no rows. Equal
    fingerprints are one node, so copies are never paired; the rows of a node are spread over tasks."""
    rows = cut_lineage(fingerprints(docs, shingle, id_col, text_col))
    return grouped(rows, links)


def first_of_groups(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The documents without near copies (fingerprints of `shingle` words within DISTANCE bits, linked over others): of
    each component the one with the smallest id stays (of rows that repeat that id the one with the smallest hash of the
    text, and of whole copies of that row one). All columns stay. Texts without words, null ones too, are one group. No
    rows give no rows. The documents do not move if the list of those that go is short."""
    found = cut_lineage(near_copies(docs, shingle))
    chosen = found.groupBy("component").agg(F.min(F.struct("id", "th")).alias("k")).select("k.id", "k.th")
    rows = without_rows(keyed(docs, rest=True), found.join(chosen, ["id", "th"], "left_anti"))
    # whole copies of a row that stays
    repeated = cut_lineage(found.groupBy("id", "th").agg(F.count("*").alias("times")).where("times > 1").join(chosen, ["id", "th"]).select("id", "th"))
    if not repeated.isEmpty():
        once = without_rows(rows, repeated)
        rows = once.unionByName(rows.join(repeated, ["id", "th"], "left_semi").dropDuplicates(["id", "th"]))
    return rows.select(*unpacked(docs))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_copies(documents(spark, sf_dir), shingle=4)
    return out.select(real_id().alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), real_id("component").alias("component_id"))
