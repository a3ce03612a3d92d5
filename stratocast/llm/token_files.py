"""Token ids in binary files: patched frame-of-reference blocks behind an index of block starts.

A file (extension .pfor, little-endian):

    "PFOR" and the version, two uint32 (fixed values)
    documents, ids, ids per block, blocks: four uint64
    id of each document: int64; token ids of each document: uint64
    start of each block, and the end of the last, counted from the first block: uint64
    blocks: smallest id uint32, exceptions uint32, width uint32; then the ids less the smallest, `width` bits each
    (zero for exceptions), padded to whole bytes; then the places of the exceptions uint32, and their ids less the
    smallest uint32

The width of a block is what `PERCENTILE` of its ids need; those that need more are exceptions. Any block can be read
alone, and so any document.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stratocast.llm import words as W
from stratocast.llm.bpe import Encoder, default_path
from stratocast.llm.common import bound_batches, documents, id_key, map_arrow, real_id, text_of
from stratocast.session import cut_lineage, shared_folder

MAGIC, VERSION = b"PFOR", 1
BLOCK = 1024
PERCENTILE = 0.98
#: A file is closed once it holds so many ids.
FILE_IDS = 1 << 20


def _bits(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs."""
    return np.frexp(values.astype(np.float64))[1]


def pack_blocks(ids: np.ndarray, block: int = BLOCK) -> tuple[bytes, np.ndarray]:
    """(the blocks, where each starts and the last ends)."""
    n = -(-len(ids) // block)
    if not n:
        return b"", np.zeros(1, dtype=np.uint64)
    full = np.concatenate([ids, np.full(n * block - len(ids), ids[-1])]).astype(np.int64).reshape(n, block)
    low = full.min(axis=1)
    rest = full - low[:, None]
    need = _bits(rest)
    sizes = np.full(n, block)
    sizes[-1] = len(ids) - (n - 1) * block
    width = np.partition(need, int(np.ceil(PERCENTILE * block)) - 1, axis=1)[:, int(np.ceil(PERCENTILE * block)) - 1]
    out = (need > width[:, None]) & (np.arange(block) < sizes[:, None])
    count = out.sum(axis=1)
    body = np.where(need > width[:, None], 0, rest).astype(np.uint32)
    packed: list[bytes] = [b""] * n
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        for k in range(0, len(rows), 64):  # a few at once: bits take thirty times the room of ids
            part = rows[k : k + 64]
            octets = np.ascontiguousarray(body[part].astype("<u4")).view(np.uint8).reshape(len(part), block, 4)
            bits = np.unpackbits(octets, axis=2, count=w, bitorder="little")
            for row, data in zip(part, np.packbits(bits.reshape(len(part), -1), axis=1, bitorder="little")):
                packed[row] = data[: -(-int(sizes[row]) * w // 8)].tobytes()
    parts, starts, at = [], [0], 0
    for k in range(n):
        places = np.flatnonzero(out[k])
        data = b"".join([np.array([low[k], count[k], width[k]], dtype="<u4").tobytes(), packed[k], places.astype("<u4").tobytes(), rest[k][places].astype("<u4").tobytes()])
        parts.append(data)
        at += len(data)
        starts.append(at)
    return b"".join(parts), np.array(starts, dtype=np.uint64)


def unpack_block(data: bytes | memoryview, n: int) -> np.ndarray:
    """The n ids of one block."""
    low, count, width = np.frombuffer(data, dtype="<u4", count=3).tolist()
    size = -(-n * width // 8)
    if width:
        body = np.zeros(size + 8, dtype=np.uint8)
        body[:size] = np.frombuffer(data, dtype=np.uint8, count=size, offset=12)
        bit = np.arange(n) * width
        words = np.ndarray(size + 1, dtype="<u8", buffer=body, strides=(1,))
        ids = ((words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << width) - 1)).astype(np.int64)
    else:
        ids = np.zeros(n, dtype=np.int64)
    places = np.frombuffer(data, dtype="<u4", count=count, offset=12 + size)
    ids[places] = np.frombuffer(data, dtype="<u4", count=count, offset=12 + size + 4 * count)
    return (ids + low).astype(np.uint32)


def pack_file(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    blocks, starts = pack_blocks(ids)
    head = np.array([len(doc_ids), len(ids), BLOCK, len(starts) - 1], dtype="<u8").tobytes()
    return b"".join([MAGIC, np.array([VERSION], dtype="<u4").tobytes(), head, doc_ids.astype("<i8").tobytes(), counts.astype("<u8").tobytes(), starts.astype("<u8").tobytes(), blocks])


@dataclass
class TokenFile:
    """A file's index; ids are unpacked when asked for."""

    data: memoryview
    doc_ids: np.ndarray
    counts: np.ndarray
    block: int
    starts: np.ndarray
    first: int
    total: int

    @classmethod
    def of(cls, data: bytes) -> TokenFile:
        if data[:4] != MAGIC or int.from_bytes(data[4:8], "little") != VERSION:
            raise ValueError("this is no token file of a known version")
        docs, total, block, blocks = np.frombuffer(data, dtype="<u8", count=4, offset=8).tolist()
        doc_ids = np.frombuffer(data, dtype="<i8", count=docs, offset=40)
        counts = np.frombuffer(data, dtype="<u8", count=docs, offset=40 + 8 * docs).astype(np.int64)
        starts = np.frombuffer(data, dtype="<u8", count=blocks + 1, offset=40 + 16 * docs).astype(np.int64)
        return cls(memoryview(data), doc_ids, counts, block, starts, 48 + 16 * docs + 8 * blocks, total)

    def ids(self, low: int, high: int) -> np.ndarray:
        """Ids low to high - 1 of the file, from the blocks that hold them."""
        if high <= low:
            return np.zeros(0, dtype=np.uint32)
        a, b = low // self.block, -(-high // self.block)
        parts = [unpack_block(self.data[self.first + self.starts[k] : self.first + self.starts[k + 1]], min(self.block, self.total - k * self.block)) for k in range(a, b)]
        return np.concatenate(parts)[low - a * self.block : high - a * self.block]


def write_token_files(docs: DataFrame, folder: str, end_id: int = 0, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents' token ids, `end_id` after each, in files under `folder` in ascending order of id; the files' list
    as (task, part, name, docs, ids).

    Documents are dealt by ranges of (id, hash of the text), so that an id which holds many rows is spread as well.
    Each task writes files of about FILE_IDS ids. A file gets its name only when it is whole, and a repeated task
    writes the same files again; only what is on the list counts. Null ids come first, as -2**63; null texts are
    empty, so have the end id alone; rows that repeat an id follow each other; no rows give no files. The folder is a
    URI that all executors can write to, of a kind that Arrow's file systems know (s3a: is taken for s3:).
    """
    path = path or default_path()
    rows = docs.select(id_key(id_col).alias("id"), F.xxhash64(text_of(text_col)).alias("th"), text_of(text_col).alias("text"))
    dealt = rows.withColumn("salt", F.rand(11)).repartitionByRange("id", "th", "salt").drop("salt").sortWithinPartitions("id", "th")

    bound_batches(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))
        context = TaskContext.get()
        encoder, part = Encoder.of(path), 0
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def close() -> pa.RecordBatch:
            nonlocal part, held
            doc_ids, counts, ids = (np.concatenate(x) for x in zip(*held))
            name = f"{context.partitionId():06d}-{part:06d}.pfor"
            draft = f"{base}/_{name}.{context.taskAttemptId()}"
            files.create_dir(base, recursive=True)
            with files.open_output_stream(draft) as out:
                out.write(pack_file(doc_ids, counts, ids))
            files.move(draft, f"{base}/{name}")
            row = [[context.partitionId()], [part], [name], [len(doc_ids)], [len(ids)]]
            part, held = part + 1, []
            return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int32()), pa.array(row[1], pa.int32()), pa.array(row[2]), *(pa.array(r, pa.int64()) for r in row[3:])], names=["task", "part", "name", "docs", "ids"])

        size = 0
        for batch in batches:
            all_ids = batch.column(0).to_numpy()
            for low, high, words in W.chunks(batch.column(2)):
                ids, bounds = encoder.encode(words)
                ended = np.insert(ids, bounds[1:], end_id)
                held.append((all_ids[low:high], np.diff(bounds) + 1, ended))
                size += len(ended)
                if size >= FILE_IDS:
                    yield close()
                    size = 0
        if held:
            yield close()

    return cut_lineage(dealt.mapInArrow(write, "task int, part int, name string, docs long, ids long"))


def read_token_files(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the listed files: the ids before it in all files, its
    number of ids, and the checksum of them as little-endian unsigned 32-bit integers.

    Starts need the sums of the files before: one row for each file, added up within its task's files first."""
    tasks = files.groupBy("task").agg(F.sum("ids").alias("task_ids"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    tasks = tasks.select("task", F.coalesce(F.sum("task_ids").over(before), F.lit(0)).alias("task_start"))
    inside = Window.partitionBy("task").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.join(tasks, "task").select("name", (F.col("task_start") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("file_start"))
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def read(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for k in range(batch.num_rows):
            held = TokenFile.of(batch.column(1)[k].as_buffer().to_pybytes())
            bounds = np.concatenate([[0], np.cumsum(held.counts)])
            data = held.ids(0, held.total).astype("<u4").tobytes()
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(sums), pa.string()), pa.array(held.doc_ids), pa.array(bounds[:-1]), pa.array(held.counts), pa.array(sums, pa.int64())], names=["name", "id", "place", "n_tokens", "ids_crc32"])

    found = map_arrow(content, read, "name string, id long, place long, n_tokens long, ids_crc32 long")
    return found.join(starts, "name").select("id", (F.col("file_start") + F.col("place")).alias("start"), "n_tokens", "ids_crc32")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    files = write_token_files(documents(spark, sf_dir), folder)
    return read_token_files(spark, folder, files).select(real_id().alias("doc_id"), "start", "n_tokens", "ids_crc32")
