"""Byte-pair encoding by ranks, with a segment tree over byte positions; decoding.

A match of the splitting pattern starts as single bytes. Leaf p of a binary tree holds rank * size + p of the pair that
starts at byte p, where the pair's rank is that of its joined bytes in the vocabulary; every inner node holds the
smaller of its two children, so the root names the leftmost pair of the smallest rank. A merge changes the pair that
starts there, the pair before it and the pair that vanishes: three leaves, and the nodes above them. Matches of one
tree size are worked on side by side in numpy; a match longer than WIDE bytes has a tree of its own.

Texts are cut only where the pattern always cuts: between a word and the ASCII white space after it, and before a mark of
punctuation after a letter. What each such
piece encodes to is remembered per worker, in bounded tables.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.llm import words as W
from stratocast.llm.bpe import Encoder
from stratocast.llm.common import documents, keyed, map_arrow, real_id

#: Bytes of a match from which it has a tree of its own, and cells of the trees that are worked on side by side.
WIDE, CELLS = 128, 1 << 21
#: Stands for "no such pair" in leaves.
NONE = np.int64(1) << np.int64(62)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: lines of base64 bytes, a space and the rank. The path may be any that Arrow
    knows."""
    if "://" in path:
        files, place = pyarrow.fs.FileSystem.from_uri(path)
    else:
        files, place = pyarrow.fs.LocalFileSystem(), path
    with files.open_input_stream(place) as f:
        lines = f.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line)}


class TreeEncoder(Encoder):
    """A vocabulary of ranks in this process. The tables of remembered pieces are those of `Encoder`."""

    _open: dict[tuple[str, str], TreeEncoder] = {}

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        # the public pattern cuts between letters and marks; of another one that is not known
        self.cut_marks = pattern == default_pattern()
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"{path} has no token for the bytes {missing}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        # every way to join two tokens to a third; its id is its rank
        self.span = max(self.ranks.values()) + 1
        pairs = {
            self.ranks[token[:k]] * self.span + self.ranks[token[k:]]: rank
            for token, rank in self.ranks.items()
            for k in range(1, len(token))
            if token[:k] in self.ranks and token[k:] in self.ranks
        }
        self.pairs = pairs
        # the pairs as an open hash table with linear probing
        bits = max(4, (2 * len(pairs)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.table_key = np.full(1 << bits, -1, dtype=np.int64)
        self.table_rank = np.full(1 << bits, NONE, dtype=np.int64)
        keys = np.fromiter(pairs, dtype=np.int64, count=len(pairs))
        ranks = np.fromiter(pairs.values(), dtype=np.int64, count=len(pairs))
        at = self._slot(keys)
        while len(keys):
            free = self.table_key[at] < 0
            self.table_key[at[free]], self.table_rank[at[free]] = keys[free], ranks[free]
            left = self.table_key[at] != keys
            keys, ranks, at = keys[left], ranks[left], (at[left] + 1) & (len(self.table_key) - 1)
        self.forget()

    @classmethod
    def of(cls, path: str, pattern: str) -> TreeEncoder:
        if (path, pattern) not in cls._open:
            cls._open[path, pattern] = cls(path, pattern)
        return cls._open[path, pattern]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of neighbouring tokens, NONE where the vocabulary lacks it."""
        key = a * self.span + b
        at = self._slot(key)
        out = np.where(self.table_key[at] == key, self.table_rank[at], NONE)
        open_ = np.flatnonzero((self.table_key[at] != key) & (self.table_key[at] >= 0))
        mask = len(self.table_key) - 1
        at = at[open_]
        while len(open_):
            at = (at + 1) & mask
            have = self.table_key[at]
            hit = have == key[open_]
            out[open_[hit]] = self.table_rank[at[hit]]
            go = ~hit & (have >= 0)
            open_, at = open_[go], at[go]
        return out

    # one match

    def merge_one(self, data: bytes) -> list[int]:
        """The ids of one long match by a tree of its own."""
        n, span, pairs, none = len(data), self.span, self.pairs, int(NONE)
        size = 1 << max(1, (n - 1).bit_length())
        token = [int(x) for x in self.byte_ids[np.frombuffer(data, dtype=np.uint8)]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = np.full(2 * size, none, dtype=np.int64)
        if n > 1:
            ids = np.array(token, dtype=np.int64)
            rank = self.rank_of(ids[:-1], ids[1:])
            tree[size : size + n - 1] = np.where(rank < NONE, rank * size + np.arange(n - 1), NONE)
        step = size
        while step > 1:
            tree[step // 2 : step] = np.minimum(tree[step : 2 * step : 2], tree[step + 1 : 2 * step : 2])
            step //= 2
        tree = tree.tolist()

        def put(leaf: int, value: int) -> None:
            node = size + leaf
            tree[node] = value
            while node > 1:
                low = min(tree[node], tree[node ^ 1])
                node >>= 1
                if tree[node] == low:
                    break
                tree[node] = low

        def pair(p: int) -> int:
            q = after[p]
            rank = pairs.get(token[p] * span + token[q]) if q < n else None
            return none if rank is None else rank * size + p

        while tree[1] < none:
            rank, p = divmod(tree[1], size)
            q = after[p]
            token[p], token[q] = rank, -1
            after[p] = after[q]
            if after[p] < n:
                before[after[p]] = p
            put(q, none)
            put(p, pair(p))
            if before[p] >= 0:
                put(before[p], pair(before[p]))
        return [t for t in token if t >= 0]

    # many matches of one tree size

    def merge_many(self, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
        """Tokens of every match flat[starts:starts + lengths], lengths at most `size`: (matches, size), -1 where a
        byte's token went into one before it."""
        b = len(starts)
        at = starts[:, None] + np.arange(size)
        inside = np.arange(size) < lengths[:, None]
        token = np.where(inside, self.byte_ids[flat[np.minimum(at, len(flat) - 1)]], -1)
        after = np.tile(np.arange(1, size + 1), (b, 1))
        before = np.tile(np.arange(-1, size - 1), (b, 1))
        tree = np.full((b, 2 * size), NONE, dtype=np.int64)
        row, col = np.nonzero(inside[:, 1:])
        rank = self.rank_of(token[row, col], token[row, col + 1])
        tree[row, size + col] = np.where(rank < NONE, rank * size + col, NONE)
        step = size
        while step > 1:
            tree[:, step // 2 : step] = np.minimum(tree[:, step : 2 * step : 2], tree[:, step + 1 : 2 * step : 2])
            step //= 2

        def put(row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
            node = size + leaf
            tree[row, node] = value
            level = size
            while level > 1:
                low = np.minimum(tree[row, node], tree[row, node ^ 1])
                node = node >> 1
                tree[row, node] = low
                level >>= 1

        def pair(row: np.ndarray, p: np.ndarray) -> np.ndarray:
            out = np.full(len(row), NONE, dtype=np.int64)
            q = after[row, p]
            ok = np.flatnonzero(q < lengths[row])
            rank = self.rank_of(token[row[ok], p[ok]], token[row[ok], q[ok]])
            out[ok] = np.where(rank < NONE, rank * size + p[ok], NONE)
            return out

        live = np.flatnonzero(tree[:, 1] < NONE)
        while len(live):
            rank, p = np.divmod(tree[live, 1], size)
            q = after[live, p]
            token[live, p], token[live, q] = rank, -1
            nxt = after[live, q]
            after[live, p] = nxt
            ok = nxt < size
            before[live[ok], nxt[ok]] = p[ok]
            put(live, q, np.full(len(live), NONE))
            put(live, p, pair(live, p))
            prev = before[live, p]
            ok = np.flatnonzero(prev >= 0)
            put(live[ok], prev[ok], pair(live[ok], prev[ok]))
            live = live[tree[live, 1] < NONE]
        return token

    def matches(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all matches one after the other, how many each has). A match that is a token is that token."""
        ids: list = [None] * len(parts)
        groups: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            whole = self.ranks.get(part)
            if whole is not None:
                ids[k] = [whole]
            elif len(part) > WIDE:
                ids[k] = self.merge_one(part)
            else:
                groups.setdefault(1 << (len(part) - 1).bit_length(), []).append(k)
        for size, rows in groups.items():
            many = max(1, CELLS // size)
            for low in range(0, len(rows), many):
                some = rows[low : low + many]
                lengths = np.array([len(parts[k]) for k in some], dtype=np.int64)
                flat = np.frombuffer(b"".join(parts[k] for k in some), dtype=np.uint8)
                token = self.merge_many(flat, np.cumsum(lengths) - lengths, lengths, size)
                for k, row in zip(some, token.tolist()):
                    ids[k] = [t for t in row if t >= 0]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        return np.fromiter((t for some in ids for t in some), dtype=np.int32, count=int(sizes.sum())), sizes

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes) of pieces: each is split by the pattern, equal matches are encoded once."""
        body, seen, uses, each = data.tobytes(), {}, [], []
        for a, b in zip(starts.tolist(), ends.tolist()):
            found = self.pattern.findall(body[a:b].decode())
            each.append(len(found))
            uses += [seen.setdefault(m, len(seen)) for m in found]
        ids, sizes = self.matches([m.encode() for m in seen])
        begins = np.cumsum(sizes) - sizes
        use = np.array(uses, dtype=np.int64)
        many = sizes[use]
        total = np.concatenate([[0], np.cumsum(many)])
        flat = ids[np.repeat(begins[use] - total[:-1], many) + np.arange(total[-1])]
        cuts = total[np.concatenate([[0], np.cumsum(each)])]
        return np.arange(len(starts)), flat, np.diff(cuts)


class ByteDecoder:
    """The bytes of every id of a vocabulary file, one after the other."""

    _open: dict[str, ByteDecoder] = {}

    def __init__(self, path: str):
        ranks = read_ranks(path)
        parts = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            parts[rank] = token
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.table = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @classmethod
    def of(cls, path: str) -> ByteDecoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all runs ids[bounds[k]:bounds[k + 1]], where each run's bytes begin and the last end)."""
        sizes = self.table[ids + 1] - self.table[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        return self.flat[np.repeat(self.table[ids] - total[:-1], sizes) + np.arange(total[-1])], total[bounds]


def encode_ranks(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, token_ids) for every row: the ids of the whole text by the ranks in `path`, each match of `pattern`
    encoded on its own, without special tokens. Null and empty texts have no ids; rows that repeat an id or a text have
    a row each; the id is -2**63 where it is null; no rows give no rows; other columns, whatever their names, are left
    out. A text of any length is one row and is worked on whole."""
    path, pattern = path or default_path(), pattern or default_pattern()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = TreeEncoder.of(path, pattern)
        for low, high, words in W.chunks(batch.column(2)):
            ids, bounds = encoder.encode(words)
            lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), batch.column(1).slice(low, high - low), lists], names=["id", "th", "token_ids"])

    return map_arrow(keyed(docs, id_col, text_col), work, StructType.fromDDL("id long, th long, token_ids array<int>"))


def decode_ranks(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(id, th, token_ids, packed, decoded): the row's ids as little-endian unsigned 32-bit integers and the bytes that
    they stand for, which need not be UTF-8. Null ids give null in both, no ids no bytes; repeated rows stay."""
    path = path or default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = ByteDecoder.of(path)
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            lists = part.column(2)
            bounds = np.concatenate([[0], np.cumsum(lists.fill_null([]).value_lengths().to_numpy())])
            ids = lists.flatten().to_numpy()
            missing = lists.is_null().to_pylist()
            out = []
            for body, cuts in ((ids.astype("<u4"), 4 * bounds), decoder.decode(ids.astype(np.int64), bounds)):
                body, cuts = body.tobytes(), cuts.tolist()
                out.append(pa.array([None if gone else body[a:b] for a, b, gone in zip(cuts[:-1], cuts[1:], missing)], pa.binary()))
            yield pa.RecordBatch.from_arrays([*part.columns, *out], names=["id", "th", "token_ids", "packed", "decoded"])

    return map_arrow(tokens.select("id", "th", "token_ids"), work, StructType.fromDDL("id long, th long, token_ids array<int>, packed binary, decoded binary"))


def op12_rank_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode_ranks(encode_ranks(documents(spark, sf_dir)))
    return out.select(real_id().alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
