"""Byte-pair encoding and decoding of whole texts.

A text is cut only where the vocabulary's own splitting pattern always cuts: between a word and the white space after
it, and before a mark of punctuation after a letter. Each distinct piece is encoded once and its ids are copied to every place where it stands. A long piece without
white space is encoded by tree concatenation: halves on their own, in separate tasks, then windows around each join.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stratocast.llm import words as W
from stratocast.llm.common import documents, keyed, map_arrow, real_id, unpacked, unused
from stratocast.session import cut_lineage

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Bytes from which a piece without white space counts as long, and bytes of a leaf of its tree.
LONG, LEAF = 4096, 1024
#: A worker remembers pieces in two tables of 2**SLOTS places, and their ids in room for ROOM ids. Nothing but time
#: depends on it; ROOM should hold some eight ids for each place of the first table. New pieces are given to the library
#: so many at a time.
SLOTS, ROOM, AT_ONCE = 19, 1 << 23, 4096
#: Tokens on each side of a join that are encoded again at first.
WINDOW = 4


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _white_end(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether a word's last character may be white space to the pattern (beyond ASCII's): no cut after it."""
    size = ends - starts
    a = data[ends - 1]
    b = data[np.maximum(ends - 2, 0)]
    c = data[np.maximum(ends - 3, 0)]
    out = (a >= 0x1C) & (a <= 0x1F)
    out |= (size >= 2) & (b == 0xC2) & ((a == 0x85) | (a == 0xA0))
    three = (size >= 3) & (a >= 0x80)
    out |= three & (c == 0xE1) & (b == 0x9A) & (a == 0x80)
    out |= three & (c == 0xE2) & (b == 0x80) & ((a <= 0x8A) | (a == 0xA8) | (a == 0xA9) | (a == 0xAF))
    out |= three & (c == 0xE2) & (b == 0x81) & (a == 0x9F)
    return out | (three & (c == 0xE3) & (b == 0x80) & (a == 0x80))


#: Punctuation that often ends a word, and letters of one byte.
_MARK = np.zeros(256, dtype=bool)
_MARK[[*b",.;:!?"]] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True


def _marks(data: np.ndarray) -> np.ndarray:
    """Where punctuation follows a letter (of ASCII, or one from U+00C0 to U+00FF): the pattern cuts there, too, and a word
    is the same piece with and without it."""
    at = np.flatnonzero(_MARK[data[1:]]) + 1
    a, b = data[at - 1], data[np.maximum(at - 2, 0)]
    wide = (b == 0xC3) & (at > 1) & (a >= 0x80) & (a <= 0xBF) & (a != 0x97) & (a != 0xB7)
    return at[_LETTER[a] | wide]


class Encoder:
    """A vocabulary file of the tokenizers library in this process."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.special = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        # no cut may fall into a special token
        self.cut_marks = not any(_MARK[list(x.encode())].any() for x in self.special)
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        # a character of a name is a byte of the token, but for special tokens, which stand for their own text
        self.bytes_of = np.array([len(n.encode()) if n in self.special else len(n) for n in self.names], dtype=np.int64)
        self.forget()

    def forget(self) -> None:
        """Empty tables of remembered pieces."""
        self.keys = np.zeros((2, 1 << SLOTS), dtype=np.uint64)
        self.begins = np.zeros((2, 1 << SLOTS), dtype=np.int32)
        self.sizes = np.zeros((2, 1 << SLOTS), dtype=np.int32)
        self.store, self.used = np.empty(ROOM, dtype=np.int32), 0

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    # what is remembered: a piece that came first keeps its place in the first table; where that is taken, the second
    # table holds the piece that came last

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (h >> np.uint64(64 - SLOTS)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << SLOTS) - 1)).astype(np.int64)

    def _make_room(self) -> None:
        """Once half of the room is used, only the pieces of the first table stay, or none if they take too much."""
        if self.used <= ROOM // 2:
            return
        live = np.flatnonzero(self.keys[0])
        sizes = self.sizes[0][live].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        if total[-1] > ROOM // 4:
            live, total = live[:0], total[:1]
            self.keys[0] = 0
        else:
            moved = self.store[np.repeat(self.begins[0][live] - total[:-1], sizes) + np.arange(total[-1])]
            self.store = np.empty(ROOM, dtype=np.int32)
            self.store[: len(moved)] = moved
            self.begins[0][live] = total[:-1]
        self.used = int(total[-1])
        self.keys[1] = 0

    def _remember(self, h: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Where the ids of each new piece begin."""
        begins = self.used + np.concatenate([[0], np.cumsum(sizes)])[:-1]
        if self.used + len(ids) > len(self.store):
            self.store = np.concatenate([self.store[: self.used], np.empty(max(ROOM, 2 * len(ids)), dtype=np.int32)])
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        first, second = self._places(h)
        free = self.keys[0][first] == 0
        for table, at, rows in ((0, first[free], free), (1, second[~free], ~free)):
            self.keys[table][at], self.begins[table][at], self.sizes[table][at] = h[rows], begins[rows], sizes[rows]
        return begins

    # encoding

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def merge(self, piece: str) -> list[int]:
        """The ids of one unsplit piece, written in the vocabulary's byte characters."""
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring parts as one: tokens around the join are encoded again, in windows that grow
        until the first and the last token come out as they were. Then every pair of neighbours is one that the
        merges leave alone, which makes the whole the encoding of the whole."""
        if not left or not right:
            return left or right
        size = WINDOW
        while True:
            a, b = left[-size:], right[:size]
            new = self.merge("".join(self.names[i] for i in a + b))
            left_ok = len(a) == len(left) or new[0] == a[0]
            right_ok = len(b) == len(right) or new[-1] == b[-1]
            if left_ok and right_ok:
                return left[: len(left) - len(a)] + new + right[len(b) :]
            size *= 2

    def tree(self, parts: list[list[int]]) -> list[int]:
        """Neighbouring parts, joined in pairs until one is left."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def split_long(self, text: str) -> list[tuple[str, bool]]:
        """A long piece as (part, whether it joins the part before it): what the pattern separates stands alone, and
        what it doesn't is cut into leaves, written in byte characters."""
        out: list[tuple[str, bool]] = []
        for stretch in self._between_special(text):
            if stretch in self.special:
                out.append((stretch, False))
                continue
            for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(stretch):
                out += [(piece[k : k + LEAF], k > 0) for k in range(0, len(piece), LEAF)]
        return out

    def _between_special(self, text: str) -> list[str]:
        parts = [text]
        for mark in sorted(self.special, key=len, reverse=True):
            cut = []
            for part in parts:
                if part in self.special:
                    cut.append(part)
                    continue
                bits = part.split(mark)
                for k, bit in enumerate(bits):
                    cut += [mark] * (k > 0) + [bit] * bool(bit)
            parts = cut
        return parts

    def leaf(self, part: str) -> list[int]:
        return [self.tokenizer.token_to_id(part)] if part in self.special else self.merge(part)

    def assemble(self, parts: list[tuple[list[int], bool]]) -> list[int]:
        """The ids of a long piece from those of its leaves."""
        out: list[int] = []
        group: list[list[int]] = []
        for ids, joins in parts:
            if not joins and group:
                out += self.tree(group)
                group = []
            group.append(ids)
        return out + self.tree(group)

    def long(self, text: str) -> list[int]:
        return self.assemble([(self.leaf(p), joins) for p, joins in self.split_long(text)])

    def pieces(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the pieces of the texts; together they are all bytes."""
        cuts = [words.offsets, words.ends[~_white_end(words.data, words.starts, words.ends)]]
        if self.cut_marks:
            cuts.append(_marks(words.data))
        cuts = W.distinct(np.concatenate(cuts))
        return cuts[:-1], cuts[1:]

    def _new(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(order, ids, sizes) of pieces in the order in which they were encoded. Pieces that start with white space
        and end without may stand behind each other: the pattern cuts between them, so the library gets many as one
        text, and the bytes of the tokens tell where each ends."""
        last = data[ends - 1]
        chain = W.SPACE[data[starts]] & ~W.SPACE[last] & ~_white_end(data, starts, ends) & (ends - starts < LONG)
        order = np.concatenate([np.flatnonzero(chain), np.flatnonzero(~chain)])
        n = int(chain.sum())
        body = data.tobytes()
        found, sizes = [], []
        for k in range(0, n, AT_ONCE):
            rows = order[k : min(k + AT_ONCE, n)]
            text = b"".join(body[a:b] for a, b in zip(starts[rows].tolist(), ends[rows].tolist())).decode()
            ids = np.array(self.plain([text])[0], dtype=np.int32)
            cuts = np.searchsorted(np.cumsum(self.bytes_of[ids]), np.cumsum(ends[rows] - starts[rows])) + 1
            found.append(ids)
            sizes.append(np.diff(np.concatenate([[0], cuts])))
        for row in order[n:].tolist():
            text = body[starts[row] : ends[row]].decode()
            ids = self.long(text) if ends[row] - starts[row] >= LONG else self.plain([text])[0]
            found.append(np.array(ids, dtype=np.int32))
            sizes.append(np.array([len(ids)]))
        return order, np.concatenate(found), np.concatenate(sizes)

    def encode(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, where each text's ids begin and the last end)."""
        starts, ends = self.pieces(words)
        h = W.range_hashes(W.CODES[words.data], starts, ends, 0)
        self._make_room()
        first, second = self._places(h)
        in_first, in_second = self.keys[0][first] == h, self.keys[1][second] == h
        begins = np.where(in_first, self.begins[0][first], self.begins[1][second]).astype(np.int64)
        sizes = np.where(in_first, self.sizes[0][first], self.sizes[1][second]).astype(np.int64)
        missing = np.flatnonzero(~(in_first | in_second))
        if len(missing):
            uniq, lead, inverse = np.unique(h[missing], return_index=True, return_inverse=True)
            lead = missing[lead]
            order, found, each = self._new(words.data, starts[lead], ends[lead])
            at = np.empty(len(uniq), dtype=np.int64)
            size = np.empty(len(uniq), dtype=np.int64)
            at[order], size[order] = self._remember(uniq[order], found, each), each
            begins[missing], sizes[missing] = at[inverse], size[inverse]
        total = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.store[np.repeat(begins - total[:-1], sizes) + np.arange(total[-1])]
        return ids, total[np.searchsorted(starts, words.offsets)]


class Decoder:
    """The bytes of each token of a vocabulary file, one after the other. The byte characters are those that the
    vocabulary's decoder reads; a special token stands for its own text."""

    _open: dict[str, Decoder] = {}

    def __init__(self, path: str):
        vocabulary, alphabet = Encoder(path), byte_characters()
        parts = [n.encode() if n in vocabulary.special else bytes(alphabet[c] for c in n) for n in vocabulary.names]
        self.flat = np.frombuffer(b"".join(parts), dtype=np.uint8)
        self.table = np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    @classmethod
    def of(cls, path: str) -> Decoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each run ids[bounds[k]:bounds[k + 1]]; bytes that are no UTF-8 become U+FFFD."""
        flat, table = self.flat, self.table
        sizes = table[ids + 1] - table[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        body = flat[np.repeat(table[ids] - total[:-1], sizes) + np.arange(total[-1])].tobytes()
        cuts = total[bounds].tolist()
        return [body[a:b].decode(errors="replace") for a, b in zip(cuts[:-1], cuts[1:])]


def byte_characters() -> dict[str, int]:
    """The character of each byte in byte-level vocabularies: itself if it can be printed, else one from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {**{chr(b): b for b in own}, **{chr(256 + k): b for k, b in enumerate(rest)}}


def _lists(ids: np.ndarray, bounds: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


def _has_long(words: W.Words) -> np.ndarray:
    """Whether a text has a word of LONG bytes or more."""
    hit = np.flatnonzero(words.ends - words.starts >= LONG)
    out = np.zeros(words.n, dtype=bool)
    out[np.searchsorted(words.first, hit, side="right") - 1] = True
    return out


def encode(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> DataFrame:
    """(id, th, token_ids) for every row, and text and other columns as `rest` if asked for: the ids of the whole
    text, without special tokens added, as the tokenizers library gives them. Null and empty texts have no ids; rows
    that repeat an id or a text have a row each; the id is -2**63 where it is null; no rows give no rows.

    Texts with a long unsplit word go another way: its leaves are encoded in tasks of their own and come together per
    document, where only windows around the joins are encoded again."""
    path = path or default_path()
    rows = keyed(docs, id_col, text_col, rest)
    added = [f for f in rows.schema.fields if f.name in ("text", "rest")] if rest else []
    names = ["id", "th", "token_ids", *(f.name for f in added)]
    out = StructType([*StructType.fromDDL("id long, th long, token_ids array<int>").fields, *added])

    def short(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for low, high, words in W.chunks(batch.column(2)):
            part = batch.slice(low, high - low)
            keep = np.flatnonzero(~_has_long(words))
            if not len(keep):
                continue
            if len(keep) == words.n:
                groups = [(part, words)]
            else:
                some = part.take(pa.array(keep))
                groups = [(some.slice(a, b - a), w) for a, b, w in W.chunks(some.column(2))]
            for some, w in groups:
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), _lists(*encoder.encode(w)), *(some.columns[2:] if rest else [])], names=names)

    def leaves(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for k in range(batch.num_rows):
            words = next(W.chunks(batch.column(2).slice(k, 1)))[2]
            if not _has_long(words)[0]:
                continue
            body, parts = words.data.tobytes(), []
            for a, b in zip(*(x.tolist() for x in encoder.pieces(words))):
                piece = body[a:b].decode()
                parts += [(piece, None)] if b - a < LONG else encoder.split_long(piece)
            n = len(parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, batch.column(c)[k].as_py()), pa.int64()) for c in (0, 1)] + [pa.array(np.arange(n)), pa.array([p for p, _ in parts], pa.string()), pa.array([j for _, j in parts], pa.bool_())],
                names=["id", "th", "at", "part", "joins"],
            )

    def encode_parts(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = Encoder.of(path)
        ids = [encoder.plain([t])[0] if j is None else encoder.leaf(t) for t, j in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32())), batch.column(4)], names=["id", "th", "at", "ids", "joins"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, key, parts = Encoder.of(path), None, []

        def whole() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), pa.array([encoder.assemble(parts)], pa.list_(pa.int32()))], names=["id", "th", "token_ids"])

        for batch in batches:
            for i, th, _, ids, joins in zip(*(c.to_pylist() for c in batch.columns)):
                if key != (i, th):
                    if key is not None:
                        yield whole()
                    key, parts = (i, th), []
                parts.append((ids, bool(joins)))
        if key is not None:
            yield whole()

    # in code points, so that no text with a word of LONG bytes is missed; `leaves` looks at the bytes
    long = cut_lineage(rows.where(F.col("text").rlike(r"[^ \t\n\x0B\f\r]{%d}" % (LONG // 4))))
    if long.isEmpty():
        return map_arrow(rows, short, out)
    spread = map_arrow(long.dropDuplicates(["id", "th"]), leaves, "id long, th long, at long, part string, joins boolean").repartition("id", "th", "at")
    encoded = map_arrow(spread, encode_parts, "id long, th long, at long, ids array<int>, joins boolean")
    gathered = encoded.repartition("id", "th").sortWithinPartitions("id", "th", "at").mapInArrow(gather, "id long, th long, token_ids array<int>")
    return map_arrow(rows, short, out).unionByName(long.join(gathered, ["id", "th"]).select(*names))


def tokenised(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents with all their columns, and n_tokens and token_ids after them (with underscores before the name
    if a column has it already)."""
    out = encode(docs, path, rest=True)
    return out.select(*unpacked(docs), F.size("token_ids").cast("long").alias(unused("n_tokens", docs.columns)), F.col("token_ids").alias(unused("token_ids", docs.columns)))


def decode(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """(id, th, token_ids, decoded): the text of each row's ids, special tokens included; null ids give a null text."""
    path = path or default_path()

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        decoder = Decoder.of(path)
        for low in range(0, batch.num_rows, 256):
            part = batch.slice(low, 256)
            lists = part.column(2)
            bounds = np.concatenate([[0], np.cumsum(lists.fill_null([]).value_lengths().to_numpy())])
            texts = decoder.decode(lists.flatten().to_numpy().astype(np.int64), bounds)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string(), mask=lists.is_null().to_numpy(zero_copy_only=False))], names=["id", "th", "token_ids", "decoded"])

    return map_arrow(tokens.select("id", "th", "token_ids"), work, "id long, th long, token_ids array<int>, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decode(encode(documents(spark, sf_dir)))
    decimal = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return out.select(real_id().alias("doc_id"), F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
