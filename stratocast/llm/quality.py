"""Quality rules, line first: lines are judged on their own, and a document goes that loses too much by them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratocast.llm import words as W
from stratocast.llm.common import documents, map_arrow, packed, text_of, unpacked

#: Fixed values.
SYMBOLS = b"#*$%&|<>"
SEPARATORS = ("|", ">", "<", "*", "-", "/", "·", "»", "›", "•", "→")
#: Lines that are short or largely made up of these are boilerplate (lower case, whole words or their plural).
PHRASES = (
    "javascript", "cookie", "lorem ipsum", "privacy policy", "terms of use", "terms of service", "all rights reserved",
    "sign in", "log in", "subscribe", "click here", "read more", "share this",
)
#: What ends a sentence, and what may close after it.
TERMINALS = (".", "!", "?", "\"", "'", ")", "]", ":", ";", "…", "”", "’", "»", "。", "！", "？")


@dataclass(frozen=True)
class Rules:
    """Limits of the line rules and of the document's verdict."""

    max_symbols_per_word: float = 0.25
    max_separator_share: float = 0.2
    max_upper_share: float = 0.6
    min_upper_letters: int = 12
    max_lost_share: float = 0.5
    short_line: int = 20
    max_phrase_share: float = 0.2


def _member(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


_SYMBOL, _PUNCT = _member(SYMBOLS), _member(bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum()))
_UPPER, _LOWER = _member(bytes(range(65, 91))), _member(bytes(range(97, 123)))
_LETTER = _member(bytes([*range(48, 58), *range(65, 91), *range(97, 123)]))
#: First bytes of characters beyond ASCII that are letters of words with spaces between them; U+0080 to U+00BF and what
#: comes from U+2000 on, punctuation and scripts without spaces, bound a word.
_LETTER_LEAD = _member(bytes(range(0xC3, 0xE2)))
_TO_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))


def _sums(mask: np.ndarray) -> np.ndarray:
    out = np.zeros(len(mask) + 1, dtype=np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def lines_of(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): the \\n-split lines of each text; lines first[d]:first[d + 1] are those of text d."""
    breaks = np.flatnonzero(words.data == 10)
    starts = np.sort(np.concatenate([words.offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, words.offsets[1:]]), kind="stable")
    each = np.searchsorted(breaks, words.offsets[1:]) - np.searchsorted(breaks, words.offsets[:-1]) + 1
    return starts, ends, np.concatenate([[0], np.cumsum(each)])


def _ends_with(data: np.ndarray, ends: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
    out = np.zeros(len(ends), dtype=bool)
    for mark in marks:
        code = mark.encode()
        hit = ends >= len(code)
        for k, byte in enumerate(code):
            hit = hit & (data[np.maximum(ends - len(code) + k, 0)] == byte)
        out |= hit
    return out


def _separator_words(words: W.Words) -> np.ndarray:
    out = np.zeros(len(words.starts), dtype=bool)
    size = words.ends - words.starts
    for mark in SEPARATORS:
        code = mark.encode()
        hit = size == len(code)
        for k, byte in enumerate(code):
            hit[hit] = words.data[words.starts[hit] + k] == byte
        out |= hit
    return out


def _phrase_words(words: W.Words, line_starts: np.ndarray) -> np.ndarray:
    """Whether each word belongs to a phrase that stands between word bounds in one line: no letter or digit is next
    to it, but for the s of a plural."""
    out = np.zeros(len(words.starts), dtype=bool)
    flat = words.data.tobytes().translate(_TO_LOWER)

    def letter_before(k: int, low: int) -> bool:
        at = k - 1
        while at > low and flat[at] & 0xC0 == 0x80:
            at -= 1
        return k > low and bool(_LETTER[flat[at]] or _LETTER_LEAD[flat[at]])

    def letter_at(k: int, stop: int) -> bool:
        return k < stop and bool(_LETTER[flat[k]] or _LETTER_LEAD[flat[k]])

    for phrase in PHRASES:
        code, k = phrase.encode(), 0
        while (k := flat.find(code, k)) >= 0:
            end = k + len(code)
            line = int(np.searchsorted(line_starts, k, side="right"))
            # texts stand one after the other without a gap, and each starts a line
            stop = int(line_starts[line]) if line < len(line_starts) else len(flat)
            close = end + 1 if flat[end : end + 1] == b"s" and end < stop else end
            if end <= stop and not letter_before(k, int(line_starts[line - 1])) and not letter_at(close, stop):
                out[np.searchsorted(words.ends, k, side="right") : np.searchsorted(words.starts, end)] = True
            k = end
    return out


@dataclass
class Judged:
    """Base counts of each text, and its lines with the verdict on each."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    line_starts: np.ndarray
    line_ends: np.ndarray
    line_first: np.ndarray
    line_kept: np.ndarray
    lost_words: np.ndarray


def judge(words: W.Words, rules: Rules) -> Judged:
    data, n = words.data, words.n
    hashes = words.hashes()
    docs = words.doc_of()
    starts, ends, first = lines_of(words)
    line_doc = np.repeat(np.arange(n), np.diff(first))
    w_from, w_to = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    n_line = w_to - w_from
    full = n_line > 0

    # base counts
    begins = _sums((data & 0xC0) != 0x80)
    chars = begins[words.ends] - begins[words.starts]
    per_word = _sums(chars)
    symbols = _sums(_SYMBOL[data])

    # equal lines of a text, compared by hash and length of the whole line
    body = W.range_hashes(W.CODES[data], starts, ends, 2)
    mark = W.mix(body ^ W.mix((line_doc.astype(np.uint64) << np.uint64(32)) + (ends - starts).astype(np.uint64)))
    at = np.flatnonzero(full)
    _, lead = np.unique(mark[at], return_index=True)
    repeated = full.copy()
    repeated[at[lead]] = False

    # words in 5-word windows that a text has twice
    grams = W.windows(hashes, 5)
    ok = np.flatnonzero(W.inside(words, 5))
    own = W.mix(grams[ok] ^ W.mix(docs[ok].astype(np.uint64) + np.uint64(1)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(ok), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(hashes) + 1, dtype=np.int64)
    cover[ok[twice]] += 1
    cover[ok[twice] + 5] -= 1
    covered = _sums(np.cumsum(cover[:-1]) > 0)

    # line rules
    finished = _sums(_ends_with(data, words.ends, TERMINALS))
    unfinished = full & (finished[w_to] == finished[w_from])
    symbol_share = (symbols[ends] - symbols[starts]) > rules.max_symbols_per_word * n_line
    separators = _sums(_separator_words(words))
    navigation = (separators[w_to] - separators[w_from]) > rules.max_separator_share * n_line
    upper, lower = _sums(_UPPER[data]), _sums(_LOWER[data])
    up, low = upper[ends] - upper[starts], lower[ends] - lower[starts]
    shouting = (up >= rules.min_upper_letters) & (up > rules.max_upper_share * (up + low))
    phrase = _sums(_phrase_words(words, starts))
    phrases = phrase[w_to] - phrase[w_from]
    boilerplate = (phrases > 0) & ((n_line <= rules.short_line) | (phrases > rules.max_phrase_share * n_line))
    kept = ~full | ~(unfinished | symbol_share | navigation | shouting | boilerplate | repeated)

    def per_text(sums: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return np.diff(sums[bounds])

    return Judged(
        n_words=words.counts, word_chars=per_text(per_word, words.first), n_symbols=per_text(symbols, words.offsets),
        n_dup_lines=per_text(_sums(repeated), first), n_repeat_words=per_text(covered, words.first),
        line_starts=starts, line_ends=ends, line_first=first, line_kept=kept,
        lost_words=per_text(_sums(np.where(kept, 0, n_line)), first),
    )


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_words long, cleaned string"


def quality(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", clean: bool = True) -> DataFrame:
    """One row per document: counts, verdict, and the text of the lines that pass.

    A line without words always passes. A line fails in which no word ends with sentence punctuation, that is rich in symbols or
    separators, mostly capitals, holds a boilerplate phrase and is short or has a large share of its words in such phrases, or
    equals an earlier line of the document. A document
    fails with fewer than 10 words, with over 20 % of its words in repeated 5-word windows, or when lines with more
    than `rules.max_lost_share` of its words fail. Null and empty texts have no words and fail; ids may be null or
    repeat, every row is judged alone; other columns are not read. `clean=False` leaves `cleaned` null.
    """

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids = batch.column(0)
        for low, high, words in W.chunks(batch.column(1)):
            j = judge(words, rules)
            base = (j.n_words < 10) | (100 * j.n_repeat_words > 20 * j.n_words)
            kept = ~base & (j.lost_words <= rules.max_lost_share * j.n_words)
            texts: list[str | None] = [None] * words.n
            if clean:
                body = words.data.tobytes()
                for d in range(words.n):
                    rows = range(j.line_first[d], j.line_first[d + 1])
                    texts[d] = b"\n".join(body[j.line_starts[r] : j.line_ends[r]] for r in rows if j.line_kept[r]).decode()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, high - low), *(pa.array(x, pa.int64()) for x in (j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words)), pa.array(base), pa.array(kept), pa.array(j.lost_words, pa.int64()), pa.array(texts, pa.string())],
                names=[x.split(" ")[0] for x in SCHEMA.split(", ")],
            )

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")), work, SCHEMA)


def quality_stage(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, without their failed lines; n_chars follows the text, other columns stay.

    A null text fails. The stage needs no shuffle: each row carries its other columns through the judgement.
    """
    rows = docs.select(packed(docs).alias("rest"), text_of().alias("text"))

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for low, high, words in W.chunks(batch.column(1)):
            j = judge(words, rules)
            keep = np.flatnonzero((j.n_words >= 10) & (100 * j.n_repeat_words <= 20 * j.n_words) & (j.lost_words <= rules.max_lost_share * j.n_words))
            body = words.data.tobytes()
            texts = [b"\n".join(body[j.line_starts[r] : j.line_ends[r]] for r in range(j.line_first[d], j.line_first[d + 1]) if j.line_kept[r]).decode() for d in keep]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low).take(pa.array(keep)), pa.array(texts, pa.string())], names=["rest", "text"])

    return map_arrow(rows, work, rows.schema).select(*unpacked(docs))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), clean=False).drop("lost_words", "cleaned")
