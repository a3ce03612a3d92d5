"""Words and word-window hashes of many texts at once, as numpy arrays over one UTF-8 buffer.

Words are runs of bytes other than 0x20 and 0x09-0x0D, so every position is the same in bytes and in text.
All hashes are 64-bit polynomial hashes over random byte codes with a final mix: equal sequences are equal,
different ones differ but for a chance of about 2**-60.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer text is worked on alone.
CHUNK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
CODES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = [int(x) | 5 for x in _rng.integers(1 << 40, 1 << 62, 4, dtype=np.int64)]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 ... base**(n - 1) modulo 2**64, or of the base's inverse."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        base = pow(_BASES[which], -1, 1 << 64) if inverse else _BASES[which]
        size = max(n, CHUNK_BYTES + 1)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if size <= 2 * CHUNK_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in order; quick where they are nearly sorted, as places are."""
    values = np.sort(values, kind="stable")
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
    """The hash of values[starts[i]:ends[i]] for every i."""
    return Ranges(values, which)(starts, ends)


class Ranges:
    """`range_hashes` of any ranges of the same values, whose sums are taken once."""

    def __init__(self, values: np.ndarray, which: int):
        self.sums = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * powers(which, len(values)), out=self.sums[1:])
        self.back = powers(which, len(values) + 1, inverse=True)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts])


@dataclass
class Words:
    """The words of some texts. `first[d]:first[d + 1]` are the words of text d."""

    data: np.ndarray  # bytes of all texts
    offsets: np.ndarray  # text d is data[offsets[d]:offsets[d + 1]]
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def n(self) -> int:
        return len(self.first) - 1

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, which: int = 0) -> np.ndarray:
        """One hash for each word."""
        return range_hashes(CODES[self.data], self.starts, self.ends, which)

    def joined(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words with one space after each: bytes, and where each word starts and ends there."""
        lengths = self.ends - self.starts
        keep = np.zeros(len(self.data) + 1, dtype=np.int8)
        keep[self.starts] += 1
        keep[self.ends] -= 1
        inside = np.cumsum(keep[:-1]).astype(bool)
        ends = np.cumsum(lengths + 1) - 1
        out = np.full(int(ends[-1]) + 1 if len(ends) else 0, 0x20, dtype=np.uint8)
        mask = np.ones(len(out), dtype=bool)
        mask[ends] = False
        out[mask] = self.data[inside]
        return out, ends - lengths, ends


def find_words(data: np.ndarray, offsets: np.ndarray, space: Callable[[np.ndarray], np.ndarray] | None = None) -> Words:
    """The words of the texts data[offsets[d]:offsets[d + 1]]. `space` says which bytes are between words."""
    black = np.empty(len(data) + 1, dtype=bool)
    black[-1] = False
    np.logical_not(space(data) if space else SPACE[data], out=black[:-1])
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start = black[:-1].copy()
    start[1:] &= ~black[:-2]
    start[edges] = black[edges]
    end = black[:-1] & ~black[1:]
    end[edges - 1] = black[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(texts: pa.Array | pa.ChunkedArray, space: Callable[[np.ndarray], np.ndarray] | None = None) -> Iterator[tuple[int, int, Words]]:
    """(from, to, words) for runs of texts of about CHUNK_BYTES; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + CHUNK_BYTES, side="right")) - 1)
        high = min(high, len(texts))
        yield low, high, find_words(body[at[low] : at[high]], at[low : high + 1] - at[low], space)
        low = high


def windows(hashes: np.ndarray, length: int, which: int = 1) -> np.ndarray:
    """The hash of each run of `length` words, by its first word; runs may cross texts, see `inside`."""
    n = max(len(hashes) - length + 1, 0)
    at = np.arange(n)
    return range_hashes(hashes, at, at + length, which)


def inside(words: Words, length: int) -> np.ndarray:
    """Whether the run of `length` words at each word that has a window stays in its text."""
    n = max(int(words.first[-1]) - length + 1, 0)
    last = np.repeat(words.first[1:], words.counts)[:n]
    return np.arange(n) + length <= last


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each `width` consecutive values."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(words: Words, length: int, seed: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, anchors): for each window of `length` words that stays in its text its first word, and the
    first word of the run of `seed` words in it whose hash is smallest (of equals the first). Equal windows have
    their anchor at the same place."""
    grams = windows(hashes, seed)
    bits = max(1, int(len(grams)).bit_length())
    packed = (grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64)
    low = sliding_min(packed, length - seed + 1) if len(grams) >= length - seed + 1 else packed[:0]
    at = np.flatnonzero(inside(words, length))
    return at, (low[at] & np.uint64((1 << bits) - 1)).astype(np.int64)
