"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np

from stratocast.llm import words as W
from stratocast.llm.xxh import xxh64

SEED = 42

_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[65:91] += 32


def shingles_of(words: W.Words, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every shingle in lower case, and how many each text has; a shorter text is one shingle."""
    text, starts, ends = words.joined()
    counts = words.counts
    runs = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
    bound = np.concatenate([[0], np.cumsum(runs)])
    first = np.repeat(words.first[:-1] - bound[:-1], runs) + np.arange(bound[-1])
    last = np.minimum(first + shingle, np.repeat(words.first[1:], runs)) - 1
    return xxh64(_TO_LOWER[text], starts[first], ends[last], SEED), runs
