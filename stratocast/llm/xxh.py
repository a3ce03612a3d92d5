"""XXH64 of many byte ranges of one buffer at once."""

from __future__ import annotations

import numpy as np

#: The five primes of the published hash (fixed values).
P1, P2, P3, P4, P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _round(acc: np.ndarray | np.uint64, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * P2, 31) * P1


def _same_length(wide: np.ndarray, half: np.ndarray, one: np.ndarray, at: np.ndarray, length: int, seed: np.uint64) -> np.ndarray:
    done = 0
    if length >= 32:
        acc = [np.full(len(at), x, dtype=np.uint64) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
        while length - done >= 32:
            acc = [_round(a, wide[at + done + 8 * k]) for k, a in enumerate(acc)]
            done += 32
        h = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
        for a in acc:
            h = (h ^ _round(np.uint64(0), a)) * P1 + P4
    else:
        h = np.full(len(at), seed + P5, dtype=np.uint64)
    h += np.uint64(length)
    while length - done >= 8:
        h = _turn(h ^ _round(np.uint64(0), wide[at + done]), 27) * P1 + P4
        done += 8
    if length - done >= 4:
        h = _turn(h ^ (half[at + done].astype(np.uint64) * P1), 23) * P2 + P3
        done += 4
    while done < length:
        h = _turn(h ^ (one[at + done].astype(np.uint64) * P5), 11) * P1
        done += 1
    h = (h ^ (h >> np.uint64(33))) * P2
    h = (h ^ (h >> np.uint64(29))) * P3
    return h ^ (h >> np.uint64(32))


def xxh64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """The unsigned hash of data[starts[i]:ends[i]] for every i."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    wide = np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))
    half = np.ndarray(len(data) + 1, dtype="<u4", buffer=padded, strides=(1,))
    lengths = ends - starts
    order = np.argsort(lengths, kind="stable")
    sizes, low = np.unique(lengths[order], return_index=True)
    out = np.empty(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for size, a, b in zip(sizes, low, [*low[1:], len(order)]):
            rows = order[a:b]
            out[rows] = _same_length(wide, half, padded, starts[rows], int(size), np.uint64(seed))
    return out
