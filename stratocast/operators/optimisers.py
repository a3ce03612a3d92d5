"""Weight search for one experiment: small numpy functions on (n_dates, n_levels) matrices."""

from __future__ import annotations

import zlib

import numpy as np

#: Losses whose relative difference is below this are ties: far above the noise of sums and of exact decimals.
TIE = 1e-9

METHODS = ("ensemble_selection", "optimize_nnls", "differential_evolution")


def normalise(w: np.ndarray) -> np.ndarray:
    """Weights that sum to 1; a vector without any weight means equal weights."""
    total = w.sum()
    return w / total if total > 0 else np.full(len(w), 1 / len(w))


def ensemble_selection(y: np.ndarray, preds: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Greedy with replacement: each round adds the level that lowers the error of the running mean most.
    The first level wins ties (see TIE)."""
    total = np.zeros(len(y))
    picks = np.zeros(preds.shape[1])
    for i in range(1, rounds + 1):
        loss = np.abs(y[:, None] - (total[:, None] + preds) / i).mean(axis=0)
        best = int(np.argmax(loss <= loss.min() * (1 + TIE)))
        total += preds[:, best]
        picks[best] += 1
    return normalise(picks)


def clipped_least_squares(y: np.ndarray, preds: np.ndarray) -> np.ndarray:
    """Minimum-norm least squares; negative weights are set to 0 afterwards, then normalised."""
    w = np.linalg.lstsq(preds, y, rcond=np.finfo(np.float32).eps * max(preds.shape))[0]
    return normalise(np.maximum(w, 0))


def differential_evolution(
    y: np.ndarray, preds: np.ndarray, seed: int = 42, generations: int = 1000, pop_factor: int = 15, tol: float = 0.01
) -> np.ndarray:
    """best/1/bin on weights in [0, 1], normalised inside the loss, with dithered mutation."""
    rng = np.random.default_rng(seed)
    n = preds.shape[1]
    size = max(5, pop_factor * n)
    cells = (rng.permuted(np.tile(np.arange(size), (n, 1)), axis=1).T + rng.random((size, n))) / size

    def loss(pop):
        total = pop.sum(axis=1, keepdims=True)
        w = np.divide(pop, total, out=np.full_like(pop, 1 / n), where=total > 0)
        return np.abs(y[:, None] - preds @ w.T).mean(axis=0)

    pop, score = cells, loss(cells)
    for _ in range(generations):
        # two donors that differ from each other and from the row they change
        a = (np.arange(size) + rng.integers(1, size, size)) % size
        b = (np.arange(size) + rng.integers(1, size - 1, size)) % size
        b = np.where((b - np.arange(size)) % size >= (a - np.arange(size)) % size, (b + 1) % size, b)
        trial = pop[score.argmin()] + rng.uniform(0.5, 1.0) * (pop[a] - pop[b])
        outside = (trial < 0) | (trial > 1)
        trial = np.where(outside, rng.random((size, n)), trial)
        cross = rng.random((size, n)) < 0.7
        cross[np.arange(size), rng.integers(0, n, size)] = True
        trial = np.where(cross, trial, pop)
        new = loss(trial)
        better = new <= score
        pop = np.where(better[:, None], trial, pop)
        score = np.where(better, new, score)
        if score.std() <= tol * abs(score.mean()):
            break
    return normalise(pop[score.argmin()])


def fit_present(method: str, y: np.ndarray, preds: np.ndarray, rounds: int, key: str) -> np.ndarray:
    """Weights where predictions may be missing: levels that lack any get none. If every level lacks some, the dates
    that all levels have decide, and without such dates all weights are equal."""
    here = ~np.isnan(preds)
    levels, dates = here.all(axis=0), here.all(axis=1)
    if levels.any():
        out = np.zeros(preds.shape[1])
        out[levels] = fit(method, y, preds[:, levels], rounds, key)
        return out
    if dates.any():
        return fit(method, y[dates], preds[dates], rounds, key)
    return normalise(np.zeros(preds.shape[1]))


def fit(method: str, y: np.ndarray, preds: np.ndarray, rounds: int, key: str) -> np.ndarray:
    if method == "ensemble_selection":
        return ensemble_selection(y, preds, rounds)
    if method == "optimize_nnls":
        return clipped_least_squares(y, preds)
    if method == "differential_evolution":
        return differential_evolution(y, preds, seed=42 + zlib.crc32(key.encode()) % 100_000)
    raise ValueError(f"unknown optimiser {method!r}; use one of {METHODS}")
