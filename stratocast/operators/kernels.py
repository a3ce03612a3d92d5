"""Numpy kernels, vectorised over the series of one Arrow batch: (n_series, n) in, (n_series, h) out."""

from __future__ import annotations

import numpy as np

ALPHAS = np.linspace(0.05, 0.95, 10)


def _ses(y: np.ndarray, alphas: np.ndarray = ALPHAS) -> tuple[np.ndarray, np.ndarray]:
    """Simple exponential smoothing; per series the best alpha of the grid. Returns level and alpha."""
    level = np.repeat(y[:, :1], len(alphas), axis=1)
    sse = np.zeros_like(level)
    for t in range(1, y.shape[1]):
        err = y[:, t : t + 1] - level
        sse += err * err
        level = level + alphas * err
    best = sse.argmin(axis=1)
    rows = np.arange(len(y))
    return level[rows, best], alphas[best]


def _season_index(y: np.ndarray, m: int) -> np.ndarray:
    """(factors, summands) of a season from centred moving averages: factors for positive series, summands for
    others, and neither for less than two seasons."""
    s, n = y.shape
    if m < 2 or n < 2 * m:
        return np.ones((s, max(m, 1))), np.zeros((s, max(m, 1)))
    box = np.ones(m) / m
    if m % 2 == 0:
        box = np.convolve(box, [0.5, 0.5])
    half = len(box) // 2
    trend = np.apply_along_axis(lambda v: np.convolve(v, box, "valid"), 1, y)
    pos = (np.arange(half, half + trend.shape[1])) % m
    middle = y[:, half : half + trend.shape[1]]
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = middle / trend
    times = np.stack([ratio[:, pos == p].mean(axis=1) for p in range(m)], axis=1)
    plus = np.stack([(middle - trend)[:, pos == p].mean(axis=1) for p in range(m)], axis=1)
    plus = plus - plus.mean(axis=1, keepdims=True)
    positive = (y > 0).all(axis=1) & np.isfinite(times).all(axis=1)
    times = times / np.where(times.mean(axis=1, keepdims=True) == 0, 1, times.mean(axis=1, keepdims=True))
    positive = (positive & (times > 0).all(axis=1))[:, None]
    return np.where(positive, times, 1.0), np.where(positive, 0.0, plus)


def theta(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Classical two-line Theta method on the deseasonalised series. The season is multiplied where all values are
    positive, and added elsewhere."""
    s, n = y.shape
    times, plus = _season_index(y, m)
    period = times.shape[1]
    now = np.arange(n) % period
    adj = (y - plus[:, now]) / times[:, now]
    level, alpha = _ses(adj)
    t = np.arange(n) - (n - 1) / 2
    slope = (adj * t).sum(axis=1) / (t * t).sum() if n > 1 else np.zeros(s)
    steps = np.arange(h)
    drift = 0.5 * slope[:, None] * (steps + ((1 - (1 - alpha) ** n) / alpha)[:, None])
    ahead = (n + steps) % period
    return (level[:, None] + drift) * times[:, ahead] + plus[:, ahead]


def croston_sba(y: np.ndarray, h: int, m: int, alpha: float = 0.1) -> np.ndarray:
    """Demand size over demand interval, both smoothed at non-zero periods, with the bias factor."""
    s, n = y.shape
    size = np.zeros(s)
    gap = np.ones(s)
    since = np.ones(s)
    seen = np.zeros(s, bool)
    for t in range(n):
        hit = y[:, t] != 0
        first = hit & ~seen
        later = hit & seen
        size = np.where(first, y[:, t], np.where(later, size + alpha * (y[:, t] - size), size))
        gap = np.where(first, since, np.where(later, gap + alpha * (since - gap), gap))
        since = np.where(hit, 1.0, since + 1)
        seen |= hit
    return np.repeat(((1 - alpha / 2) * size / gap)[:, None], h, axis=1)


def _buckets(y: np.ndarray, k: int) -> np.ndarray:
    """Sums of k periods, counted back from the last one; the incomplete first bucket is left out."""
    n = y.shape[1] // k * k
    return y[:, y.shape[1] - n :].reshape(len(y), -1, k).sum(axis=2)


def _mean_gap(y: np.ndarray) -> np.ndarray:
    """Rounded mean distance between non-zero periods, at least 1."""
    hits = (y != 0).sum(axis=1)
    first = (y != 0).argmax(axis=1)
    last = y.shape[1] - 1 - (y[:, ::-1] != 0).argmax(axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gap = np.where(hits > 1, (last - first) / np.maximum(hits - 1, 1), 1.0)
    return np.clip(np.rint(gap), 1, max(y.shape[1] // 2, 1)).astype(int)


def adida(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Smooth at the mean demand interval, then spread evenly."""
    gaps = _mean_gap(y)
    out = np.zeros(len(y))
    for k in np.unique(gaps):
        rows = gaps == k
        out[rows] = _ses(_buckets(y[rows], k))[0] / k
    return np.repeat(out[:, None], h, axis=1)


def imapa(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Mean of the smoothed forecasts at every aggregation up to the mean demand interval."""
    gaps = _mean_gap(y)
    out = np.zeros(len(y))
    for k in np.unique(gaps):
        rows = gaps == k
        out[rows] = np.mean([_ses(_buckets(y[rows], j))[0] / j for j in range(1, k + 1)], axis=0)
    return np.repeat(out[:, None], h, axis=1)
