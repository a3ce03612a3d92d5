"""Seasonal ARIMA and exponential smoothing with multiplicative parts, fitted by nonlinear least squares.

Everything is vectorised over the series of a batch: (n_series, n) in. A candidate is one order or form; its fit gives
every series a score (corrected Akaike criterion) and a forecast, so a search is the minimum over candidates, whether
they meet in one batch or as rows of a table.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

#: Steps of the least-squares search, and the step of its numeric derivatives.
STEPS, DELTA = 25, 1e-5


def least_squares(residuals: Callable[[np.ndarray, np.ndarray], np.ndarray], x: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Levenberg-Marquardt for many small problems at once: parameters (s, k) and their sums of squares (s).

    `residuals` maps parameters (copies, r, k) of the problems `rows` (r) to (copies, r, n), so all derivatives of a step
    are one call. Every problem has its own damping, keeps its best parameters and rests once it gains no more."""
    s, k = x.shape
    x = x.copy()
    live = np.arange(s)
    # rows are laid out one by one and multiplied one by one: a problem's result does not depend on its neighbours
    flat = np.ascontiguousarray
    first = flat(residuals(x[None], live)[0])
    sse = (first * first).sum(axis=1)
    if k == 0:
        return x, sse
    damping = np.full(s, 1e-2)
    nudge = np.concatenate([np.zeros((1, 1, k)), DELTA * np.eye(k)[:, None, :]])
    for _ in range(steps):
        r = residuals(x[live][None] + nudge, live)
        jac = flat(np.moveaxis((r[1:] - r[:1]) / DELTA, 1, 0))
        gram = jac @ flat(jac.transpose(0, 2, 1))
        slope = (jac @ flat(r[0])[:, :, None])[:, :, 0]
        scale = np.einsum("saa->sa", gram) + 1e-12 * (1 + sse[live][:, None])
        gram = gram + (damping[live][:, None] * scale)[:, :, None] * np.eye(k)
        with np.errstate(all="ignore"):
            move = -np.linalg.solve(gram, slope[:, :, None])[:, :, 0]
        move = np.clip(np.where(np.isfinite(move), move, 0.0), -2, 2)
        new = flat(residuals((x[live] + move)[None], live)[0])
        with np.errstate(over="ignore"):
            loss = (new * new).sum(axis=1)
        better = loss < sse[live]
        rests = np.where(better, sse[live] - loss <= 1e-7 * sse[live], damping[live] > 1e3)
        good = live[better]
        x[good] += move[better]
        sse[good] = loss[better]
        damping[live] = np.where(better, damping[live] / 8, damping[live] * 8)
        live = live[~rests]
        if not len(live):
            break
    return x, sse


def aicc(sse: np.ndarray, n: int, k: int) -> np.ndarray:
    """Corrected Akaike criterion of a fit with k parameters, the variance among them. It is rounded, so that noise does
    not decide: of equal scores the first candidate wins."""
    if n - k - 1 <= 0:
        return np.full(len(sse), np.inf)
    return np.round(n * np.log(np.maximum(sse, 1e-300) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1), 6)


def unit(y: np.ndarray) -> np.ndarray:
    """The size of each series, by which it is divided before a fit."""
    size = np.abs(y).mean(axis=1, keepdims=True)
    return np.where(size > 0, size, 1.0)


# ---- seasonal ARIMA ----

#: Orders (p, q) and seasonal orders (P, Q) that are tried, with at most MOST coefficients in all.
P, Q, SEASONAL_P, SEASONAL_Q, MOST = 2, 2, 1, 1, 4
#: Values that a differenced series needs for a fit, share of the season in the variance from which it is differenced
#: away, and the 5 % point of the KPSS statistic around a level.
LEAST, STRONG, KPSS = 12, 0.64, 0.463

Order = tuple[int, int, int, int, bool]


def _bounded(r: np.ndarray) -> np.ndarray:
    """Coefficients of a stationary autoregression of order 0, 1 or 2 from any numbers, by partial correlations."""
    part = np.tanh(r)
    if r.shape[-1] < 2:
        return part
    return np.stack([part[..., 0] * (1 - part[..., 1]), part[..., 1]], axis=-1)


def _product(low: np.ndarray, high: np.ndarray, m: int) -> dict[int, np.ndarray]:
    """(1 - low(B)) (1 - high(B**m)) = 1 - sum of out[lag] B**lag."""
    out: dict[int, np.ndarray] = {}
    for i in range(low.shape[-1]):
        out[i + 1] = out.get(i + 1, 0.0) + low[..., i]
    for j in range(high.shape[-1]):
        lag = (j + 1) * m
        out[lag] = out.get(lag, 0.0) + high[..., j]
        for i in range(low.shape[-1]):
            out[lag + i + 1] = out.get(lag + i + 1, 0.0) - low[..., i] * high[..., j]
    return out


def _split(x: np.ndarray, order: Order, m: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray], np.ndarray]:
    """The autoregression, the moving average (as the same kind of polynomial) and the mean from the parameters."""
    p, q, sp, sq, constant = order
    cuts = np.cumsum([p, q, sp, sq])
    ar, ma, sar, sma = (_bounded(x[..., a:b]) for a, b in zip([0, *cuts[:-1]], cuts))
    mean = x[..., -1] if constant else np.zeros(x.shape[:-1])
    return _product(ar, sar, m), _product(-ma, -sma, m), mean


def _shocks(w: np.ndarray, ar: dict, ma: dict, mean: np.ndarray) -> np.ndarray:
    """One-step errors (..., n) of w (s, n); what lies before the series counts as its mean, with no errors."""
    z = w - mean[..., None]
    u = z.copy()
    for lag, c in ar.items():
        if lag < z.shape[-1]:
            u[..., lag:] -= c[..., None] * z[..., :-lag]
    if not ma:
        return u
    # e(t) = u(t) + sum of ma[lag] e(t - lag), as 1 + theta(B) is written 1 - sum of ma[lag] B**lag
    e = np.moveaxis(u, -1, 0).copy()
    lags = sorted(ma)
    for t in range(min(lags), len(e)):
        for lag in lags:
            if lag > t:
                break
            e[t] += ma[lag] * e[t - lag]
    return np.moveaxis(e, 0, -1)


def fit_arma(w: np.ndarray, m: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """Parameters (s, k) and sums of squares of a stationary seasonal ARMA by conditional least squares."""
    k = sum(order[:4]) + order[4]
    start = np.full((len(w), k), 0.1)
    if order[4]:
        start[:, -1] = w.mean(axis=1)

    def residuals(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        return _shocks(w[rows], *_split(x, order, m))

    return least_squares(residuals, start)


def coefficients(x: np.ndarray, order: Order) -> dict[str, np.ndarray]:
    """The parameters of a fit by name."""
    p, q, sp, sq, constant = order
    cuts = np.cumsum([p, q, sp, sq])
    ar, ma, sar, sma = (_bounded(x[..., a:b]) for a, b in zip([0, *cuts[:-1]], cuts))
    return {"ar": ar, "ma": ma, "seasonal_ar": sar, "seasonal_ma": sma, "mean": x[..., -1] if constant else np.zeros(x.shape[:-1])}


def arma_forecast(w: np.ndarray, h: int, m: int, order: Order) -> tuple[np.ndarray, np.ndarray]:
    """(score, forecast) of one order for every series."""
    x, sse = fit_arma(w, m, order)
    ar, ma, mean = _split(x, order, m)
    n = w.shape[1]
    z = np.concatenate([w - mean[:, None], np.zeros((len(w), h))], axis=1)
    e = np.concatenate([_shocks(w, ar, ma, mean), np.zeros((len(w), h))], axis=1)
    for t in range(n, n + h):
        for lag, c in ar.items():
            if lag <= t:
                z[:, t] += c * z[:, t - lag]
        for lag, c in ma.items():
            if lag <= t:
                z[:, t] -= c * e[:, t - lag]
    # an order whose lags the series does not hold has not been tried on anything
    score = aicc(sse, n, sum(order[:4]) + order[4] + 1) if max([0, *ar, *ma]) < n else np.full(len(w), np.inf)
    return score, z[:, n:] + mean[:, None]


def season_strength(y: np.ndarray, m: int) -> np.ndarray:
    """Share of the season in what a centred moving average leaves, 0 to 1; 0 for less than two seasons."""
    s, n = y.shape
    if m < 2 or n < 2 * m:
        return np.zeros(s)
    box = np.ones(m) / m if m % 2 else np.convolve(np.ones(m) / m, [0.5, 0.5])
    half = len(box) // 2
    total = np.cumsum(np.concatenate([np.zeros((s, 1)), y], axis=1), axis=1)
    mean = (total[:, m:] - total[:, :-m]) / m
    trend = mean if m % 2 else (mean[:, 1:] + mean[:, :-1]) / 2
    rest = y[:, half : n - half] - trend
    at = np.arange(half, n - half) % m
    if rest.shape[1] < m:
        return np.zeros(s)
    season = np.stack([rest[:, at == k].mean(axis=1) for k in range(m)], axis=1)[:, at]
    left, whole = (rest - season).var(axis=1), rest.var(axis=1)
    noise = 1e-18 * (y * y).mean(axis=1)
    return np.where(whole > noise, np.clip(1 - left / np.maximum(whole, 1e-300), 0, 1), 0.0)


def kpss(y: np.ndarray) -> np.ndarray:
    """KPSS statistic around a level: large where a series wanders. 0 for constant series."""
    n = y.shape[1]
    e = y - y.mean(axis=1, keepdims=True)
    lags = int(4 * (n / 100) ** 0.25)
    spread = (e * e).sum(axis=1) / n
    for lag in range(1, min(lags, n - 1) + 1):
        spread = spread + 2 * (1 - lag / (lags + 1)) * (e[:, lag:] * e[:, :-lag]).sum(axis=1) / n
    path = (np.cumsum(e, axis=1) ** 2).sum(axis=1) / (n * n)
    noise = 1e-18 * (y * y).mean(axis=1)
    return np.where(spread > noise, path / np.maximum(spread, 1e-300), 0.0)


def differences(y: np.ndarray, m: int) -> np.ndarray:
    """(s, 2): how often each series is differenced, plainly (up to twice) and by seasons (up to once)."""
    s, n = y.shape
    out = np.zeros((s, 2), dtype=int)
    if n >= 2 * m and n - m >= LEAST:
        out[:, 1] = season_strength(y, m) >= STRONG
    for seasonal in (0, 1):
        rows = np.flatnonzero(out[:, 1] == seasonal)
        w = y[rows, m:] - y[rows, :-m] if seasonal else y[rows]
        for _ in range(2):
            if not len(rows) or w.shape[1] - 1 < LEAST:
                break
            wanders = kpss(w) > KPSS
            rows, w = rows[wanders], np.diff(w[wanders], axis=1)
            out[rows, 0] += 1
    return out


def arma_orders(m: int, n: int, constant: bool) -> list[Order]:
    """The candidates for a differenced series of n values: all orders up to the limits that leave enough values."""
    seasonal = m > 1 and n >= 2 * m
    return [
        (p, q, sp, sq, constant)
        for p, q, sp, sq in product(range(P + 1), range(Q + 1), range(SEASONAL_P * seasonal + 1), range(SEASONAL_Q * seasonal + 1))
        if p + q + sp + sq <= MOST
    ]


def arima_search(y: np.ndarray, h: int, m: int, orders: Callable[[int, int, bool], list[Order]] = arma_orders) -> tuple[np.ndarray, np.ndarray]:
    """(score, forecast) of the best of `orders` for every series: differencing first, by tests, then the order with the
    lowest score, with a mean unless the series is differenced twice. Too short series keep their last value."""
    s, n = y.shape
    score, out = np.full(s, np.inf), np.repeat(y[:, -1:], h, axis=1).astype(float)
    if n < LEAST:
        return score, out
    size = unit(y)
    scaled = y / size
    how = differences(scaled, m)
    for d, sd in np.unique(how, axis=0).tolist():
        rows = np.flatnonzero((how == (d, sd)).all(axis=1))
        steps = [scaled[rows]]
        if sd:
            steps.append(steps[-1][:, m:] - steps[-1][:, :-m])
        for _ in range(d):
            steps.append(np.diff(steps[-1], axis=1))
        w = steps.pop()
        best = np.full(len(rows), np.inf)
        ahead = np.repeat(w.mean(axis=1, keepdims=True) if d + sd < 2 else np.zeros((len(rows), 1)), h, axis=1)
        for order in orders(m, w.shape[1], d + sd < 2):
            value, path = arma_forecast(w, h, m, order)
            wins = (value < best) & np.isfinite(path).all(axis=1)
            best, ahead = np.where(wins, value, best), np.where(wins[:, None], path, ahead)
        for k in range(d):
            ahead = steps[len(steps) - 1 - k][:, -1:] + np.cumsum(ahead, axis=1)
        if sd:
            path = np.concatenate([scaled[rows], np.zeros((len(rows), h))], axis=1)
            for t in range(h):
                path[:, n + t] = ahead[:, t] + path[:, n + t - m]
            ahead = path[:, n:]
        score[rows], out[rows] = best, ahead * size[rows]
    return score, out


def auto_arima(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Seasonal ARIMA with orders chosen per series."""
    return arima_search(y, h, m)[1]


# ---- exponential smoothing ----

#: (multiplicative error, trend "" / "A" / "Ad", season "" / "A" / "M") of the forms that are tried. Additive errors with a
#: multiplicative season are left out, as their variance has no bound.
Form = tuple[bool, str, str]
FORMS: list[Form] = [(error, trend, season) for error in (False, True) for trend in ("", "A", "Ad") for season in ("", "A", "M") if error or season != "M"]
#: Seasons from which the first states are taken.
FIRST = 4


def first_states(y: np.ndarray, m: int, trend: bool, season: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(level, slope, season (s, m)) before the first value: a line and one term or factor per season position, fitted in
    turn until a series that is just that is met exactly."""
    s, n = y.shape
    used = min(n, FIRST * m if season else 10)
    v, t = y[:, :used], np.arange(used) + 1.0
    terms = np.ones((s, m)) if season == "M" else np.zeros((s, m))
    at = np.arange(used) % m
    centre = t - t.mean()
    level, slope = v.mean(axis=1), np.zeros(s)
    for _ in range(60 if season else 1):
        flat = v / terms[:, at] if season == "M" else v - terms[:, at] if season else v
        if trend:
            slope = (flat * centre).sum(axis=1) / max((centre * centre).sum(), 1e-300)
        level = flat.mean(axis=1) - slope * t.mean()
        if not season:
            break
        line = level[:, None] + slope[:, None] * t
        with np.errstate(all="ignore"):
            rest = v / np.where(np.abs(line) > 1e-12, line, 1e-12) if season == "M" else v - line
        terms = np.stack([rest[:, at == k].mean(axis=1) for k in range(m)], axis=1)
        if season == "M":
            mean = terms.mean(axis=1, keepdims=True)
            terms = np.where(np.isfinite(terms) & (mean > 0) & (terms > 1e-6), terms / np.where(mean > 0, mean, 1.0), 1.0)
        else:
            terms = terms - terms.mean(axis=1, keepdims=True)
    return level, slope, terms


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _smooth(y: np.ndarray, m: int, form: Form, x: np.ndarray, states) -> tuple[np.ndarray, np.ndarray, tuple]:
    """(fitted (..., n), errors, last states) for parameters x (..., k): smoothing weights, then shifts of the first level
    and slope."""
    _, trend, season = form
    level, slope, terms = states
    shape = x.shape[:-1]
    alpha = 1e-4 + 0.9998 * _sigmoid(x[..., 0])
    beta = alpha * _sigmoid(x[..., 1]) if trend else np.zeros(shape)
    gamma = (1 - alpha) * _sigmoid(x[..., 1 + bool(trend)]) if season else np.zeros(shape)
    phi = 0.8 + 0.18 * _sigmoid(x[..., 1 + bool(trend) + bool(season)]) if trend == "Ad" else np.ones(shape)
    at = 1 + bool(trend) + bool(season) + (trend == "Ad")
    now = level + 0.1 * x[..., at]
    b = slope + 0.01 * x[..., at + 1] if trend else np.zeros(shape)
    seas = np.broadcast_to(terms, (*shape, terms.shape[-1])).copy()
    n = y.shape[1]
    fitted, errors = np.empty((n, *shape)), np.empty((n, *shape))
    with np.errstate(all="ignore"):
        for t in range(n):
            base = now + phi * b
            cell = seas[..., t % m]
            fit = base * cell if season == "M" else base + cell if season else base
            e = y[:, t] - fit
            fitted[t], errors[t] = fit, e
            to_level = e / cell if season == "M" else e
            now = base + alpha * to_level
            b = phi * b + beta * to_level
            if season:
                seas[..., t % m] = cell + gamma * (e / base if season == "M" else e)
    return np.moveaxis(fitted, 0, -1), np.moveaxis(errors, 0, -1), (now, b, seas, phi)


def ets_forecast(y: np.ndarray, h: int, m: int, form: Form) -> tuple[np.ndarray, np.ndarray]:
    """(score, forecast) of one form for every series. Multiplicative parts need positive series; others get no score."""
    error, trend, season = form
    size = unit(y)
    v = y / size
    states = first_states(v, m, bool(trend), season)
    fits = (v > 0).all(axis=1) if error or season == "M" else np.ones(len(y), dtype=bool)

    def residuals(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        fitted, e, _ = _smooth(v[rows], m, form, x, tuple(part[rows] for part in states))
        with np.errstate(all="ignore"):
            if error:
                # relative errors, scaled so that their sum of squares is the likelihood of the form
                safe = np.where(fitted > 1e-8, fitted, 1e-8)
                e = e / safe * np.exp(np.log(safe).mean(axis=-1, keepdims=True))
            return np.where(np.isfinite(e), np.clip(e, -1e8, 1e8), 1e8)

    n_weights = 1 + bool(trend) + bool(season) + (trend == "Ad")
    start = np.zeros((len(y), n_weights + 1 + bool(trend)))
    start[:, :n_weights] = -2.0
    start[:, 0] = -1.0
    x, sse = least_squares(residuals, start)
    _, _, (now, b, seas, phi) = _smooth(v, m, form, x, states)
    steps = np.arange(1, h + 1)
    grow = np.cumsum(phi[:, None] ** steps, axis=1) if trend else np.zeros((1, h))
    with np.errstate(all="ignore"):
        out = now[:, None] + b[:, None] * grow
        ahead = seas[:, (v.shape[1] + steps - 1) % m]
        out = out * ahead if season == "M" else out + ahead if season else out
    k = x.shape[1] + (m - 1 if season else 0) + 1
    # a perfect fit has no variance; 1e-20 of the series stands for it, so that the simpler form wins
    score = aicc(np.maximum(sse, 1e-20 * (v * v).sum(axis=1)), y.shape[1], k)
    return np.where(fits & np.isfinite(out).all(axis=1), score, np.inf), out * size


def ets_forms(n: int, m: int) -> list[Form]:
    """The forms that a series of n values can carry."""
    return [f for f in FORMS if (not f[1] or n >= 4) and (not f[2] or (m > 1 and n >= 2 * m))]


def auto_ets(y: np.ndarray, h: int, m: int) -> np.ndarray:
    """Exponential smoothing with the form chosen per series. Where no form has a score, the simplest one speaks."""
    n = y.shape[1]
    best, out = np.full(len(y), np.inf), None
    for form in ets_forms(n, m):
        score, path = ets_forecast(y, h, max(m, 1), form)
        if out is None:
            best, out = score, np.where(np.isfinite(path), path, y[:, -1:])
            continue
        wins = score < best
        best, out = np.where(wins, score, best), np.where(wins[:, None], path, out)
    return out


def candidates(model: str, m: int) -> list[Form] | list[Order]:
    """Every candidate of a search, in the order in which equal scores are decided."""
    if model == "AutoETS":
        return FORMS
    if model == "AutoARIMA":
        return arma_orders(m, 2 * m, True)
    raise ValueError(f"{model!r} is not a search; use AutoETS or AutoARIMA")


def one_candidate(model: str, number: int, y: np.ndarray, h: int, m: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, forecast) of one candidate alone; the score is infinite where the search would not try it."""
    chosen = candidates(model, m)[number]
    if model == "AutoETS":
        if chosen in ets_forms(y.shape[1], m):
            return ets_forecast(y, h, max(m, 1), chosen)
        return np.full(len(y), np.inf), np.repeat(y[:, -1:], h, axis=1)

    def alone(m: int, n: int, constant: bool) -> list[Order]:
        return [o for o in arma_orders(m, n, constant) if o[:4] == chosen[:4]]

    return arima_search(y, h, m, alone)


# ---- one fixed form ----


def holt_winters(y: np.ndarray, h: int, m: int, alpha: float = 0.3, beta: float = 0.1, gamma: float = 0.2) -> np.ndarray:
    """Additive trend and multiplicative season with given weights. The first season gives the level and the factors, the
    second one the slope; series of less than two seasons, or with a first season of mean 0, are smoothed without one.
    Where the line or a factor is not positive, it is left out of the quotient it would divide."""
    s, n = y.shape
    if m < 2 or n < 2 * m:
        m = 1
        level, slope, terms = y[:, 0].astype(float), np.zeros(s), np.ones((s, 1))
    else:
        level = y[:, :m].sum(axis=1) / m
        slope = (y[:, m : 2 * m].sum(axis=1) / m - level) / m
        seasonal = level > 0
        terms = np.where(seasonal[:, None], y[:, :m] / np.where(seasonal, level, 1.0)[:, None], 1.0)
    for t in range(m if m > 1 else 1, n):
        base, cell = level + slope, terms[:, t % m]
        e = y[:, t] - base * cell
        level = base + alpha * np.where(cell > 0, e / np.where(cell > 0, cell, 1.0), e)
        slope = slope + alpha * beta * np.where(cell > 0, e / np.where(cell > 0, cell, 1.0), e)
        if m > 1:
            terms[:, t % m] = np.where(base > 0, cell + gamma * (e / np.where(base > 0, base, 1.0)), cell)
    steps = np.arange(1, h + 1)
    return (level[:, None] + steps * slope[:, None]) * terms[:, (n + steps - 1) % m]
