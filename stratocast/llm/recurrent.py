"""A bidirectional LSTM that labels every element of a sequence, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * x))


class Labeller:
    """Two directions of `hidden` units over inputs of `size` numbers, and one logistic output for each element."""

    def __init__(self, size: int, hidden: int, seed: int):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.size, self.hidden = size, hidden
        self.weights: dict[str, np.ndarray] = {}
        for way in ("f", "b"):
            self.weights[f"{way}x"] = rng.normal(0, size**-0.5, (size, 4 * hidden))
            self.weights[f"{way}h"] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0  # remember at first
            self.weights[f"{way}c"] = bias
        self.weights["o"] = rng.normal(0, (2 * hidden) ** -0.5, 2 * hidden)
        self.weights["oc"] = np.zeros(1)
        self.weights = {k: v.astype(np.float32) for k, v in self.weights.items()}

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """Outputs of one direction for x (steps, sequences, size); `mask` (steps, sequences) is 0 beyond the end."""
        steps, n, _ = x.shape
        h_size = self.hidden
        inner = (x.reshape(-1, self.size) @ self.weights[f"{way}x"] + self.weights[f"{way}c"]).reshape(steps, n, -1)
        out = np.zeros((steps, n, h_size), dtype=np.float32)
        h = np.zeros((n, h_size), dtype=np.float32)
        c = np.zeros((n, h_size), dtype=np.float32)
        tape: list = [None] * steps
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            z = inner[t] + h @ self.weights[f"{way}h"]
            gates = _sigmoid(z[:, : 3 * h_size])
            i, f, o = gates[:, :h_size], gates[:, h_size : 2 * h_size], gates[:, 2 * h_size :]
            g = np.tanh(z[:, 3 * h_size :])
            m = mask[t][:, None]
            new_c = f * c + i * g
            squashed = np.tanh(new_c)
            new_h = o * squashed
            if keep:
                tape[t] = (h, c, i, f, o, g, squashed)
            c = m * new_c + (1 - m) * c
            h = m * new_h + (1 - m) * h
            out[t] = h
        return out, tape

    def scores(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The logit of each element, (steps, sequences)."""
        both = np.concatenate([self._run("f", x, mask, False)[0], self._run("b", x, mask, False)[0]], axis=2)
        return both @ self.weights["o"] + self.weights["oc"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {way: self._run(way, x, mask, True) for way in ("f", "b")}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = _sigmoid(both @ self.weights["o"] + self.weights["oc"][0])
        total = mask.sum()
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / total)
        d_out = mask * (p - y) / total
        grads = {"o": np.einsum("tn,tnh->h", d_out, both), "oc": np.array([d_out.sum()])}
        h_size = self.hidden
        for k, way in enumerate(("f", "b")):
            tape = runs[way][1]
            d_h_all = d_out[:, :, None] * self.weights["o"][k * h_size : (k + 1) * h_size]
            d_h = np.zeros_like(d_h_all[0])
            d_c = np.zeros_like(d_h)
            d_z_all = np.zeros((*mask.shape, 4 * h_size), dtype=np.float32)
            g_h = np.zeros_like(self.weights[f"{way}h"])
            steps = len(mask)
            for t in range(steps - 1, -1, -1) if way == "f" else range(steps):
                h0, c0, i, f, o, g, squashed = tape[t]
                m = mask[t][:, None]
                d_h = d_h + d_h_all[t]
                into_h, into_c = m * d_h, m * d_c
                inner = into_c + into_h * o * (1 - squashed**2)
                d_z = np.concatenate([inner * g * i * (1 - i), inner * c0 * f * (1 - f), into_h * squashed * o * (1 - o), inner * i * (1 - g**2)], axis=1)
                d_z_all[t] = d_z
                g_h += h0.T @ d_z
                d_h = d_z @ self.weights[f"{way}h"].T + (1 - m) * d_h
                d_c = inner * f + (1 - m) * d_c
            flat = d_z_all.reshape(-1, 4 * h_size)
            grads |= {f"{way}x": x.reshape(-1, self.size).T @ flat, f"{way}h": g_h, f"{way}c": flat.sum(axis=0)}
        return loss, grads

    def fit(self, sequences: list[tuple[np.ndarray, np.ndarray]], epochs: int, batch: int, rate: float, seed: int) -> list[float]:
        """Adam over (inputs, labels) of each sequence; the mean loss of each epoch. The same arguments give the
        same weights."""
        rng = np.random.Generator(np.random.PCG64(seed))
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        losses, step = [], 0
        for epoch in range(epochs):
            order = rng.permutation(len(sequences))
            seen = []
            for k in range(0, len(order), batch):
                x, mask, y = padded([sequences[j] for j in order[k : k + batch]], self.size)
                loss, grads = self.gradients(x, mask, y)
                norm = float(np.sqrt(sum((g**2).sum() for g in grads.values())))
                step += 1
                for name, g in grads.items():
                    g = g * min(1.0, 1.0 / (norm + 1e-9))
                    first[name] = 0.9 * first[name] + 0.1 * g
                    second[name] = 0.999 * second[name] + 0.001 * g**2
                    move = (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.999**step)) + 1e-8)
                    self.weights[name] = (self.weights[name] - rate * (1 - epoch / (epochs + 1)) * move).astype(np.float32)
                seen.append(loss)
            losses.append(float(np.mean(seen)))
        return losses

    def label(self, sequences: list[np.ndarray], elements: int = 16384) -> list[np.ndarray]:
        """Whether each element of each sequence is positive. Sequences of similar length are run together, about
        `elements` at once; a longer sequence is run alone, and none is cut."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(sequences)
        order = sorted((k for k, s in enumerate(sequences) if len(s)), key=lambda k: len(sequences[k]))
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * len(sequences[order[end]]) <= elements:
                end += 1
            group = order[at:end]
            x, mask, _ = padded([(sequences[k], None) for k in group], self.size)
            scores = self.scores(x, mask)
            for n, k in enumerate(group):
                out[k] = scores[: len(sequences[k]), n] > 0
            at = end
        return out


def padded(sequences: list[tuple[np.ndarray, np.ndarray | None]], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(inputs, mask, labels), each with the steps first."""
    steps = max(len(x) for x, _ in sequences)
    x = np.zeros((steps, len(sequences), size), dtype=np.float32)
    mask = np.zeros((steps, len(sequences)), dtype=np.float32)
    y = np.zeros_like(mask)
    for n, (values, labels) in enumerate(sequences):
        x[: len(values), n] = values
        mask[: len(values), n] = 1
        if labels is not None:
            y[: len(values), n] = labels
    return x, mask, y
