"""Boosted trees on lagged values for many series, per level or for all levels together.

A series is one row. One pass over the series grows all trees of a round by one depth: each task adds up the gradients of
its series' times by group, node, feature and bin, the sums meet in one aggregation, and the best split of every node is
read off them. Gradients are added as whole numbers, so the trees do not depend on the order of tasks. What reaches the
driver is bounded by groups x nodes x features x bins, whatever the data.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.operators.models import PRED_TYPE, null_safe_on
from stratocast.session import cut_lineage

#: Bins of a feature, and the fine grid on which its quantiles are counted (steps of 1 / FINE within +- RANGE sizes of a
#: series; larger values fall into the last step).
BINS, FINE, RANGE = 32, 256, 8
#: Gradients are rounded to 2**-POINT sizes of a series.
POINT = 24
#: Times that a split has to leave on each side, what is added to the times of a node, and the times of no change that a
#: key value counts besides its own.
LEAST, CALM, PRIOR = 8, 1.0, 20.0


@dataclass
class Trees:
    """Complete trees of one depth for every group: split feature and bin of each inner node (a time goes right if its bin
    is larger), value of each leaf. A node that is not split sends all to the left."""

    edges: np.ndarray  # (k, BINS - 1)
    depth: int
    split: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # per round: feature, bin (groups, nodes)
    value: list[np.ndarray] = field(default_factory=list)  # per round: (groups, leaves)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Features (..., k) to bins."""
        return np.stack([np.searchsorted(self.edges[j], x[..., j], side="left") for j in range(len(self.edges))], axis=-1)

    def walk(self, group: np.ndarray, bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, steps: int) -> np.ndarray:
        """The node of every row after so many steps, counted from 0 within its depth."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        for step in range(steps):
            node = (1 << step) - 1 + at
            at = 2 * at + (bins[rows, feature[group, node]] > cut[group, node])
        return at

    def predict(self, group: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out = np.zeros(len(bins))
        for (feature, cut), value in zip(self.split, self.value):
            out += value[group, self.walk(group, bins, feature, cut, self.depth)]
        return out


def times_of(y: np.ndarray, codes: np.ndarray, m: int, n_lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Features (s, times, k) and targets (s, times) of scaled series (s, n): last values, the value a season ago, the
    season position, the codes of the keys. The targets are changes from the last value."""
    n, back = y.shape[1], max(n_lags, m)
    at = np.arange(back, n)
    x = [*(y[:, at - lag] for lag in range(1, n_lags + 1)), y[:, at - m], np.broadcast_to(at % m / m, (len(y), len(at)))]
    x += [np.broadcast_to(codes[:, j : j + 1], (len(y), len(at))) for j in range(codes.shape[1])]
    return np.stack(x, axis=2), y[:, at] - y[:, at - 1]


def _series(batch: pa.RecordBatch, back: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(group, codes, scaled values) of the series of a batch (group, codes, hist) that are longer than `back`, one length
    at a time."""
    size = batch.column(2).value_lengths().to_numpy()
    for n in np.unique(size[size > back]):
        rows = pa.array(np.flatnonzero(size == n))
        y = batch.column(2).take(rows).flatten().to_numpy().reshape(-1, n)
        codes = batch.column(1).take(rows).flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
        yield batch.column(0).take(rows).to_numpy(), codes, y / np.maximum(np.abs(y).mean(axis=1, keepdims=True), 1e-9)


def _counted(series: DataFrame, cells, n_cells: int, back: int) -> np.ndarray:
    """Sums over all series of whole numbers by cell: `cells` gives (cell, number) arrays of some series."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_cells, dtype=np.int64)
        for batch in batches:
            for some in _series(batch, back):
                for cell, number in cells(*some):
                    np.add.at(total, cell, number)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "v"])

    found = series.mapInArrow(run, "cell long, v long").groupBy("cell").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(n_cells, dtype=np.int64)
    out[found.column("cell").to_numpy()] = found.column("v").to_numpy()
    return out


def quantile_edges(series: DataFrame, k: int, m: int, n_lags: int) -> np.ndarray:
    """(k, BINS - 1): values that cut each feature into bins of about equal counts."""
    width = 2 * RANGE * FINE

    def cells(group, codes, y):
        x, _ = times_of(y, codes, m, n_lags)
        step = np.clip(np.floor(x * FINE).astype(np.int64) + RANGE * FINE, 0, width - 1)
        for j in range(k):
            yield j * width + step[..., j].ravel(), np.ones(step[..., j].size, dtype=np.int64)

    counts = _counted(series, cells, k * width, max(n_lags, m)).reshape(k, width)
    reached = np.cumsum(counts, axis=1)
    wanted = np.arange(1, BINS) / BINS * reached[:, -1:]
    at = np.stack([np.searchsorted(reached[j], wanted[j], side="left") for j in range(k)])
    return (np.minimum(at, width - 1) + 1 - RANGE * FINE) / FINE


def best_splits(g: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, bin) of the best split of every node from its sums by feature and bin (groups, nodes, k, BINS); bin BINS
    where no split lowers the loss. Equal gains go to the first feature and bin."""
    left_g, left_n = np.cumsum(g, axis=3)[..., :-1], np.cumsum(n, axis=3)[..., :-1]
    all_g, all_n = g.sum(axis=3, keepdims=True), n.sum(axis=3, keepdims=True)
    part = lambda a, b: a.astype(float) ** 2 / (b + CALM)
    gain = part(left_g, left_n) + part(all_g - left_g, all_n - left_n) - part(all_g, all_n)
    gain = np.where((left_n >= LEAST) & (all_n - left_n >= LEAST), gain, 0.0)
    flat = gain.reshape(*gain.shape[:2], -1)
    pick = flat.argmax(axis=2)
    works = np.take_along_axis(flat, pick[..., None], axis=2)[..., 0] > 0
    return np.where(works, pick // (BINS - 1), 0), np.where(works, pick % (BINS - 1), BINS)


def fit_trees(series: DataFrame, n_groups: int, k: int, m: int, n_lags: int, rounds: int, depth: int, rate: float) -> tuple[Trees, np.ndarray]:
    """(trees, losses): the loss (rounds + 1, groups) is the mean squared error before each round and after the last.
    `series` has the columns group, codes and hist."""
    back = max(n_lags, m)
    trees = Trees(quantile_edges(series, k, m, n_lags), depth)
    losses = []
    for _ in range(rounds):
        feature = np.zeros((n_groups, (1 << depth) - 1), dtype=np.int64)
        cut = np.full((n_groups, (1 << depth) - 1), BINS, dtype=np.int64)
        for step in range(depth + 1):
            nodes = 1 << step
            n_cells = n_groups * nodes * k * BINS

            def cells(group, codes, y, feature=feature, cut=cut, step=step, nodes=nodes, n_cells=n_cells):
                x, z = times_of(y, codes, m, n_lags)
                of = np.repeat(group, z.shape[1])
                bins = trees.bins(x).reshape(-1, k)
                left = z.ravel() - trees.predict(of, bins)
                g = np.rint(left * (1 << POINT)).astype(np.int64)
                node = of * nodes + trees.walk(of, bins, feature, cut, step)
                if step == 0:
                    yield 2 * n_cells + of, np.rint(left * left * (1 << POINT)).astype(np.int64)
                for j in range(k if step < depth else 1):
                    cell = (node * k + j) * BINS + bins[:, j]
                    yield cell, g
                    yield n_cells + cell, np.ones(len(g), dtype=np.int64)

            sums = _counted(series, cells, 2 * n_cells + n_groups, back)
            g, n = (sums[i * n_cells : (i + 1) * n_cells].reshape(n_groups, nodes, k, BINS) for i in (0, 1))
            if step == 0:
                times = n[:, 0, 0].sum(axis=1)
                losses.append(sums[2 * n_cells :] / (1 << POINT) / np.maximum(times, 1))
            if step < depth:
                feature[:, nodes - 1 : 2 * nodes - 1], cut[:, nodes - 1 : 2 * nodes - 1] = best_splits(g, n)
            else:
                value = rate * g[:, :, 0].sum(axis=2) / (1 << POINT) / (n[:, :, 0].sum(axis=2) + CALM)
                trees.split.append((feature, cut))
                trees.value.append(value)

    def rest(group, codes, y):
        x, z = times_of(y, codes, m, n_lags)
        of = np.repeat(group, z.shape[1])
        left = z.ravel() - trees.predict(of, trees.bins(x).reshape(-1, k))
        yield of, np.rint(left * left * (1 << POINT)).astype(np.int64)
        yield n_groups + of, np.ones(len(of), dtype=np.int64)

    last = _counted(series, rest, 2 * n_groups, back)
    losses.append(last[:n_groups] / (1 << POINT) / np.maximum(last[n_groups:], 1))
    return trees, np.stack(losses)


def with_key_codes(histories: DataFrame, hist: str, keys: Sequence[str], back: int) -> DataFrame:
    """The rows with `codes`: for each key how much the series of its value change from one time to the next."""
    size = F.greatest(F.aggregate("_h", F.lit(0.0), lambda a, v: a + F.abs(v)) / F.nullif(F.size("_h"), F.lit(0)), F.lit(1e-9))
    long = F.size("_h") > back
    # changes add up to the last value less the first
    change = F.when(long, (F.try_element_at("_h", F.lit(-1)) - F.try_element_at("_h", F.lit(back))) / size)
    out = histories.withColumn("_h", F.col(hist).cast("array<double>")).withColumns({"_c": change, "_n": F.when(long, F.size("_h") - back), "codes": F.array().cast("array<double>")})
    sums = {key: out.groupBy(key).agg((F.coalesce(F.sum("_c"), F.lit(0.0)) / (F.coalesce(F.sum("_n"), F.lit(0)) + PRIOR)).alias("code")) for key in keys}
    for key, codes in sums.items():
        # rounded, as sums of doubles depend on the order of tasks
        out = out.alias("r").join(codes.alias("c"), null_safe_on([key], "r", "c")).select("r.*", F.round("c.code", 9).alias("_code"))
        out = out.withColumn("codes", F.concat("codes", F.array("_code"))).drop("_code")
    return out.drop("_c", "_n")


def boosted_forecast(
    histories: DataFrame, series: Sequence[str], hist: str, h: int, season: int, keys: Sequence[str] = (), mode: str = "global",
    n_lags: int = 3, rounds: int = 8, depth: int = 3, rate: float = 0.3,
) -> tuple[DataFrame, np.ndarray]:
    """((histories with `pred`), losses): forecasts of h steps, each step feeding the next. `series` is level_id and the
    keys; `keys` are those of its columns that are features. mode "level" grows trees for every level alone, "global" for
    all at once; losses are (rounds + 1, groups) by level_id or one group. Too short series repeat their last value."""
    if mode not in ("level", "global"):
        raise ValueError(f"unknown training mode {mode!r}; use 'level' or 'global'")
    spark = histories.sparkSession
    back = max(n_lags, season)
    keys = [k for k in keys if mode == "global" or k != "level_id"]
    n_groups = 1 << (len(series) - 1) if mode == "level" else 1
    group = F.col("level_id").cast("long") if mode == "level" else F.lit(0).cast("long")
    coded = cut_lineage(with_key_codes(histories, hist, keys, back).withColumn("_g", group))
    k = n_lags + 2 + len(keys)
    rows = coded.select(F.col("_g").alias("group"), "codes", F.col("_h").alias("hist"))
    trees, losses = fit_trees(rows, n_groups, k, season, n_lags, rounds, depth, rate)
    sent = spark.sparkContext.broadcast(trees)

    @F.pandas_udf("array<double>")
    def roll(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        trees = sent.value
        for groups, codes, hists in batches:
            out: list = [[None] * h if not len(y) else [float(y[-1])] * h for y in hists]
            size = hists.map(len).to_numpy()
            for n in np.unique(size[size > back]):
                at = np.flatnonzero(size == n)
                y = np.stack(hists.iloc[at].to_list())
                scale = np.maximum(np.abs(y).mean(axis=1, keepdims=True), 1e-9)
                path = np.concatenate([y / scale, np.zeros((len(at), h))], axis=1)
                of, code = groups.iloc[at].to_numpy(), np.stack(codes.iloc[at].to_list()).reshape(len(at), -1).astype(float)
                for t in range(n, n + h):
                    x, _ = times_of(path[:, t - back : t + 1], code, season, n_lags)
                    x[:, 0, n_lags + 1] = t % season / season
                    path[:, t] = path[:, t - 1] + trees.predict(of, trees.bins(x[:, 0]))
                for i, row in zip(at, path[:, n:] * scale):
                    out[i] = row
            yield pd.Series(out, index=hists.index)

    return coded.withColumn("pred", roll("_g", "codes", "_h").cast(f"array<{PRED_TYPE}>")).drop("_h", "_g", "codes"), losses
