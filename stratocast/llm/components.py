"""Connected components of a graph of longs: local forests, then stars that shrink to one per component."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratocast.llm.common import salted_join
from stratocast.session import cut_lineage

#: Links that a task holds before it reduces them to a forest.
HOLD = 1 << 18


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, root of each): the root is the smallest node of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        low = np.minimum(x, y)
        np.minimum.at(root, x, low)
        np.minimum.at(root, y, low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        x, y = root[x], root[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        # hook the larger root under the smaller one before the next turn
        if len(x):
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
    while True:
        up = root[root]
        if np.array_equal(up, root):
            return nodes, nodes[root]
        root = up


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """At most one link (node, root) for each node, with the same components."""
    if not len(a):
        return a, b
    nodes, top = roots(a, b)
    off = nodes != top
    return nodes[off], top[off]


def local_forests(links: DataFrame) -> DataFrame:
    """The links (a, b) of each task as a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = b = np.zeros(0, dtype=np.int64)
        for batch in batches:
            a = np.concatenate([a, batch.column(0).to_numpy()])
            b = np.concatenate([b, batch.column(1).to_numpy()])
            if len(a) > HOLD:
                a, b = forest(a, b)
                if len(a) > HOLD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
                    a = b = a[:0]
        a, b = forest(a, b)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b), the root being the smallest node of the component.

    Large and small stars in turn until nothing changes. Minima are aggregated before they move and joined back by
    plain joins, which adaptive execution splits where one node holds many links. Each turn ends in a table in the
    shared folder, so a lost executor costs one turn. No links give no rows.
    """
    edges = cut_lineage(local_forests(links).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        return tuple(row)

    def star(df: DataFrame, both: bool) -> DataFrame:
        sides = df.unionByName(df.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else df
        least = sides.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = sides.join(least, "a")
        if both:
            return met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()

    last = mark(edges)
    while last[0]:
        edges = cut_lineage(star(star(edges, both=True), both=False))
        now = mark(edges)
        if now == last:
            break
        last = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


def grouped(rows: DataFrame, links_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, th, fp, component) of the rows (id, th, fp, ...): the smallest id that each row reaches over the links
    between the distinct `fp`, which `links_of` makes of a frame with one row for each."""
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("id").alias("low"), F.max("id").alias("high")))
    tops = components(links_of(nodes))
    known = tops.join(nodes, tops.node == nodes.fp).select("fp", "root", "low")
    lowest = known.groupBy("root").agg(F.min("low").alias("component"))
    # a component may hold a large part of all nodes
    linked = salted_join(known, lowest, "root", "fp").select("fp", "component")
    named = nodes.join(linked, "fp", "left").where("component is not null or low < high").select("fp", F.coalesce("component", "low").alias("component"))
    # a fingerprint without a row here is one document's alone
    return salted_join(rows, named, "fp", "id", "left").select("id", "th", "fp", F.coalesce("component", "id").alias("component"))
