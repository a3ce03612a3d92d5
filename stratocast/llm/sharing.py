"""Term sets that several queries share, and a graph that evaluates all queries over them.

Terms that exactly the same queries hold are one set. A query is then a list of sets, those that most queries hold
first. Two neighbours that stand next to each other in several queries are joined to a set of their own, again and
again, the most frequent ones first, until no two sets are neighbours twice. What is left is a graph: a set is a group of
terms or the union of two sets, and a query the union of the few that it still lists.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np


@dataclass
class Sharing:
    """`group[t]` is the set of term t. Sets from `n_groups` on are unions, `unions[level]` holding (left, right) of
    each level, in the order of their numbers; both sides are of lower levels. Query q is the union of
    parts[bounds[q]:bounds[q + 1]]."""

    group: np.ndarray
    n_groups: int
    unions: list[tuple[np.ndarray, np.ndarray]]
    parts: np.ndarray
    bounds: np.ndarray

    @property
    def n_sets(self) -> int:
        return self.n_groups + sum(len(left) for left, _ in self.unions)

    def totals(self, sums: np.ndarray) -> np.ndarray:
        """(queries, width) from the sums of the groups (n_groups, width): every set once, then every query."""
        acc = np.zeros((self.n_sets, sums.shape[1]), dtype=sums.dtype)
        acc[: self.n_groups] = sums
        at = self.n_groups
        for left, right in self.unions:
            np.add(acc[left], acc[right], out=acc[at : at + len(left)])
            at += len(left)
        out = np.zeros((len(self.bounds) - 1, sums.shape[1]), dtype=sums.dtype)
        full = np.flatnonzero(np.diff(self.bounds))
        if len(full):
            out[full] = np.add.reduceat(acc[self.parts], self.bounds[full], axis=0)
        return out


def share(queries: list[np.ndarray], n_terms: int) -> Sharing:
    """The graph of queries that are sets of the terms 0 to n_terms - 1."""
    holders: list[list[int]] = [[] for _ in range(n_terms)]
    for q, terms in enumerate(queries):
        for t in terms.tolist():
            holders[t].append(q)
    groups: dict[tuple[int, ...], int] = {}
    group = np.array([groups.setdefault(tuple(h), len(groups)) for h in holders], dtype=np.int64)
    order = sorted(groups, key=lambda held: (-len(held), groups[held]))
    lists: list[list[int]] = [[] for _ in queries]
    for held in order:
        for q in held:
            lists[q].append(groups[held])
    n_sets = len(groups)
    unions = []
    while True:
        pairs = Counter(pair for some in lists for pair in zip(some, some[1:]))
        taken: set[int] = set()
        new: dict[tuple[int, int], int] = {}
        for (a, b), times in sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0])):
            if times < 2:
                break
            if a not in taken and b not in taken:
                new[a, b] = n_sets + len(new)
                taken |= {a, b}
        if not new:
            break
        for q, some in enumerate(lists):
            out, k = [], 0
            while k < len(some):
                union = new.get((some[k], some[k + 1])) if k + 1 < len(some) else None
                out.append(some[k] if union is None else union)
                k += 1 if union is None else 2
            lists[q] = out
        unions.append(tuple(np.array(side, dtype=np.int64) for side in zip(*new)))
        n_sets += len(new)
    parts = np.array([s for some in lists for s in some], dtype=np.int64)
    bounds = np.concatenate([[0], np.cumsum([len(some) for some in lists])]).astype(np.int64)
    return Sharing(group, len(groups), unions, parts, bounds)
