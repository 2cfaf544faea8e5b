"""Gradient-boosted trees for a two-class label, fitted on a bounded sample in memory."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; ``feature`` is -1 at a leaf. Rows with ``x <= threshold`` go left."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = (np.array(c) for c in (self.feature, self.threshold, self.left, self.right, self.value))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return value[at]

    def paths(self) -> list[tuple[tuple[int, str, float], ...]]:
        """The conditions from the root to each node below it."""
        found, stack = [], [(0, ())]
        while stack:
            node, path = stack.pop()
            if path:
                found.append(path)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                stack += [(self.right[node], (*path, (f, ">", t))), (self.left[node], (*path, (f, "<=", t)))]
        return found


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts between values of each feature, at quantiles where there are many values."""
    edges = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1), method="nearest"))
        edges.append((values[:-1] + values[1:]) / 2)
    return edges


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, rate: float, least: float, ridge: float) -> Tree:
    tree = Tree()
    stack = [(tree.add(0.0), rows, depth)]
    while stack:
        node, rows, depth = stack.pop()
        gs, hs = g[rows].sum(), h[rows].sum()
        tree.value[node] = -rate * gs / (hs + ridge)
        if not depth:
            continue
        best = (1e-6, -1, -1)
        for f, cuts in enumerate(edges):
            if not len(cuts):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(cuts) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(cuts) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least) | (hs - hl < least)] = 0
            k = int(gain.argmax())
            best = max(best, (float(gain[k]), f, k))
        if best[1] >= 0:
            f, k = best[1:]
            goes = binned[rows, f] <= k
            tree.feature[node], tree.threshold[node] = f, float(edges[f][k])
            tree.left[node], tree.right[node] = tree.add(0.0), tree.add(0.0)
            stack += [(tree.left[node], rows[goes], depth - 1), (tree.right[node], rows[~goes], depth - 1)]
    return tree


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, share: float = 1.0, least: float = 2.0, ridge: float = 1.0, seed: int = 7) -> tuple[float, list[Tree]]:
    """The prior log-odds and trees for the logistic loss. Each tree sees a random ``share`` of the rows."""
    rng = np.random.default_rng(seed)
    mean = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    prior = float(np.log(mean / (1 - mean)))
    if len(np.unique(y)) < 2:
        return prior, []
    edges = bin_edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)], axis=1)
    z, found = np.full(len(y), prior), []
    for _ in range(trees):
        p = sigmoid(z)
        rows = np.flatnonzero(rng.random(len(y)) < share) if share < 1 else np.arange(len(y))
        tree = _grow(binned, edges, p - y, p * (1 - p), rows, depth, rate, least, ridge)
        z += tree.predict(x)
        found.append(tree)
    return prior, found


def log_odds(model: tuple[float, list[Tree]], x: np.ndarray) -> np.ndarray:
    prior, trees = model
    return prior + sum((t.predict(x) for t in trees), np.zeros(len(x)))
