"""Gradient-boosted trees for a 0/1 label, on the driver over a bounded sample, in flat numpy arrays."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """Nodes of all trees; a leaf is its own child, so every walk takes `depth` equal steps."""

    base: float
    depth: int
    roots: list[int] = field(default_factory=list)
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        node = len(self.feature)
        self.feature.append(0)
        self.threshold.append(np.inf)
        self.left.append(node)
        self.right.append(node)
        self.value.append(0.0)
        return node

    def arrays(self):
        return tuple(np.array(x) for x in (self.feature, self.threshold, self.left, self.right, self.value))

    def margin(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, value = self.arrays()
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, feature[at]] <= threshold[at], left[at], right[at])
            out += value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.margin(x))

    def paths(self) -> list[tuple[tuple[int, bool, float], ...]]:
        """Every path from a root to a node below it: (feature, is it the <= side, threshold) each."""
        out = []

        def walk(node, path):
            if path:
                out.append(path)
            if self.left[node] != node:
                f, t = self.feature[node], self.threshold[node]
                walk(self.left[node], (*path, (f, True, t)))
                walk(self.right[node], (*path, (f, False, t)))

        for root in self.roots:
            walk(root, ())
        return out


def fit(x: np.ndarray, y: np.ndarray, n_trees: int, depth: int, monotone: list[int], rate: float = 0.2, bins: int = 48, least: int = 8, ridge: float = 1.0) -> Trees:
    """Boost `n_trees` trees on the logistic loss.

    A split on a feature with a monotonic sign must order its two values accordingly, and each side
    then stays beyond their midpoint, so a tree keeps the order as a whole. No rows or one
    class give a constant.
    """
    rate_of_ones = (y.sum() + 0.5) / (len(y) + 1)
    trees = Trees(float(np.log(rate_of_ones / (1 - rate_of_ones))), depth)
    if len(np.unique(y)) < 2:
        return trees
    edges = []
    for j in range(x.shape[1]):
        v = np.unique(x[:, j])
        cuts = (v[1:] + v[:-1]) / 2
        edges.append(np.unique(cuts[np.linspace(0, len(cuts) - 1, min(bins, len(cuts))).round().astype(int)]) if len(cuts) <= 4 * bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 2)[1:-1])))
    binned = [np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]
    margin = np.full(len(y), trees.base)

    def grow(rows, g, h, level, low, high) -> int:
        node = trees.add()
        gs, hs = g[rows].sum(), h[rows].sum()
        best = None
        if level < depth and len(rows) >= 2 * least:
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                b, size = binned[j][rows], len(e) + 1
                gl = np.cumsum(np.bincount(b, g[rows], size))[:-1]
                hl = np.cumsum(np.bincount(b, h[rows], size))[:-1]
                nl = np.cumsum(np.bincount(b, minlength=size))[:-1]
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                ok = (nl >= least) & (len(rows) - nl >= least) & (monotone[j] * (vr - vl) >= 0)
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                    best = gain[k], j, k, vl[k], vr[k]
        if best is None:
            value = float(np.clip(-gs / (hs + ridge), low, high)) * rate
            trees.value[node] = value
            margin[rows] += value
            return node
        _, j, k, vl, vr = best
        mid = (vl + vr) / 2
        bounds = {0: ((low, high), (low, high)), 1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid))}[monotone[j]]
        goes = binned[j][rows] <= k
        trees.feature[node], trees.threshold[node] = j, float(edges[j][k])
        trees.left[node] = grow(rows[goes], g, h, level + 1, *bounds[0])
        trees.right[node] = grow(rows[~goes], g, h, level + 1, *bounds[1])
        return node

    for _ in range(n_trees):
        p = sigmoid(margin)
        trees.roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), 0, -np.inf, np.inf))
    return trees
