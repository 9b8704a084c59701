"""Gradient-boosted trees for a binary label: grown over feature histograms, kept as flat arrays, walked level by level by numpy for all rows and trees at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Trees:
    """feature, threshold: (trees, 2^depth - 1); leaf: (trees, 2^depth). A row goes right where its value is above the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray, block: int = 4096) -> np.ndarray:
        """Log odds of each row. Values that are not numbers go left."""
        trees, depth = len(self.feature), int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        out = np.full(len(x), self.start)
        if not trees:
            return out
        tree = np.arange(trees)[None, :]
        for a in range(0, len(x), block):
            part = x[a : a + block]
            rows, node = np.arange(len(part))[:, None], np.zeros((len(part), trees), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (part[rows, self.feature[tree, node]] > self.threshold[tree, node])
            out[a : a + block] += self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.15, l2: float = 1.0, least: float = 1.0) -> Trees:
    """Trees for rows x (float) and labels y (0 or 1). Without both labels there are no trees, and every row gets the same score."""
    n, width = x.shape
    share = (y.sum() + 0.5) / (n + 1)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), start)
    x = np.nan_to_num(x, nan=-np.inf)
    edges = [np.unique(np.quantile(x[:, j][np.isfinite(x[:, j])], np.linspace(0, 1, BINS + 1)[1:-1])) if np.isfinite(x[:, j]).any() else np.zeros(0) for j in range(width)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(width)], axis=1)
    margin, out = np.full(n, start), Trees(np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)), start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess, node = y - p, p * (1 - p), np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 2**level
            best = np.full(nodes, 1e-9)
            feature, cut = np.zeros(nodes, np.int64), np.full(nodes, -1)
            for j in range(width):
                if not len(edges[j]):
                    continue
                at = node * BINS + binned[:, j]
                g = np.bincount(at, grad, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(at, hess, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                ga, ha = g[:, -1:], h[:, -1:]
                gain = g * g / (h + l2) + (ga - g) ** 2 / (ha - h + l2) - ga * ga / (ha + l2)
                gain[(h < least) | (ha - h < least)] = 0
                gain = gain[:, : len(edges[j])]
                k = gain.argmax(axis=1)
                better = gain[np.arange(nodes), k] > best
                best[better], feature[better], cut[better] = gain[np.arange(nodes), k][better], j, k[better]
            first = nodes - 1
            for k in np.flatnonzero(cut >= 0):
                out.feature[t, first + k], out.threshold[t, first + k] = feature[k], edges[feature[k]][cut[k]]
            right = (cut[node] >= 0) & (binned[np.arange(n), feature[node]] > cut[node])
            node = 2 * node + right
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        out.leaf[t] = rate * g / (h + l2)
        margin += out.leaf[t][node]
    return out


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """The chance that a row of label 1 scores above one of label 0; ties count half."""
    order = np.argsort(score, kind="stable")
    values, inverse, counts = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - (counts - 1) / 2)[inverse]
    ones = y[order] == 1
    a, b = ones.sum(), (~ones).sum()
    return float((rank[ones].sum() - a * (a + 1) / 2) / (a * b)) if a and b else float("nan")
