"""Histogram gradient-boosted trees for two classes, grown level by level and kept as flat arrays.

Training is for samples of a stated bound that fit the driver; a tree is complete to DEPTH, so node k has the children
2k + 1 and 2k + 2 and a whole level is a few array operations. Nodes that don't split send everything left.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """feature, threshold: [tree, inner node]; leaf: [tree, leaf]; a row goes right where its value exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The log-odds of each row of x."""
        depth, out, rows = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0, np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def train(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 8, ridge: float = 1.0) -> Trees:
    """Trees for rows x with classes y (0, 1). Without rows, or with one class, a constant with one row's doubt."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    none = np.zeros((0, (1 << depth) - 1))
    model = Trees(none.astype(np.int64), none, np.zeros((0, 1 << depth)), float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T, strict=True)])
    margin, features, thresholds, leaves = np.full(len(y), model.base), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, hessian = y - p, np.maximum(p * (1 - p), 1e-9)
        feature, threshold, node = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            width, first = 1 << level, (1 << level) - 1
            at = (node - first) * bins
            best, where = np.full(width, 1e-6), [(-1, 0)] * width
            for f in range(len(binned)):
                g, h, n = (np.bincount(at + binned[f], w, width * bins).reshape(width, bins).cumsum(axis=1) for w in (gradient, hessian, None))
                left, right = g[:, :-1] ** 2 / (h[:, :-1] + ridge), (g[:, -1:] - g[:, :-1]) ** 2 / (h[:, -1:] - h[:, :-1] + ridge)
                gain = left + right - g[:, -1:] ** 2 / (h[:, -1:] + ridge)
                gain[(n[:, :-1] < least) | (n[:, -1:] - n[:, :-1] < least)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                for k in np.flatnonzero(gain[np.arange(width), top] > best):
                    best[k], where[k] = gain[k, top[k]], (f, int(top[k]))
            for k, (f, b) in enumerate(where):
                if f >= 0:
                    feature[first + k], threshold[first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        place = node - ((1 << depth) - 1)
        leaf = rate * np.bincount(place, gradient, 1 << depth) / (np.bincount(place, hessian, 1 << depth) + ridge)
        margin = margin + leaf[place]
        features.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), model.base)
