"""Small gradient-boosted trees for binary labels on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 48


@dataclass
class BoostedTrees:
    """Each tree is full to ``depth``: arrays of feature and threshold per inner node, value per leaf."""

    base: float = 0.0
    depth: int = 4
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, threshold, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - len(feature)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, penalty: float = 1.0, least: float = 1.0) -> BoostedTrees:
    """Newton boosting of the logistic loss; ``least`` is the smallest sum of second derivatives of a child."""
    model = BoostedTrees(depth=depth)
    if not len(x):
        return model
    share = np.clip(y.mean(), 0.01, 0.99)
    model.base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    margin, inner = np.full(len(x), model.base), 2**depth - 1
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold, cut = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, BINS)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            local = node - first
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                at = local * BINS + binned[:, f]
                gl = np.bincount(at, g, width * BINS).reshape(width, BINS).cumsum(axis=1)
                hl = np.bincount(at, h, width * BINS).reshape(width, BINS).cumsum(axis=1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                gain[(hl < least) | (ht - hl < least)] = 0
                gain = gain[:, :len(e)]
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                for n in np.nonzero(top > best)[0]:
                    best[n], feature[first + n], threshold[first + n], cut[first + n] = top[n], f, e[k[n]], k[n]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        margin = margin + value[leaf]
        model.trees.append((feature, threshold, value))
    return model
