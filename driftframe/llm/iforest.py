"""Isolation forest in numpy, scored by mean path length."""

from __future__ import annotations

import numpy as np


def _mean_path(n: np.ndarray | int) -> np.ndarray:
    """Mean path length of an unsuccessful search in a binary search tree of n points."""
    n = np.asarray(n, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n > 2, 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees of random splits over the box from 0 to CAP in every feature, down to single points of small subsamples; nodes in arrays,
    heap order, so that scoring is vectorised over documents.

    Splits fall anywhere in a node's box, not only between its points: a document where the fitted ones are not comes to an empty
    node after few splits, one among them after many.
    """

    def __init__(self, trees: int = 128, sample: int = 256, depth: int = 10, cap: float = 4.0, seed: int = 7):
        self.trees, self.sample, self.depth, self.cap, self.seed = trees, sample, depth, cap, seed

    def fit(self, x: np.ndarray) -> IsolationForest:
        """x: rows of features from 0 up, in any number; with none, every score is 0."""
        rng = np.random.default_rng(self.seed)
        x = np.clip(x, 0.0, self.cap)
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.zeros((self.trees, size), np.int16)
        self.split = np.full((self.trees, size), np.inf)
        self.length = np.zeros((self.trees, size))
        self.leaf = np.ones((self.trees, size), bool)
        self.norm = float(_mean_path(min(self.sample, len(x)))) or 1.0
        self.fitted = len(x) > 1
        for t in range(self.trees if self.fitted else 0):
            rows = x[rng.choice(len(x), min(self.sample, len(x)), replace=False)]
            todo = [(0, 0, rows, np.zeros(x.shape[1]), np.full(x.shape[1], self.cap))]
            while todo:
                node, depth, part, low, high = todo.pop()
                if depth == self.depth or len(part) <= 1:
                    self.length[t, node] = depth + _mean_path(len(part))
                    continue
                wide = high - low
                f = int(rng.choice(len(wide), p=wide / wide.sum()))
                at = rng.uniform(low[f], high[f])
                right = part[:, f] > at
                self.feature[t, node], self.split[t, node], self.leaf[t, node] = f, at, False
                up, down = high.copy(), low.copy()
                up[f] = down[f] = at
                todo += [(2 * node + 1, depth + 1, part[~right], low, up), (2 * node + 2, depth + 1, part[right], down, high)]
        return self

    def paths(self, x: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees."""
        x = np.clip(x, 0.0, self.cap)
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                goes = x[rows, self.feature[t, node]] > self.split[t, node]
                node = np.where(self.leaf[t, node], node, 2 * node + 1 + goes)
            total += self.length[t, node]
        return total / self.trees

    def score(self, x: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1), from path lengths alone: near 1 for rows that few splits isolate, low for ordinary ones."""
        if not self.fitted or not len(x):
            return np.zeros(len(x))
        return 2.0 ** (-self.paths(x) / self.norm)
