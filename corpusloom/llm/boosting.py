"""Small gradient-boosted trees with logistic loss, in numpy, for models trained on the driver.

Features are cut at quantiles into at most ``BINS`` bins; trees grow level by level on histograms of gradients.
Training is deterministic. ``calibrate`` picks the smallest threshold that surely keeps a wanted
precision on held-out rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


@dataclass
class Boosted:
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    bias: float = 0.0
    depth: int = 3

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], axis=1)

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, out = self._binned(np.asarray(x, dtype=float)), np.full(len(x), self.bias)
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margins(x))) if len(x) else np.zeros(0)


def train(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, l2: float = 1.0) -> Boosted:
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted([np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])], [], float(np.log(prior / (1 - prior))), depth)
    b, margin, width = model._binned(x), np.full(len(y), model.bias), x.shape[1]
    flat = b + np.arange(width) * BINS
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        feature, cut, node = np.zeros(2**depth - 1, dtype=np.int64), np.full(2**depth - 1, BINS), np.zeros(len(y), dtype=np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (width * BINS) + flat).ravel()
            size = count * width * BINS
            gs = np.bincount(cell, np.repeat(g, width), size).reshape(count, width, BINS).cumsum(2)
            hs = np.bincount(cell, np.repeat(h, width), size).reshape(count, width, BINS).cumsum(2)
            gt, ht = gs[:, :, -1:], hs[:, :, -1:]
            gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
            best = gain.reshape(count, -1).argmax(1)
            feature[first : first + count], cut[first : first + count] = best // BINS, best % BINS
            node = 2 * node + 1 + (b[np.arange(len(y)), feature[node]] > cut[node])
        k = node - (2**depth - 1)
        leaf = rate * np.bincount(k, g, 2**depth) / (np.bincount(k, h, 2**depth) + l2)
        margin += leaf[k]
        model.trees.append((feature, cut, leaf))
    return model


def calibrate(score: np.ndarray, y: np.ndarray, precision: float, sure: float = 1.645) -> float:
    """The smallest threshold at which held-out rows scored at least that much have the wanted precision, by the lower end of
    its Wilson interval (``sure`` standard deviations); 1.1 if none has. Half-way down to the next score, as nothing was seen between."""
    order = np.argsort(-score, kind="stable")
    n = np.arange(1, len(y) + 1)
    right, z2 = np.cumsum(y[order]) / n, sure * sure
    least = (right + z2 / (2 * n) - sure * np.sqrt(right * (1 - right) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    good = np.flatnonzero((least >= precision) & (np.append(np.diff(score[order]), -1.0) < 0))  # rows of one score go together
    if not len(good):
        return 1.1
    at = good[-1]
    return float((score[order][at] + (score[order][at + 1] if at + 1 < len(y) else 0.0)) / 2)
