"""Gradient-boosted trees with logistic loss over dense features, and isotonic calibration. Small numpy models."""

from __future__ import annotations

import dataclasses

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclasses.dataclass
class Trees:
    """Complete trees of one depth: node n has the children 2n+1 and 2n+2."""

    prior: float
    depth: int
    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # x <= cut goes left
    leaf: np.ndarray  # trees x leaves

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > c[at])
            out += v[at - (2**self.depth - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 48, l2: float = 3.0) -> Trees:
    """Newton boosting on histograms of quantile bins."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    prior = float(np.log(p / (1 - p)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    raw = np.full(len(x), prior)
    feature, cut, leaf = (np.zeros((trees, 2**depth - 1), np.int64), np.full((trees, 2**depth - 1), np.inf), np.zeros((trees, 2**depth)))
    for t in range(trees):
        q = sigmoid(raw)
        g, h = y - q, q * (1 - q)
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            base = 2**level - 1
            best = np.full(2**level, 1e-6)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                width = len(c) + 1
                key = (node - base) * width + binned[:, j]
                gs = np.bincount(key, g, 2**level * width).reshape(-1, width)
                hs = np.bincount(key, h, 2**level * width).reshape(-1, width)
                gl, hl = gs.cumsum(1)[:, :-1], hs.cumsum(1)[:, :-1]
                ga, ha = gs.sum(1, keepdims=True), hs.sum(1, keepdims=True)
                gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
                gain[(hl < 0.5) | (ha - hl < 0.5)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(2**level), k]
                for n in np.flatnonzero(top > best):
                    best[n], feature[t, base + n], cut[t, base + n] = top[n], j, c[k[n]]
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[t, node]] > cut[t, node])
        at = node - (2**depth - 1)
        leaf[t] = rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + l2)
        raw += leaf[t][at]
    return Trees(prior, depth, feature, cut, leaf)


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: the knots (score, calibrated probability) of a rising line. One pseudo-count of the base rate a block."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, v in zip(score[order].tolist(), y[order].tolist()):
        blocks.append([v, 1.0, s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            a, b = blocks.pop(-2), blocks.pop(-1)
            blocks.append([a[0] + b[0], a[1] + b[1], a[2], b[3]])
    rate = float(y.mean())
    xs, ps = [], []
    for total, n, lo, hi in blocks:
        p = (total + rate) / (n + 1)
        xs += [lo, hi]
        ps += [p, p]
    return np.array(xs), np.maximum.accumulate(np.array(ps))


def calibrated(raw: np.ndarray, knots: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The calibrated probability; a thousandth of the raw one keeps the order within a flat part."""
    return np.clip(0.999 * np.interp(raw, *knots) + 0.001 * sigmoid(raw), 0, 1)
