"""Gradient-boosted trees on binned columns, with monotonic constraints and flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees in shared arrays; a leaf points at itself, so ``depth`` steps reach a leaf from any root."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row; not-a-number goes right."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.threshold[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        return self.bias + self.value[at].sum(1)


def bin_edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner edges of each column: quantiles between distinct values."""
    return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(c) else np.empty(0) for c in x.T]


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 48, penalty: float = 1.0, least: int = 8) -> FlatTrees:
    """Logistic boosting. ``monotone`` has +1, -1 or 0 for each column: the score may not fall, rise, or is free."""
    edges = bin_edges(x, bins)
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], 1) if len(x) else np.zeros(x.shape, int)
    n_bins = max((len(e) for e in edges), default=0) + 1
    share = min(max((y.sum() + 0.5) / (len(y) + 1), 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    score = np.full(len(y), bias)

    def node(v: float) -> int:
        k = len(feature)
        feature.append(0), threshold.append(np.inf), left.append(k), right.append(k), value.append(v)
        return k

    def best_split(rows: np.ndarray, g: np.ndarray, h: np.ndarray, low: float, high: float):
        found = (1e-6, -1, 0, 0.0, 0.0)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        clip = lambda v: np.clip(v, low, high)
        gain_of = lambda s, t, v: -(2 * s * v + (t + penalty) * v * v)  # noqa: E731  of a leaf of value v
        own = gain_of(total_g, total_h, clip(-total_g / (total_h + penalty)))
        for j, e in enumerate(edges):
            if not len(e):
                continue
            b = binned[rows, j]
            gl, hl, nl = (np.cumsum(np.bincount(b, w, n_bins))[: len(e)] for w in (g[rows], h[rows], None))
            gr, hr, nr = total_g - gl, total_h - hl, len(rows) - nl
            vl, vr = clip(-gl / (hl + penalty)), clip(-gr / (hr + penalty))
            gain = gain_of(gl, hl, vl) + gain_of(gr, hr, vr) - own
            gain[(nl < least) | (nr < least) | (monotone[j] * (vr - vl) < 0)] = -1
            k = int(gain.argmax())
            if gain[k] > found[0]:
                found = (gain[k], j, k, vl[k], vr[k])
        return found

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, v: float, low: float, high: float, levels: int) -> int:
        me = node(0.0)
        _, j, k, vl, vr = best_split(rows, g, h, low, high) if levels and len(rows) >= 2 * least else (0, -1, 0, 0, 0)
        if j < 0:
            value[me] = rate * v
            score[rows] += value[me]
            return me
        to_left = binned[rows, j] <= k
        middle = (vl + vr) / 2
        bounds = {1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle)), 0: ((low, high), (low, high))}[int(monotone[j])]
        feature[me], threshold[me] = j, float(edges[j][k])
        left[me] = grow(rows[to_left], g, h, vl, *bounds[0], levels - 1)
        right[me] = grow(rows[~to_left], g, h, vr, *bounds[1], levels - 1)
        return me

    for _ in range(trees if len(y) else 0):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, p * (1 - p)
        start = float(-g.sum() / (h.sum() + penalty))
        roots.append(grow(np.arange(len(y)), g, h, start, -np.inf, np.inf, depth))
    as_int = lambda a: np.array(a, np.int64)
    return FlatTrees(as_int(feature), np.array(threshold), as_int(left), as_int(right), np.array(value), as_int(roots), depth, bias)
