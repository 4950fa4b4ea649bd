"""Gradient-boosted regression trees for logistic loss in numpy, kept as flat node arrays, and isotonic calibration.

Fitting takes a bounded sample on the driver. Scoring walks all trees of a batch at once, level by level.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth as arrays (tree, node); node i has the children 2i + 1 and 2i + 2.

    A node that was not split has an infinite threshold, so that all rows go left, also NaN ones.
    """

    base: float
    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Summed leaf values for each row, in blocks of rows that bound the memory."""
        out = np.full(len(x), self.base)
        trees = np.arange(len(self.feature))
        for at in range(0, len(x), 4096):
            block = x[at : at + 4096]
            node = np.zeros((len(block), len(trees)), np.int32)
            rows = np.arange(len(block))[:, None]
            for _ in range(self.depth):
                right = block[rows, self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + right
            out[at : at + 4096] += self.value[trees, node - (2**self.depth - 1)].sum(axis=1)
        return out


def _bins(x: np.ndarray, n_bins: int) -> list[np.ndarray]:
    """Cut points of each feature: midpoints of its quantiles' neighbours."""
    cuts = []
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        if len(values) > n_bins:
            values = np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins)))
        cuts.append((values[1:] + values[:-1]) / 2)
    return cuts


def fit_forest(
    x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 3, rate: float = 0.15, n_bins: int = 64, ridge: float = 1.0, least: float = 2.0, monotone: dict[int, int] | None = None
) -> Forest:
    """Newton boosting over histograms.

    monotone: feature -> 1 (the score must not fall as it grows) or -1. A split that would break the order is not
    taken, and both sides' values are bounded by the midpoint in all that lies below.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    n, k = x.shape
    share = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    inner, leaves = 2**depth - 1, 2**depth
    if n == 0 or y.min() == y.max():
        return Forest(base, depth, np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
    monotone = monotone or {}
    cuts = _bins(x, n_bins)
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    offsets = np.arange(k) * n_bins
    flat = (binned + offsets).astype(np.int64)
    feature, threshold, value = [], [], []
    score = np.full(n, base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        f, t = np.zeros(inner, np.int32), np.full(inner, np.inf)
        low, high = np.full(2 * leaves, -np.inf), np.full(2 * leaves, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first = 2**level - 1
            for i in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == i)
                best = _split(flat[rows], grad[rows], hess[rows], cuts, n_bins, k, ridge, least, monotone, low[i], high[i]) if len(rows) else None
                lo, hi = low[i], high[i]
                left, right = 2 * i + 1, 2 * i + 2
                low[left] = low[right] = lo
                high[left] = high[right] = hi
                if best is None:
                    node[rows] = left
                    continue
                j, cut, mid = best
                f[i], t[i] = j, cuts[j][cut]
                if sign := monotone.get(j, 0):
                    (high if sign > 0 else low)[left] = mid
                    (low if sign > 0 else high)[right] = mid
                node[rows] = np.where(binned[rows, j] > cut, right, left)
        leaf = node - inner
        g, h = np.bincount(leaf, grad, leaves), np.bincount(leaf, hess, leaves)
        v = rate * np.clip(-g / (h + ridge), low[inner : inner + leaves], high[inner : inner + leaves])
        score = score + v[leaf]
        feature.append(f)
        threshold.append(t)
        value.append(v)
    return Forest(base, depth, np.array(feature), np.array(threshold), np.array(value))


def _split(flat, grad, hess, cuts, n_bins, k, ridge, least, monotone, low, high):
    """The best (feature, cut, value between both sides), or None."""
    idx = flat.ravel()
    g = np.bincount(idx, np.repeat(grad, k), k * n_bins).reshape(k, n_bins).cumsum(axis=1)
    h = np.bincount(idx, np.repeat(hess, k), k * n_bins).reshape(k, n_bins).cumsum(axis=1)
    g_all, h_all = g[:, -1:], h[:, -1:]
    left = np.clip(-g / (h + ridge), low, high)
    right = np.clip(-(g_all - g) / (h_all - h + ridge), low, high)
    whole = np.clip(-g_all / (h_all + ridge), low, high)
    loss = lambda gg, hh, v: gg * v + 0.5 * (hh + ridge) * v * v
    gain = loss(g_all, h_all, whole) - loss(g, h, left) - loss(g_all - g, h_all - h, right)
    allowed = (h >= least) & (h_all - h >= least)
    for j in range(k):
        allowed[j, len(cuts[j]) :] = False
        if sign := monotone.get(j, 0):
            allowed[j] &= sign * (right[j] - left[j]) >= 0
    gain = np.where(allowed, gain, -np.inf)
    j, cut = divmod(int(gain.argmax()), n_bins)
    if not gain[j, cut] > 1e-6:
        return None
    return j, cut, (left[j, cut] + right[j, cut]) / 2


@dataclass
class Isotonic:
    """A rising step-wise linear map from margins to shares of label 1."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        if len(self.x) == 0:
            return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return np.clip(np.interp(margin, self.x, self.y), 0.0, 1.0)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; rows of equal margin are pooled first. Blocks are smoothed by one row of the mean."""
    if len(margin) == 0:
        return Isotonic(np.zeros(0), np.zeros(0))
    values, where = np.unique(margin, return_inverse=True)
    weight = np.bincount(where).astype(float)
    total = np.bincount(where, y.astype(float))
    blocks: list[list[float]] = []  # weight, sum, first x, last x
    for w, t, v in zip(weight, total, values, strict=True):
        blocks.append([w, t, v, v])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, t2, _, last = blocks.pop()
            blocks[-1][0] += w2
            blocks[-1][1] += t2
            blocks[-1][3] = last
    mean = float(y.mean())
    xs, ys = [], []
    for w, t, first, last in blocks:
        share = (t + mean) / (w + 1)
        xs += [first, last] if last > first else [first]
        ys += [share, share] if last > first else [share]
    return Isotonic(np.array(xs), np.maximum.accumulate(np.array(ys)))


def auc(score: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    order = np.argsort(score, kind="stable")
    _, where, count = np.unique(score[order], return_inverse=True, return_counts=True)
    rank = np.empty(len(score))
    rank[order] = (np.cumsum(count) - (count - 1) / 2)[where]
    ones = y.sum()
    return float((rank[y == 1].sum() - ones * (ones + 1) / 2) / max(1, ones * (len(y) - ones)))
