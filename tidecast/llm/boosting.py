"""Gradient-boosted trees for small feature matrices, with monotonic constraints.

Trees are complete binary trees in flat arrays: the children of node ``i`` are
``2 i + 1`` and ``2 i + 2``, and a node that was not split sends every row left.
Scoring is one array lookup a level for all rows and trees at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    feature: np.ndarray    # (trees, inner nodes)
    threshold: np.ndarray
    value: np.ndarray      # (trees, leaves)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += value[at - inner]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64,
        rate: float = 0.2, ridge: float = 1.0, least_rows: int = 20) -> Trees:
    """Logistic boosting on quantile bins.

    ``monotone`` has +1, -1 or 0 for each feature.  A split that would go
    against its sign is not taken, and the middle of its two values bounds all
    values below it.
    """
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(y), start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    width = x.shape[1]
    flat = binned + np.arange(width) * bins
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(len(y), np.int64)
        bound = {0: (-np.inf, np.inf)}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            lo, hi = bound[i]
            bound[2 * i + 1] = bound[2 * i + 2] = (lo, hi)
            best = None
            if len(rows) >= 2 * least_rows:
                sums = [np.bincount(flat[rows].ravel(), np.repeat(w, width), width * bins).reshape(width, bins).cumsum(1)
                        for w in (g[rows], h[rows], np.ones(len(rows)))]
                (gl, hl, nl), (ga, ha, na) = sums, (g[rows].sum(), h[rows].sum(), len(rows))
                wl = np.clip(-gl / (hl + ridge), lo, hi)
                wr = np.clip(-(ga - gl) / (ha - hl + ridge), lo, hi)
                loss = lambda w, gs, hs: gs * w + 0.5 * (hs + ridge) * w * w
                gain = loss(np.clip(-ga / (ha + ridge), lo, hi), ga, ha) - loss(wl, gl, hl) - loss(wr, ga - gl, ha - hl)
                open_ = (nl >= least_rows) & (na - nl >= least_rows) & (monotone[:, None] * (wr - wl) >= 0)
                open_ &= np.arange(bins)[None, :] < np.array([len(c) for c in cuts])[:, None]
                gain = np.where(open_, gain, -np.inf)
                f, b = np.unravel_index(gain.argmax(), gain.shape)
                if gain[f, b] > 1e-6:
                    best = f, b, wl[f, b], wr[f, b]
            if best is None:
                node[rows] = 2 * i + 1
                continue
            f, b, left, right = best
            feature[t, i], threshold[t, i] = f, cuts[f][b]
            node[rows] = 2 * i + 1 + (binned[rows, f] > b)
            middle = (left + right) / 2
            if monotone[f] > 0:
                bound[2 * i + 1], bound[2 * i + 2] = (lo, middle), (middle, hi)
            elif monotone[f] < 0:
                bound[2 * i + 1], bound[2 * i + 2] = (middle, hi), (lo, middle)
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        w = -gs / (hs + ridge)
        for k in range(leaves):
            w[k] = np.clip(w[k], *bound[inner + k])
        value[t] = rate * w
        margin += value[t][leaf]
    return Trees(feature, threshold, value, start)
