"""Gradient-boosted regression trees on the logistic loss, for small models fitted on a bounded sample.

The sample is fitted where it lies (the driver, a few thousand rows); the model is a tuple of flat NumPy
arrays, so it travels to tasks as a constant of a few kilobytes and scores whole column batches at once.
"""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0) -> dict:
    """Trees of 2^depth leaves over quantile-binned features."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    raw = np.full(len(y), base)
    inner = 2**depth - 1
    features, limits, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, limit = np.zeros(inner, int), np.full(inner, np.inf)
        node = np.zeros(len(y), int)
        for k in range(inner):
            at = node == k
            if at.any():
                f, cut = _best_split(binned[at], grad[at], hess[at], cuts, l2)
                if f is not None:
                    feature[k], limit[k] = f, cut
            node = np.where(at, 2 * k + 1 + (x[:, feature[k]] > limit[k]), node)
        leaf = node - inner
        g = np.bincount(leaf, grad, inner + 1)
        h = np.bincount(leaf, hess, inner + 1)
        value = rate * g / (h + l2)
        raw = raw + value[leaf]
        features.append(feature), limits.append(limit), leaves.append(value)
    return {"base": base, "depth": depth, "feature": np.array(features), "limit": np.array(limits), "leaf": np.array(leaves)}


def _best_split(binned, grad, hess, cuts, l2):
    total_g, total_h = grad.sum(), hess.sum()
    best = (1e-6, None, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        g = np.bincount(binned[:, f], grad, len(cut) + 1).cumsum()[:-1]
        h = np.bincount(binned[:, f], hess, len(cut) + 1).cumsum()[:-1]
        gain = g**2 / (h + l2) + (total_g - g) ** 2 / (total_h - h + l2) - total_g**2 / (total_h + l2)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (gain[k], f, cut[k])
    return best[1], best[2]


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probabilities of a feature matrix."""
    x = np.asarray(x, float)
    if not len(x):
        return np.zeros(0)
    raw = np.full(len(x), model["base"])
    rows = np.arange(len(x))
    inner = 2 ** model["depth"] - 1
    for feature, limit, leaf in zip(model["feature"], model["limit"], model["leaf"]):
        node = np.zeros(len(x), int)
        for _ in range(model["depth"]):
            node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
        raw += leaf[node - inner]
    return 1 / (1 + np.exp(-raw))


def calibrated_threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on the precision on (scores, y) is at least `precision`; above all scores if none."""
    order = np.argsort(-scores, kind="stable")
    hits = np.cumsum(y[order] > 0)
    good = hits / np.arange(1, len(y) + 1) >= precision
    last = np.append(scores[order][1:] < scores[order][:-1], True)  # only between different scores
    ok = np.flatnonzero(good & last)
    if not len(ok):
        return 1.1
    k = ok[-1]
    below = scores[order][k + 1] if k + 1 < len(scores) else 0.0
    return float((scores[order][k] + below) / 2)
