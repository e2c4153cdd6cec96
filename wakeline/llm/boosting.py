"""Gradient-boosted trees with logistic loss over binned features, and isotonic calibration, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


def fit_trees(x: np.ndarray, y: np.ndarray, w: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.15, l2: float = 1.0) -> dict:
    """Complete trees of one depth: feature and threshold of each inner node (x > threshold goes right), leaf values."""
    w = w / w.mean()
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    p0 = np.clip((w * y).sum() / w.sum(), 1e-6, 1 - 1e-6)
    start = float(np.log(p0 / (1 - p0)))
    margin = np.full(len(y), start)
    feature, cut, leaf = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(y), int)
        f_tree, c_tree = np.zeros(2**depth - 1, int), np.full(2**depth - 1, np.inf)
        for level in range(depth):
            k = 2**level
            best = np.zeros(k)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                n_bins = len(e) + 1
                at = node * n_bins + code[:, j]
                g = np.bincount(at, grad, k * n_bins).reshape(k, n_bins).cumsum(axis=1)
                h = np.bincount(at, hess, k * n_bins).reshape(k, n_bins).cumsum(axis=1)
                gt, ht = g[:, -1:], h[:, -1:]
                gain = g[:, :-1] ** 2 / (h[:, :-1] + l2) + (gt - g[:, :-1]) ** 2 / (ht - h[:, :-1] + l2) - gt**2 / (ht + l2)
                b = gain.argmax(axis=1)
                v = gain[np.arange(k), b]
                for i in np.flatnonzero(v > best + 1e-9):
                    best[i] = v[i]
                    f_tree[k - 1 + i], c_tree[k - 1 + i] = j, e[b[i]]
            node = 2 * node + (x[np.arange(len(y)), f_tree[k - 1 + node]] > c_tree[k - 1 + node])
        g, h = np.bincount(node, grad, 2**depth), np.bincount(node, hess, 2**depth)
        value = rate * g / (h + l2)
        margin += value[node]
        feature.append(f_tree), cut.append(c_tree), leaf.append(value)
    return {"start": start, "depth": depth, "feature": np.array(feature), "cut": np.array(cut), "leaf": np.array(leaf)}


def margins(x: np.ndarray, model: dict) -> np.ndarray:
    out, rows = np.full(len(x), model["start"]), np.arange(len(x))
    for f, c, v in zip(model["feature"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), int)
        for level in range(model["depth"]):
            k = 2**level - 1 + node
            node = 2 * node + (x[rows, f[k]] > c[k])
        out += v[node]
    return out


def fit_isotonic(score: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: places and non-decreasing values, interpolated between."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []  # weight, mean, first and last place
    for s, t, u in zip(score[order], y[order], w[order], strict=True):
        blocks.append([u, float(t), s, s])
        while len(blocks) > 1 and (blocks[-2][1] >= blocks[-1][1] or blocks[-2][3] == blocks[-1][2]):
            b, a = blocks.pop(), blocks[-1]
            a[1] = (a[0] * a[1] + b[0] * b[1]) / (a[0] + b[0])
            a[0] += b[0]
            a[3] = b[3]
    at = np.array([p for b in blocks for p in (b[2], b[3])])
    value = np.array([b[1] for b in blocks for _ in range(2)])
    return at, value


def calibrated(score: np.ndarray, curve: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    return np.clip(np.interp(score, *curve), 0.0, 1.0)
