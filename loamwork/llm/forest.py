"""A random forest for two classes in numpy: bootstrap rows, random feature subsets, Gini splits at quantiles."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # -1 in leaves
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    share: np.ndarray  # of class 1


class Forest:
    def __init__(self, trees: list[Tree]):
        self.trees = trees

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Mean share of class 1 of each row's leaves."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = t.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                go_left = x[rows, np.maximum(f, 0)] <= t.threshold[at]
                at = np.where(inner, np.where(go_left, t.left[at], t.right[at]), at)
            total += t.share[at]
        return total / len(self.trees)


def _best_split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int, cuts: int) -> tuple[int, float] | None:
    best, found = np.inf, None
    n, ones = len(y), y.sum()
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, hits = x[order, f], np.cumsum(y[order])
        ends = np.flatnonzero(v[1:] > v[:-1]) + 1  # rows on the left
        ends = ends[(ends >= least) & (ends <= n - least)]
        if len(ends) > cuts:
            ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
        if len(ends):
            p, q = hits[ends - 1] / ends, (ones - hits[ends - 1]) / (n - ends)
            cost = ends * p * (1 - p) + (n - ends) * q * (1 - q)
            k = int(np.argmin(cost))
            if cost[k] < best:
                best, found = cost[k], (int(f), float((v[ends[k] - 1] + v[ends[k]]) / 2))
    return found


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, cuts: int = 32, seed: int = 1) -> Forest:
    rng, made = np.random.default_rng(seed), []
    wide = max(1, int(np.sqrt(x.shape[1])))
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        feature, threshold, left, right, share = [], [], [], [], []

        def node(rows: np.ndarray, level: int) -> int:
            me = len(feature)
            for column, value in ((feature, -1), (threshold, 0.0), (left, 0), (right, 0), (share, float(y[rows].mean()))):
                column.append(value)
            if level < depth and len(rows) >= 2 * least and 0 < share[me] < 1:
                split = _best_split(x[rows], y[rows], rng.permutation(x.shape[1])[:wide], least, cuts)
                if split:
                    goes = x[rows, split[0]] <= split[1]
                    feature[me], threshold[me] = split
                    left[me] = node(rows[goes], level + 1)
                    right[me] = node(rows[~goes], level + 1)
            return me

        node(rows, 0)
        made.append(Tree(*(np.array(c) for c in (feature, threshold, left, right, share))))
    return Forest(made)
