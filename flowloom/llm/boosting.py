"""Gradient-boosted trees in numpy: training on a bounded sample, scoring from flat node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees as arrays of the same shape (trees, nodes); leaves point at themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    prior: float

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Log-odds of each row; all trees step down together."""
        n, trees = len(rows), len(self.feature)
        if not trees or not n:
            return np.full(n, self.prior)
        at = np.zeros((n, trees), dtype=np.int32)
        tree = np.arange(trees)[None, :]
        row = np.arange(n)[:, None]
        for _ in range(self.depth):
            goes_left = rows[row, self.feature[tree, at]] <= self.threshold[tree, at]
            at = np.where(goes_left, self.left[tree, at], self.right[tree, at])
        return self.prior + self.value[tree, at].sum(axis=1)


@dataclass(frozen=True)
class Recipe:
    """Training parameters; ``monotone`` gives +1, -1 or 0 for each feature."""

    monotone: tuple[int, ...]
    trees: int = 60
    depth: int = 4
    bins: int = 64
    rate: float = 0.2
    ridge: float = 1.0
    least_rows: int = 10


class _Grower:
    """Grows one tree over binned features, level by level in recursion."""

    def __init__(self, binned: np.ndarray, edges: list[np.ndarray], recipe: Recipe) -> None:
        self.binned, self.edges, self.recipe = binned, edges, recipe

    def grow(self, gradient: np.ndarray, hessian: np.ndarray) -> list[tuple]:
        self.gradient, self.hessian = gradient, hessian
        self.nodes: list[list] = []
        self._node(np.arange(len(gradient)), 0, -np.inf, np.inf)
        return [tuple(n) for n in self.nodes]

    def _weight(self, g: float | np.ndarray, h: float | np.ndarray):
        return -g / (h + self.recipe.ridge)

    def _node(self, rows: np.ndarray, depth: int, low: float, high: float) -> int:
        """``low`` and ``high`` bound every leaf below, so that constraints hold across levels."""
        g, h = self.gradient[rows].sum(), self.hessian[rows].sum()
        place = len(self.nodes)
        value = float(np.clip(self._weight(g, h), low, high))
        self.nodes.append([0, np.inf, place, place, value])
        best = self._split(rows, g, h, low, high) if depth < self.recipe.depth else None
        if best is None:
            return place
        feature, cut, left_value, right_value = best
        goes_left = self.binned[rows, feature] <= cut
        sign = self.recipe.monotone[feature]
        middle = (left_value + right_value) / 2
        left_range = (low, min(high, middle)) if sign > 0 else (max(low, middle), high) if sign < 0 else (low, high)
        right_range = (max(low, middle), high) if sign > 0 else (low, min(high, middle)) if sign < 0 else (low, high)
        left = self._node(rows[goes_left], depth + 1, *left_range)
        right = self._node(rows[~goes_left], depth + 1, *right_range)
        self.nodes[place] = [feature, float(self.edges[feature][cut]), left, right, 0.0]
        return place

    def _split(self, rows, g, h, low, high):
        ridge, least = self.recipe.ridge, self.recipe.least_rows
        best, most = None, 1e-6
        for feature, edges in enumerate(self.edges):
            if not len(edges):
                continue
            bins = self.binned[rows, feature]
            size = len(edges) + 1
            gl = np.cumsum(np.bincount(bins, self.gradient[rows], size))[:-1]
            hl = np.cumsum(np.bincount(bins, self.hessian[rows], size))[:-1]
            nl = np.cumsum(np.bincount(bins, minlength=size))[:-1]
            left = np.clip(self._weight(gl, hl), low, high)
            right = np.clip(self._weight(g - gl, h - hl), low, high)

            def loss(gs, hs, w):
                return gs * w + 0.5 * (hs + ridge) * w * w

            whole = np.clip(self._weight(g, h), low, high)
            gain = loss(g, h, whole) - loss(gl, hl, left) - loss(g - gl, h - hl, right)
            gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
            gain[self.recipe.monotone[feature] * (right - left) < 0] = -np.inf
            k = int(np.argmax(gain))
            if gain[k] > most:
                most, best = gain[k], (feature, k, float(left[k]), float(right[k]))
        return best


def train(rows: np.ndarray, labels: np.ndarray, recipe: Recipe) -> FlatTrees:
    """Boosted logistic regression trees; a sample of one class gives no trees and its prior alone."""
    n = len(labels)
    share = (labels.sum() + 0.5) / (n + 1)
    prior = float(np.log(share / (1 - share)))
    empty = np.zeros((0, 1))
    if n == 0 or labels.min() == labels.max():
        return FlatTrees(empty.astype(int), empty, empty.astype(int), empty.astype(int), empty, recipe.depth, prior)
    edges = []
    for k in range(rows.shape[1]):
        cuts = np.unique(np.quantile(rows[:, k], np.linspace(0, 1, recipe.bins + 1)[1:-1], method="lower"))
        edges.append(cuts[cuts < rows[:, k].max()])
    binned = np.stack([np.searchsorted(e, rows[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    grower = _Grower(binned, edges, recipe)
    margin = np.full(n, prior)
    grown = []
    for _ in range(recipe.trees):
        p = 1 / (1 + np.exp(-margin))
        nodes = grower.grow(p - labels, np.maximum(p * (1 - p), 1e-6))
        nodes = [(f, t, a, b, v * recipe.rate) for f, t, a, b, v in nodes]
        grown.append(nodes)
        margin += flatten([nodes], recipe.depth, 0.0).scores(rows)
    return flatten(grown, recipe.depth, prior)


def flatten(trees: list[list[tuple]], depth: int, prior: float) -> FlatTrees:
    width = max(map(len, trees))
    shape = (len(trees), width)
    feature, left, right = (np.zeros(shape, dtype=np.int32) for _ in range(3))
    threshold, value = np.full(shape, np.inf), np.zeros(shape)
    for t, nodes in enumerate(trees):
        for k, (f, cut, a, b, v) in enumerate(nodes):
            feature[t, k], threshold[t, k], left[t, k], right[t, k], value[t, k] = f, cut, a, b, v
    return FlatTrees(feature, threshold, left, right, value, depth, prior)
