"""Small gradient boosted trees over binned features with row weights, and the paths through them as rules."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Node:
    """A leaf has ``value`` only; an inner node sends rows with feature <= cut to ``low``."""

    value: float = 0.0
    feature: int = -1
    cut: float = 0.0
    low: Node | None = None
    high: Node | None = None


@dataclass
class Boosted:
    base: float
    trees: list[Node] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_values(t, x) for t in self.trees), np.zeros(len(x)))


def sigmoid(m: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def _values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, _values(node.low, x), _values(node.high, x))


def _cuts(column: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between the values, or between quantiles where there are many values."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def _grow(x, cuts, g, h, rows, depth, rate, least, ridge) -> Node:
    gs, hs = g[rows].sum(), h[rows].sum()
    best = (1e-6, -1, 0.0)
    if depth:
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            place = np.searchsorted(points, x[rows, f], side="left")
            gl = np.cumsum(np.bincount(place, g[rows], len(points) + 1))[:-1]
            hl = np.cumsum(np.bincount(place, h[rows], len(points) + 1))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least) | (hs - hl < least)] = 0
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (gain[k], f, points[k])
    if best[1] < 0:
        return Node(value=float(-rate * gs / (hs + ridge)))
    goes = x[rows, best[1]] <= best[2]
    return Node(0.0, best[1], float(best[2]), *(
        _grow(x, cuts, g, h, rows[side], depth - 1, rate, least, ridge) for side in (goes, ~goes)))


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = 24, depth: int = 3, rate: float = 0.3,
        bins: int = 64, least: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Logistic boosting; ``y`` may be fractions (of positive rows in an aggregated cell)."""
    p = np.clip(np.average(y, weights=weight) if weight.sum() else 0.5, 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(p / (1 - p))))
    if not len(x):
        return model
    cuts = [_cuts(x[:, f], bins) for f in range(x.shape[1])]
    margin = np.full(len(x), model.base)
    for _ in range(trees):
        q = sigmoid(margin)
        tree = _grow(x, cuts, weight * (q - y), weight * q * (1 - q), np.arange(len(x)), depth, rate, least, ridge)
        model.trees.append(tree)
        margin += _values(tree, x)
    return model


Rule = tuple[tuple[int, bool, float], ...]   # (feature, goes low, cut) of every step


def rules(model: Boosted) -> list[Rule]:
    """All paths from a root to a node below it, without those that repeat."""
    found: dict[Rule, None] = {}

    def walk(node: Node, path: Rule) -> None:
        if path:
            found.setdefault(tuple(sorted(set(path))))
        if node.feature >= 0:
            walk(node.low, (*path, (node.feature, True, node.cut)))
            walk(node.high, (*path, (node.feature, False, node.cut)))

    for tree in model.trees:
        walk(tree, ())
    return list(found)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for feature, low, cut in rule:
        out &= (x[:, feature] <= cut) == low
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, lasso: float = 0.0, ridge: float = 0.0,
             steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradient; ``lasso`` sets weights to exactly 0."""
    total = max(weight.sum(), 1e-9)
    z = np.hstack([x, np.ones((len(x), 1))]).astype(float)
    size = 4 / max(np.linalg.norm(z * np.sqrt(weight / total)[:, None], 2) ** 2 + 4 * ridge, 1e-9)
    w = look = np.zeros(z.shape[1])
    t = 1.0
    for _ in range(steps):
        g = z.T @ (weight * (sigmoid(z @ look) - y)) / total
        g[:-1] += ridge * look[:-1]
        new = look - size * g
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * lasso, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w[:-1], float(w[-1])
