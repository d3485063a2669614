"""Small regression trees: a forest of averaged ones, and boosted ones for a logistic loss. Driver-side fits on bounded,
labelled samples; the fitted trees are plain tuples that score NumPy rows or become one SQL expression."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: A leaf is a number; a node is (feature, threshold, tree where value <= threshold, tree elsewhere).
Tree = float | tuple


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, depth: int, min_weight: float, pick: Callable[[], np.ndarray] | None = None, ridge: float = 0.0) -> Tree:
    """The tree that lowers the weighted squared error greedily; `pick` gives the features a node may use."""
    total, mass = float((w * y).sum()), float(w.sum())
    leaf = total / (mass + ridge) if mass + ridge else 0.0
    if not depth or mass < 2 * min_weight or len(y) < 2 or (y == y[0]).all():
        return leaf
    best, found = total**2 / (mass + ridge) + 1e-12, None
    for f in pick() if pick else range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, s, m = x[order, f], np.cumsum((w * y)[order]), np.cumsum(w[order])
        ends = np.flatnonzero(v[:-1] < v[1:])
        if not len(ends):
            continue
        s, m = s[ends], m[ends]
        gain = s**2 / (m + ridge) + (total - s) ** 2 / (mass - m + ridge)
        gain[(m < min_weight) | (mass - m < min_weight)] = -np.inf
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, found = gain[k], (int(f), float((v[ends[k]] + v[ends[k] + 1]) / 2))
    if not found:
        return leaf
    low = x[:, found[0]] <= found[1]
    return (*found, grow(x[low], y[low], w[low], depth - 1, min_weight, pick, ridge), grow(x[~low], y[~low], w[~low], depth - 1, min_weight, pick, ridge))


def apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, a, b = tree
    low = x[:, f] <= t
    out = np.empty(len(x))
    out[low], out[~low] = apply(a, x[low]), apply(b, x[~low])
    return out


def forest(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 10, seed: int = 0) -> list[Tree]:
    """A random forest for y in {0, 1}: bootstrap rows, a random root-sized set of features at each node."""
    rng = np.random.default_rng(seed)
    some = max(1, int(np.sqrt(x.shape[1]) + 1))
    out = []
    for _ in range(n_trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        used = w > 0
        out.append(grow(x[used], y[used].astype(float), w[used], depth, 2.0, lambda: rng.choice(x.shape[1], some, replace=False)))
    return out


def vote(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    return np.mean([apply(t, x) for t in trees], axis=0) if len(x) else np.zeros(0)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.25) -> list[Tree]:
    """Boosted trees by Newton steps on the logistic loss; their sum is the log odds. The first is the base rate."""
    p = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    out: list[Tree] = [float(np.log(p / (1 - p)))]
    score = np.full(len(y), out[0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        hess = np.maximum(p * (1 - p), 1e-6)
        tree = scale(grow(x, (y - p) / hess, hess, depth, 1.0, ridge=1.0), rate)
        score += apply(tree, x)
        out.append(tree)
    return out


def scale(tree: Tree, by: float) -> Tree:
    return (*tree[:2], scale(tree[2], by), scale(tree[3], by)) if isinstance(tree, tuple) else tree * by


def sql(tree: Tree, feature: Callable[[int], str]) -> str:
    """The tree as SQL text over the values that `feature` names."""
    if not isinstance(tree, tuple):
        return f"{float(tree)!r}D"
    f, t, a, b = tree
    return f"if({feature(f)} <= {float(t)!r}D, {sql(a, feature)}, {sql(b, feature)})"


def calibrate(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold on held-out scores from which the share of true ones, smoothed by one false one, is at least `precision`."""
    order = np.argsort(-score, kind="stable")
    true = np.cumsum(y[order])
    ok = true / (np.arange(1, len(y) + 1) + 1) >= precision
    last = np.ones(len(y), bool)
    last[:-1] = score[order][:-1] > score[order][1:]  # a threshold takes all rows of a score
    good = np.flatnonzero(ok & last)
    return float(score[order][good[-1]]) if len(good) else float("inf")
