"""Small tree ensembles: fitted with numpy on a bounded labelled sample, applied as SQL expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int, least: int, rng: np.random.Generator | None = None, features: int | None = None):
    """Least-squares tree: ``(feature, cut, below, above)`` nested, leaves are values."""
    value = float(y.mean()) if len(y) else 0.0
    if depth == 0 or len(y) < 2 * least or np.ptp(y) == 0:
        return value
    columns = np.arange(x.shape[1])
    if features and rng is not None:
        columns = np.sort(rng.choice(columns, min(features, len(columns)), replace=False))
    best = None
    for j in columns:
        order = np.argsort(x[:, j], kind="stable")
        xs, sums = x[order, j], np.cumsum(y[order])
        n = np.arange(1, len(y))
        gain = sums[:-1] ** 2 / n + (sums[-1] - sums[:-1]) ** 2 / (len(y) - n)
        gain[(xs[1:] == xs[:-1]) | (n < least) | (len(y) - n < least)] = -np.inf
        at = int(np.argmax(gain))
        if np.isfinite(gain[at]) and (best is None or gain[at] > best[0] + 1e-9):
            best = (gain[at], int(j), float((xs[at] + xs[at + 1]) / 2))
    if best is None or best[0] <= y.sum() ** 2 / len(y) + 1e-9:
        return value
    _, j, cut = best
    below = x[:, j] <= cut
    return (j, cut, fit_tree(x[below], y[below], depth - 1, least, rng, features), fit_tree(x[~below], y[~below], depth - 1, least, rng, features))


def apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, cut, below, above = tree
    return np.where(x[:, j] <= cut, apply_tree(below, x), apply_tree(above, x))


def fit_boosting(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, least: int = 5) -> list:
    """Gradient boosting for log-odds; the score is the sum of the trees."""
    trees, score = [], np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _newton(fit_tree(x, y - p, depth, least), x, y - p, p * (1 - p), rate)
        trees.append(tree)
        score += apply_tree(tree, x)
    return trees


def _newton(tree, x: np.ndarray, residual: np.ndarray, weight: np.ndarray, rate: float):
    if not isinstance(tree, tuple):
        return rate * float(residual.sum() / (weight.sum() + 1.0))
    j, cut, below, above = tree
    m = x[:, j] <= cut
    return (j, cut, _newton(below, x[m], residual[m], weight[m], rate), _newton(above, x[~m], residual[~m], weight[~m], rate))


def fit_forest(x: np.ndarray, y: np.ndarray, count: int = 25, depth: int = 6, least: int = 3, seed: int = 7) -> list:
    """Random forest; the score is the trees' sum, ``count`` times the share of positives."""
    rng, trees = np.random.default_rng(seed), []
    features = max(1, int(np.ceil(np.sqrt(x.shape[1]))) + 1)
    for _ in range(count):
        rows = rng.integers(0, len(y), len(y))
        trees.append(fit_tree(x[rows], y[rows].astype(float), depth, least, rng, features))
    return trees


def score(trees: list, x: np.ndarray) -> np.ndarray:
    return sum(apply_tree(t, x) for t in trees)


def score_column(trees: list, row: Column, names: tuple[str, ...]) -> Column:
    """The score as one expression over a struct of double features."""

    def one(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(float(tree))
        j, cut, below, above = tree
        return F.when(row[names[j]] <= cut, one(below)).otherwise(one(above))

    total = F.lit(0.0)
    for t in trees:
        total = total + one(t)
    return total


def threshold(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score from which on at least ``precision`` of a held-out sample are positives."""
    order = np.argsort(-scores, kind="stable")
    s, hits = scores[order], np.cumsum(y[order])
    share = hits / np.arange(1, len(s) + 1)
    last = np.append(s[1:] != s[:-1], True)
    good = np.flatnonzero((share >= precision) & last)
    return float(s[good[-1]]) if len(good) else float("inf")
