"""Gradient-boosted trees over a table of counts.

Features are small whole numbers, so rows with equal features can be counted together by Spark: what is
left is a table (features, positives, all) bounded by the product of the features' ranges, however much data
it was counted from. Trees of depth two are fitted to it here, and scored as a Spark expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Row = tuple[tuple[int, ...], float, float]  # features, positives, all
Tree = tuple  # (feature, limit, left, right) or (value,)


def _leaf(rows: list[tuple[Row, float]], rate: float) -> tuple[float]:
    grad = sum(y - p * n for (_, y, n), p in rows)
    hess = sum(n * p * (1 - p) for (_, _, n), p in rows)
    return (rate * grad / (hess + 1.0),)


def _gain(rows: list[tuple[Row, float]]) -> float:
    grad = sum(y - p * n for (_, y, n), p in rows)
    return grad * grad / (sum(n * p * (1 - p) for (_, _, n), p in rows) + 1.0)


def _grow(rows: list[tuple[Row, float]], depth: int, rate: float) -> Tree:
    best = None
    if depth and len(rows) > 1:
        whole = _gain(rows)
        for f in range(len(rows[0][0][0])):
            by_value: dict[int, list[float]] = {}
            for (x, y, n), p in rows:
                g = by_value.setdefault(x[f], [0.0, 0.0])
                g[0] += y - p * n
                g[1] += n * p * (1 - p)
            total = [sum(g[i] for g in by_value.values()) for i in (0, 1)]
            grad = hess = 0.0
            for limit in sorted(by_value)[:-1]:
                grad += by_value[limit][0]
                hess += by_value[limit][1]
                gain = grad**2 / (hess + 1) + (total[0] - grad) ** 2 / (total[1] - hess + 1) - whole
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, f, limit)
    if best is None:
        return _leaf(rows, rate)
    _, f, limit = best
    left = [r for r in rows if r[0][0][f] <= limit]
    right = [r for r in rows if r[0][0][f] > limit]
    return (f, limit, _grow(left, depth - 1, rate), _grow(right, depth - 1, rate))


def value(tree: Tree, x: tuple[int, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def fit(rows: list[Row], trees: int = 30, depth: int = 2, rate: float = 0.4) -> list[Tree]:
    """Trees whose sum is the log odds of a positive."""
    rows = [r for r in rows if r[2] > 0]
    if not rows:
        return []
    share = (sum(r[1] for r in rows) + 0.5) / (sum(r[2] for r in rows) + 1)
    found: list[Tree] = [(math.log(share / (1 - share)),)]
    sums = [found[0][0]] * len(rows)
    for _ in range(trees):
        tree = _grow([(r, 1 / (1 + math.exp(-s))) for r, s in zip(rows, sums)], depth, rate)
        found.append(tree)
        sums = [s + value(tree, r[0]) for r, s in zip(rows, sums)]
    return found


def predict(found: list[Tree], x: tuple[int, ...]) -> float:
    return sum(value(t, x) for t in found)


def expression(found: list[Tree], names: list[str]) -> Column:
    """The same sum over columns."""

    def of(tree: Tree) -> Column:
        if len(tree) == 1:
            return F.lit(float(tree[0]))
        return F.when(F.col(names[tree[0]]) <= tree[1], of(tree[2])).otherwise(of(tree[3]))

    total = F.lit(0.0)
    for tree in found:
        total = total + of(tree)
    return total
