"""Gradient boosted trees: fitted on arrays or, by sums alone, on all rows of a DataFrame, scored as DataFrame expressions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: A leaf's value, or (feature, threshold, left, right): left if the feature is at most the threshold.
Tree = float | tuple[int, float, "Tree", "Tree"]
#: Gradients are added up as whole multiples of 1 / UNIT, so sums don't depend on the order of rows.
UNIT = 1 << 20


@dataclass
class BoostedTrees:
    features: list[str]
    base: float = 0.0
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((_apply(t, x) for t in self.trees), np.zeros(len(x)))

    def probability(self, columns: dict[str, Column]) -> Column:
        """The model as one expression over the features' columns."""
        total = reduce(lambda a, b: a + b, (_expression(t, [columns[f] for f in self.features]) for t in self.trees), F.lit(float(self.base)))
        return 1.0 / (1.0 + F.exp(-total))


def _apply(tree: Tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, threshold, left, right = tree
    return np.where(x[:, feature] <= threshold, _apply(left, x), _apply(right, x))


def _expression(tree: Tree, columns: list[Column]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(columns[feature] <= float(threshold), _expression(left, columns)).otherwise(_expression(right, columns))


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, rate: float, cuts: list[np.ndarray]) -> Tree:
    g, h = gradient.sum(), hessian.sum()
    leaf = rate * g / (h + 1.0)
    if not depth or len(x) < 8:
        return leaf
    best, choice = 1e-6, None
    for f, values in enumerate(cuts):
        for t in values:
            left = x[:, f] <= t
            gl, hl = gradient[left].sum(), hessian[left].sum()
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
            if gain > best:
                best, choice = gain, (f, t, left)
    if choice is None:
        return leaf
    f, t, left = choice
    return (f, float(t), _grow(x[left], gradient[left], hessian[left], depth - 1, rate, cuts), _grow(x[~left], gradient[~left], hessian[~left], depth - 1, rate, cuts))


def fit(features: list[str], x: np.ndarray, y: np.ndarray, rounds: int = 20, depth: int = 2, rate: float = 0.3) -> BoostedTrees:
    """Logistic loss. Without rows, or with one kind of label, the model is a constant."""
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = BoostedTrees(features, float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, 12)))[:-1] for f in range(x.shape[1])]
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = _grow(x, y - p, p * (1 - p), depth, rate, cuts)
        model.trees.append(tree)
        margin += _apply(tree, x)
    return model


def _node(splits: dict[int, tuple[int, int]], columns: list[Column], node: int = 1) -> Column:
    """The node that a row has reached; those below node k are 2 * k and 2 * k + 1."""
    if node not in splits:
        return F.lit(node)
    feature, cut = splits[node]
    return F.when(columns[feature] <= cut, _node(splits, columns, 2 * node)).otherwise(_node(splits, columns, 2 * node + 1))


def _best(sums: dict[tuple[int, int], tuple[int, int]], cuts: list[list[float]], g: float, h: float) -> tuple[int, int, tuple[float, float]] | None:
    """The feature and cut that gain most, and the sums left of it. ``sums`` has gradient and hessian by feature and bin."""
    best, choice = 1e-6, None
    for f, values in enumerate(cuts):
        gl = hl = 0.0
        for t in range(len(values)):
            more = sums.get((f, t), (0, 0))
            gl, hl = gl + more[0] / UNIT, hl + more[1] / UNIT
            gain = gl * gl / (hl + 1.0) + (g - gl) ** 2 / (h - hl + 1.0) - g * g / (h + 1.0)
            if gain > best:
                best, choice = gain, (f, t, (gl, hl))
    return choice


def fit_rows(features: list[str], rows: DataFrame, rounds: int = 20, depth: int = 2, rate: float = 0.3) -> BoostedTrees:
    """As :func:`fit`, on all rows of a DataFrame: a row stands for ``n`` equal examples, of which ``y`` are labelled 1.

    Cuts are exact quantiles. Only sums by node, feature and bin reach the driver,
    as many as there are bins however many rows there are.
    """
    total, true = (v or 0 for v in rows.agg(F.sum("n"), F.sum("y")).first())
    share = (true + 0.5) / (total + 1.0)
    model = BoostedTrees(features, float(np.log(share / (1 - share))))
    if not 0 < true < total:
        return model
    steps = F.array(*(F.lit(float(q)) for q in np.linspace(0, 1, 12)))
    cuts = [sorted(set(values))[:-1] for values in rows.agg(*(F.percentile(f, steps, F.col("n")) for f in features)).first()]
    bins = [reduce(lambda a, b: a + b, ((F.col(f) > c).cast("int") for c in values), F.lit(0)).alias(f"bin{i}") for i, (f, values) in enumerate(zip(features, cuts))]
    names = [f"bin{i}" for i in range(len(features))]
    binned = written(rows.select(*bins, "n", "y").groupBy(*names).agg(F.sum("n").alias("n"), F.sum("y").alias("y")), "boosting-bins")
    columns = [F.col(c) for c in names]
    of_bins = BoostedTrees(names, model.base)
    for _ in range(rounds):
        p = F.col("p")
        part = binned.withColumn("p", of_bins.probability(dict(zip(names, columns))))
        part = part.withColumns({"g": F.col("y") * UNIT - F.col("n") * F.round(p * UNIT).cast("long"), "h": F.col("n") * F.round(p * (1 - p) * UNIT).cast("long")})
        splits: dict[int, tuple[int, int]] = {}
        leaves: dict[int, tuple[float, float]] = {}
        for level in range(depth):
            reached = part.withColumn("node", _node(splits, columns)).where(F.col("node") >= 1 << level)
            found = reached.select("node", "g", "h", "n", F.posexplode(F.array(*columns))).groupBy("node", "pos", "col").agg(F.sum("g"), F.sum("h"), F.sum("n")).collect()
            by_node: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
            size: dict[int, int] = {}
            for node, f, b, g, h, n in found:
                by_node.setdefault(node, {})[f, b] = g, h
                size[node] = size.get(node, 0) + (n if f == 0 else 0)
            for node, sums in by_node.items():
                g, h = (sum(v[i] for (f, _), v in sums.items() if f == 0) / UNIT for i in (0, 1))
                leaves[node] = g, h
                if size[node] >= 8 and (choice := _best(sums, cuts, g, h)):
                    f, t, (gl, hl) = choice
                    splits[node] = f, t
                    leaves |= {2 * node: (gl, hl), 2 * node + 1: (g - gl, h - hl)}

        def grown(node: int, cut: Callable[[int, int], float]) -> Tree:
            if node not in splits:
                g, h = leaves[node]
                return rate * g / (h + 1.0)
            f, t = splits[node]
            return (f, cut(f, t), grown(2 * node, cut), grown(2 * node + 1, cut))

        of_bins.trees.append(grown(1, lambda f, t: t))
        model.trees.append(grown(1, lambda f, t: float(cuts[f][t])))
    return model


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest probability from which on the share of true labels is at least ``precision``; 2 if there is none."""
    order = np.argsort(-p, kind="stable")
    p, y = p[order], y[order]
    if not len(p):
        return 2.0
    right = np.cumsum(y) / np.arange(1, len(y) + 1)
    last = np.append(p[1:] != p[:-1], True)
    good = np.flatnonzero(last & (right >= precision))
    return float(p[good[-1]]) if len(good) else 2.0
