"""Decision trees as arrays, applied to whole batches.

A tree is a dictionary of equally long lists: ``feature`` (-1 at leaves), ``threshold``, ``missing_left``,
``left``, ``right`` (node numbers), ``value`` and ``cover`` (weight of the rows that were fitted there). A row
goes left where its value lies below the threshold; a missing value (NaN) goes where ``missing_left`` says.
The lists are JSON-ready, so fitted ensembles can be saved as one parameter.
"""

from __future__ import annotations

import math
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tree = dict[str, list]
FIELDS = ("feature", "threshold", "missing_left", "left", "right", "value", "cover")


def new_tree(value: float = 0.0, cover: float = 0.0) -> Tree:
    """A single leaf."""
    return {"feature": [-1], "threshold": [0.0], "missing_left": [False], "left": [-1], "right": [-1],
            "value": [value], "cover": [cover]}


def split_leaf(tree: Tree, node: int, feature: int, threshold: float, missing_left: bool,
               left: tuple[float, float], right: tuple[float, float]) -> tuple[int, int]:
    """Turns a leaf into a split; ``left`` and ``right`` are (value, cover) of the new leaves."""
    kids = []
    for value, cover in (left, right):
        kids.append(len(tree["feature"]))
        for name, entry in zip(FIELDS, (-1, 0.0, False, -1, -1, value, cover)):
            tree[name].append(entry)
    for name, entry in (("feature", feature), ("threshold", threshold), ("missing_left", missing_left),
                        ("left", kids[0]), ("right", kids[1])):
        tree[name][node] = entry
    return kids[0], kids[1]


class TreeArrays:
    """One tree as numpy arrays."""

    def __init__(self, tree: Tree):
        self.feature = np.asarray(tree["feature"], np.int64)
        self.threshold = np.asarray(tree["threshold"], np.float64)
        self.missing_left = np.asarray(tree["missing_left"], bool)
        self.left, self.right = np.asarray(tree["left"], np.int64), np.asarray(tree["right"], np.int64)
        self.value, self.cover = np.asarray(tree["value"], np.float64), np.asarray(tree["cover"], np.float64)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``x`` (rows x features, NaN = missing)."""
        node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        while len(rows):
            rows = rows[self.feature[node[rows]] >= 0]
            at = node[rows]
            v = x[rows, self.feature[at]]
            below = np.where(np.isnan(v), self.missing_left[at], v < self.threshold[at])
            node[rows] = np.where(below, self.left[at], self.right[at])
        return node

    def paths(self) -> list[tuple[int, list[tuple[int, bool]]]]:
        """(leaf, [(node on the way, went left)]) of every leaf."""
        out, open_ = [], [(0, [])]
        while open_:
            node, way = open_.pop()
            if self.feature[node] < 0:
                out.append((node, way))
            else:
                open_ += [(self.left[node], [*way, (node, True)]), (self.right[node], [*way, (node, False)])]
        return out


def ensemble_value(trees: list[Tree], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for t in map(TreeArrays, trees):
        total += t.value[t.leaves(x)]
    return total


def _leaf_value(kind: str, node: Any, weight: float) -> float:
    if kind == "forest":
        stats = node.impurityStats().stats()
        total = sum(stats)
        return weight * (stats[1] / total if total else 0.0)
    return weight * node.prediction()


def spark_trees(model) -> tuple[list[Tree], str]:
    """The trees of a fitted Spark forest or boosted ensemble, and what their values add up to: P(class 1) for
    a forest, the margin (half the log odds) for boosted trees. Spark sends a value to the left up to and
    including its threshold, so thresholds move to the next number above."""
    kind = "forest" if model._java_obj.getClass().getSimpleName().startswith("RandomForest") else "margin"
    weights = list(model.treeWeights)
    share = 1.0 / sum(weights) if kind == "forest" else 1.0
    out = []
    for java_tree, weight in zip(model._java_obj.trees(), weights):
        tree = new_tree()
        open_ = [(java_tree.rootNode(), 0)]
        while open_:
            node, at = open_.pop()
            tree["cover"][at] = float(node.impurityStats().count())
            if node.subtreeDepth() == 0:
                tree["value"][at] = _leaf_value(kind, node, weight * share)
                continue
            split = node.split()
            left, right = split_leaf(tree, at, int(split.featureIndex()), math.nextafter(split.threshold(), math.inf), False,
                                     (0.0, 0.0), (0.0, 0.0))
            open_ += [(node.leftChild(), left), (node.rightChild(), right)]
        out.append(tree)
    return out, "probability" if kind == "forest" else "margin"


# --------------------------------------------------------------------- attribution


def _legendre(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on [0, 1]."""
    t, w = np.polynomial.legendre.leggauss(points)
    return (t + 1) / 2, w / 2


def tree_attribution(tree: TreeArrays, x: np.ndarray, n_features: int) -> np.ndarray:
    """Path-dependent Shapley values of one tree (rows x features).

    In a coalition S a leaf counts with the product over its path's features of 1 or 0 (the row takes the
    leaf's side, for features in S) or of the cover shares (for the others). With o and z for these two, the
    Shapley weights of all coalitions of a feature's partners add up to the integral over [0, 1] of the
    product of o t + z (1 - t); that is a polynomial, so a Gauss rule of half its degree is exact."""
    out = np.zeros((len(x), n_features))
    missing = np.isnan(x)
    for leaf, way in tree.paths():
        if not way:
            continue
        share: dict[int, float] = {}
        takes: dict[int, np.ndarray] = {}
        for node, left in way:
            f = int(tree.feature[node])
            child = tree.left[node] if left else tree.right[node]
            share[f] = share.get(f, 1.0) * (tree.cover[child] / tree.cover[node] if tree.cover[node] else 0.0)
            below = np.where(missing[:, f], tree.missing_left[node], x[:, f] < tree.threshold[node])
            takes[f] = takes.get(f, True) & (below == left)
        names = list(share)
        z = np.array([share[f] for f in names])[:, None]
        o = np.stack([takes[f] for f in names]).astype(float)
        for t, w in zip(*_legendre((len(names) + 1) // 2)):
            factor = o * t + z * (1 - t)
            ahead, behind = np.ones_like(factor), np.ones_like(factor)
            ahead[1:] = np.cumprod(factor[:-1], axis=0)
            behind[:-1] = np.cumprod(factor[:0:-1], axis=0)[::-1]
            out[:, names] += ((o - z) * ahead * behind * (w * tree.value[leaf])).T
    return out


def expected_value(trees: list[Tree]) -> float:
    """The ensemble's mean over the fitted rows: leaves weighed by the shares along their paths."""
    total = 0.0
    for t in map(TreeArrays, trees):
        for leaf, way in t.paths():
            p = math.prod((t.cover[t.left[n] if left else t.right[n]] / t.cover[n] if t.cover[n] else 0.0) for n, left in way)
            total += p * t.value[leaf]
    return total


def attributions(rows: DataFrame, id_col: str, trees: list[Tree], n_features: int, vector: str = "x",
                 chunk: int = 512) -> DataFrame:
    """Exact attributions of every row of ``rows`` (an array column ``vector``, NaN = missing):
    ``id_col, phi`` (array, one value per feature). Rows stay where they are; ``chunk`` bounds what a task holds."""
    import pyarrow as pa

    def explain(batches):
        arrays = [TreeArrays(t) for t in trees]
        for batch in batches:
            flat = batch.column(1)
            for s in range(0, len(batch), chunk):
                x = flat.slice(s, chunk).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n_features)
                phi = np.zeros((len(x), n_features))
                for tree in arrays:
                    phi += tree_attribution(tree, x, n_features)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s, chunk), pa.array(list(phi), pa.list_(pa.float64()))],
                                                 names=[id_col, "phi"])

    ids = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(vector)).mapInArrow(explain, f"`{id_col}` {ids}, phi array<double>")
