"""Gradient-boosted trees with native missing values.

Second-order boosting of the logistic loss on histograms:

1. candidate thresholds per feature: all distinct values where there are at most ``maxBins``, else
   quantiles; a row becomes one binary column of bin numbers, 0 for a missing value;
2. per tree level one job: every task adds its rows' gradients and hessians into (node, feature, bin) sums
   with numpy; these are dealt by feature, added up, and running sums over the bins give the gain of every
   threshold with the missing rows on the right and on the left. The driver sees one best split per node
   and task;
3. the children's sums are their leaf values, so a tree of depth d takes d jobs. Margins are recomputed from
   the trees since they were last written (every ``REFRESH`` trees).

Up to ``LOCAL_VALUES`` values (rows x features) a job a level costs far more than its sums: all trees are then grown
in one task, by the same steps, so the trees are the same.

Gradients are added as whole numbers of 2^-bits, so the sums do not depend on how rows are partitioned or in
which order tasks end, and reruns give the same trees. Gains that tie go to the first feature, then to the
lowest threshold, then to missing right.
"""

from __future__ import annotations

import json
import math
from collections import namedtuple
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.trees import Tree, TreeArrays, ensemble_value, new_tree, split_leaf
from sensor_yield.session import cut_lineage

#: Trees after which the margins are written.
REFRESH = 25
#: Rows that a task adds at once; their sums stay exact in double.
CHUNK = 4096
#: Rows x features up to which one task grows all trees.
LOCAL_VALUES = 1 << 22
#: Cells (node, feature, bin) that such a task looks at at once, about.
LOCAL_CELLS = 1 << 18
HISTOGRAM = "node int, feature int, bin int, g bigint, h bigint, n bigint"
Split = namedtuple("Split", "node feature bin missing_left gain g_left h_left g_right h_right n_left n_right")
SPLITS = ("node int, feature int, bin int, missing_left boolean, gain double, g_left double, h_left double, g_right double, "
          "h_right double, n_left bigint, n_right bigint")


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Evenly spread 64 bits of a key and a seed."""
    h = keys.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15) & ((1 << 64) - 1))
    for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def threshold_candidates(rows: DataFrame, max_bins: int) -> list[list[float]]:
    """Sorted thresholds of every position of the array column ``x``; a value goes right from the
    threshold on, so the least value is none. At most ``max_bins`` per position."""
    long = rows.select(F.posexplode("x").alias("i", "v")).where(~F.isnan("v"))
    steps = [s / max_bins for s in range(max_bins + 1)]
    stats = {r.i: r for r in long.groupBy("i").agg(
        F.approx_count_distinct("v", 0.02).alias("kinds"), F.min("v").alias("least"),
        F.percentile_approx("v", steps, 100 * max_bins).alias("q")).collect()}  # one row per feature
    few = [i for i, r in stats.items() if r.kinds <= max_bins * 1.5]
    exact = {r.i: r.values for r in long.where(F.col("i").isin(few)).groupBy("i")
             .agg(F.sort_array(F.collect_set("v")).alias("values")).collect()} if few else {}
    out = []
    for i in range(max(stats, default=-1) + 1):
        r = stats.get(i)
        values = exact.get(i, r.q if r else [])
        if len(values) > max_bins + 1:
            values = r.q
        out.append([v for v in sorted(set(values)) if v > r.least] if r else [])
    return out


def binned(rows: DataFrame, cuts: list[list[float]]) -> DataFrame:
    """``key, y, w, bins``: bin numbers as 16-bit integers, 0 = missing, 1 = below the first threshold."""
    def place(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            bins = np.stack([np.where(np.isnan(x[:, f]), 0, 1 + np.searchsorted(c, x[:, f], side="right"))
                             for f, c in enumerate(cuts)], axis=1).astype("<u2")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "y", "w")),
                                              pa.array([r.tobytes() for r in bins], pa.binary())],
                                             names=["key", "y", "w", "bins"])

    return rows.mapInArrow(place, "key bigint, y double, w double, bins binary")


def _bins_of(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, d).astype(np.int64)


def _as_values(bins: np.ndarray) -> np.ndarray:
    """Bin numbers as a tree on bins sees them: NaN for missing."""
    return np.where(bins == 0, np.nan, bins)


def _margins(trees: list[Tree], d: int):
    """Adds the trees' values to the margins."""
    def add(batches):
        for batch in batches:
            more = ensemble_value(trees, _as_values(_bins_of(batch.column("bins"), d)))
            at = batch.schema.get_field_index("margin")
            yield batch.set_column(at, "margin", pa.array(batch.column("margin").to_numpy() + more))

    return add


def _sampled(keys: np.ndarray, subsample: float, seed: int) -> np.ndarray:
    """Which rows a tree sees."""
    if subsample >= 1.0:
        return np.ones(len(keys), bool)
    return _mixed(keys, seed) < np.uint64(int(subsample * 2.0 ** 64))


def _gradients(margin: np.ndarray, y: np.ndarray, w: np.ndarray, scale: float) -> tuple:
    """First and second derivatives as whole numbers, and None for a count."""
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint(w * (p - y) * scale), np.rint(w * p * (1 - p) * scale), None


def _add(sums: list[np.ndarray], node: np.ndarray, bins: np.ndarray, width: int, gradients: tuple) -> None:
    """Adds rows to their (node, feature, bin) cells."""
    d = bins.shape[1]
    at = ((node[:, None] * d + np.arange(d)) * width + bins).ravel()
    for total, each in zip(sums, gradients):
        total += np.bincount(at, None if each is None else np.repeat(each, d), len(total)).astype(np.int64)


def _histogram(trees: list[Tree], tree: Tree, active: list[int], d: int, width: int, scale: float, subsample: float, seed: int):
    """(node, feature, bin) sums of the rows that stand at the ``active`` leaves of ``tree``."""
    def fold(batches):
        number = np.full(len(tree["feature"]), -1)
        number[active] = np.arange(len(active))
        cells = len(active) * d * width
        sums = [np.zeros(cells, np.int64) for _ in range(3)]
        for batch in batches:
            for s in range(0, len(batch), CHUNK):
                part = batch.slice(s, CHUNK)
                if subsample < 1.0:
                    part = part.filter(pa.array(_sampled(part.column("key").to_numpy(), subsample, seed)))
                bins = _bins_of(part.column("bins"), d)
                node = number[TreeArrays(tree).leaves(_as_values(bins))]
                kept = node >= 0
                bins, node = bins[kept], node[kept]
                margin = part.column("margin").to_numpy()[kept] + ensemble_value(trees, _as_values(bins))
                y, w = part.column("y").to_numpy()[kept], part.column("w").to_numpy()[kept]
                _add(sums, node, bins, width, _gradients(margin, y, w, scale))
        found = np.flatnonzero(sums[2])
        columns = [found // (d * width), found // width % d, found % width]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in columns), *(pa.array(t[found]) for t in sums)],
                                         names=["node", "feature", "bin", "g", "h", "n"])

    return fold


def _splits(nodes: int, d: int, width: int, scale: float, reg_lambda: float, min_child_weight: float, best_only: bool):
    """Admissible splits of the features whose (node, feature, bin) sums come to this task, or each node's best."""
    def find(batches):
        sums = np.zeros((3, nodes * d * width), np.int64)
        for batch in batches:
            node, feature, bin_ = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            for i in range(3):
                np.add.at(sums[i], (node * d + feature) * width + bin_, batch.column(3 + i).to_numpy())
        node, feature, bin_, side, *values = _found(sums.reshape(3, nodes, d, width), scale, reg_lambda, min_child_weight, best_only)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(x.astype(np.int32)) for x in (node, feature, bin_)), pa.array(side), *map(pa.array, values)],
            names=Split._fields)

    return find


def _found(cells: np.ndarray, scale: float, reg_lambda: float, min_child_weight: float, best_only: bool) -> list[np.ndarray]:
    """The admissible splits by (node, feature, bin) sums, or each node's best, in the columns of ``SPLITS``. A split
    stands after a bin that holds rows, so only those are looked at."""
    d, width = cells.shape[2:]
    whole, missing, flat = cells.sum(axis=3).reshape(3, -1), cells[..., 0].reshape(3, -1), cells.reshape(3, -1)
    held = np.flatnonzero(flat[2])
    held = held[held % width > 0]
    group = held // width  # node and feature
    heads = np.flatnonzero(np.diff(group, prepend=-1))
    running = np.cumsum(flat[:, held], axis=1)  # whole numbers: what wraps around comes back
    before = np.where(heads > 0, running[:, heads - 1], 0) if len(heads) else running
    up_to = running - np.repeat(before, np.diff(heads, append=len(held)), axis=1)
    # the last axis: missing values on the right, on the left
    left = np.stack([up_to, up_to + missing[:, group]], axis=-1)
    right = whole[:, group][..., None] - left
    (gl, hl, nl), (gr, hr, nr) = ((x[0] / scale, x[1] / scale, x[2]) for x in (left, right))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = 0.5 * (gl * gl / (hl + reg_lambda) + gr * gr / (hr + reg_lambda)
                      - (gl + gr) ** 2 / (hl + hr + reg_lambda))
    able = (nl > 0) & (nr > 0) & (hl >= min_child_weight) & (hr >= min_child_weight)
    able[:, 1] &= missing[2, group] > 0  # else both sides are the same
    at = np.flatnonzero(able)
    node = group[at // 2] // d
    if best_only and len(at):
        starts = np.flatnonzero(np.diff(node, prepend=-1))
        most = np.repeat(np.maximum.reduceat(gain.ravel()[at], starts), np.diff(starts, append=len(at)))
        top = np.flatnonzero(gain.ravel()[at] == most)
        top = top[np.diff(node[top], prepend=-1) != 0]  # the first of equals
        at, node = at[top], node[top]
    return [node, group[at // 2] % d, held[at // 2] % width, at % 2 == 1, *(x.ravel()[at] for x in (gain, gl, hl, gr, hr, nl, nr))]


def _growth(depth: int, lam: float, eta: float, min_gain: float) -> Callable:
    """Grows a tree on bin numbers, by the splits offered for the open nodes of each level: thresholds lie half-way
    between the last bin on the left and the next."""
    def grow(splits: Callable[[Tree, list[int]], Iterable[Split]]) -> Tree:
        tree, active = new_tree(), [0]
        for _ in range(depth):
            best: dict = {}
            for r in splits(tree, active):
                key = (-r.gain, r.feature)
                if r.node not in best or key < best[r.node][0]:
                    best[r.node] = (key, r)
            grown = []
            for i, node in enumerate(active):
                s = best.get(i, (None, None))[1]
                if s is None or s.gain <= min_gain:
                    continue
                kids = [(-eta * g / (h + lam), float(n)) for g, h, n in
                        ((s.g_left, s.h_left, s.n_left), (s.g_right, s.h_right, s.n_right))]
                tree["cover"][node] = float(s.n_left + s.n_right)
                grown += split_leaf(tree, node, s.feature, s.bin + 0.5, s.missing_left, *kids)
            if not grown:
                break
            active = grown
        return tree

    return grow


def _local_trees(batches: list[pa.RecordBatch], seeds: list[int], growth: Callable, d: int, width: int, scale: float,
                 subsample: float, reg_lambda: float, min_child_weight: float) -> list[Tree]:
    """The trees on the rows of ``batches``, one per seed; margins are added up in the order of the distributed steps."""
    if not batches:
        return [new_tree() for _ in seeds]
    key, y, w = (np.concatenate([b.column(c).to_numpy() for b in batches]) for c in ("key", "y", "w"))
    bins = np.concatenate([_bins_of(b.column("bins"), d) for b in batches])
    values = _as_values(bins)
    margin, since = np.zeros(len(y)), np.zeros(len(y))
    trees: list[Tree] = []
    for seed in seeds:
        seen = np.flatnonzero(_sampled(key, subsample, seed))
        gradients = _gradients((margin + since)[seen], y[seen], w[seen], scale)

        def splits(tree: Tree, active: list[int]) -> Iterable[Split]:
            number = np.full(len(tree["feature"]), -1)
            number[active] = np.arange(len(active))
            node = number[TreeArrays(tree).leaves(values[seen])]
            kept = np.flatnonzero(node >= 0)
            step = max(1, LOCAL_CELLS // (len(active) * width))
            for f in range(0, d, step):
                part = bins[:, f:f + step]
                sums = [np.zeros(len(active) * part.shape[1] * width, np.int64) for _ in range(3)]
                for s in range(0, len(kept), CHUNK):
                    at = kept[s:s + CHUNK]
                    _add(sums, node[at], part[seen[at]], width, tuple(None if g is None else g[at] for g in gradients))
                cells = np.stack(sums).reshape(3, len(active), part.shape[1], width)
                found = _found(cells, scale, reg_lambda, min_child_weight, True)
                found[1] = found[1] + f
                yield from map(Split, *(x.tolist() for x in found))

        tree = growth(splits)
        trees.append(tree)
        since += ensemble_value([tree], values)
        if len(trees) % REFRESH == 0:
            margin, since = margin + since, np.zeros(len(y))
    return trees


class HistogramBoosting(Estimator, HasFeaturesCol, HasLabelCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees on a vector column in which NaN is a missing value. ``scalePos`` weighs rows of class 1 by
    n_0 / max(n_1, 1) of the fitted rows. Fields: see the parameters."""

    maxIter = Param(Params._dummy(), "maxIter", "number of trees", TypeConverters.toInt)
    maxDepth = Param(Params._dummy(), "maxDepth", "depth of a tree", TypeConverters.toInt)
    stepSize = Param(Params._dummy(), "stepSize", "shrinkage of leaf values", TypeConverters.toFloat)
    subsamplingRate = Param(Params._dummy(), "subsamplingRate", "share of the rows that each tree sees", TypeConverters.toFloat)
    regLambda = Param(Params._dummy(), "regLambda", "added to the hessian sum of a leaf", TypeConverters.toFloat)
    minGain = Param(Params._dummy(), "minGain", "a split must gain more", TypeConverters.toFloat)
    minChildWeight = Param(Params._dummy(), "minChildWeight", "least hessian sum of a child", TypeConverters.toFloat)
    maxBins = Param(Params._dummy(), "maxBins", "thresholds per feature (below 65,000)", TypeConverters.toInt)
    scalePos = Param(Params._dummy(), "scalePos", "weigh class 1 by the class ratio", TypeConverters.toBoolean)
    idCol = Param(Params._dummy(), "idCol", "row id, for subsampling", TypeConverters.toString)

    @keyword_only
    def __init__(self, maxIter: int = 100, maxDepth: int = 3, stepSize: float = 0.3, subsamplingRate: float = 1.0,
                 regLambda: float = 1.0, minGain: float = 1e-6, minChildWeight: float = 1.0, maxBins: int = 256,
                 scalePos: bool = False, idCol: str = config.ROW_ID_COL, featuresCol: str = "features",
                 labelCol: str = config.LABEL_COL, seed: int = config.SEED):
        super().__init__()
        self._setDefault(maxIter=100, maxDepth=3, stepSize=0.3, subsamplingRate=1.0, regLambda=1.0, minGain=1e-6,
                         minChildWeight=1.0, maxBins=256, scalePos=False, idCol=config.ROW_ID_COL, featuresCol="features",
                         labelCol=config.LABEL_COL, seed=config.SEED)
        self._set(**self._input_kwargs)

    def _get(self, name: str):
        return self.getOrDefault(getattr(self, name))

    def weighted_rows(self, df: DataFrame) -> tuple[DataFrame, int, float]:
        """key, y, w, x of the rows with a class, their number and the greatest weight."""
        y = F.col(self.getLabelCol())
        c = df.agg(F.count_if(y == 1).alias("n1"), F.count_if(y == 0).alias("n0")).first()
        w1 = c.n0 / max(c.n1, 1) if self._get("scalePos") else 1.0
        rows = df.where(y.isin(0, 1)).select(
            F.xxhash64(self._get("idCol")).alias("key"), y.cast("double").alias("y"),
            F.when(y == 1, F.lit(float(w1))).otherwise(F.lit(1.0)).alias("w"),
            vector_to_array(self.getFeaturesCol()).alias("x"))
        return rows, c.n0 + c.n1, max(w1, 1.0)

    @staticmethod
    def scale_of(n: int, most: float) -> float:
        """How finely gradients are kept: the sum of all stays below 2^62, that of a chunk below 2^52."""
        bits = 62 - max(22, n.bit_length()) - max(0, math.ceil(math.log2(most)))
        return 2.0 ** bits

    def _fit(self, df: DataFrame) -> "HistogramBoostingModel":
        rows, n, most = self.weighted_rows(df)
        cuts = threshold_candidates(rows, self._get("maxBins"))
        d, scale = len(cuts), self.scale_of(n, most)
        width = 2 + max(map(len, cuts), default=0)
        if not d or not n:
            return self._model([], cuts)
        growth = _growth(self._get("maxDepth"), self._get("regLambda"), self._get("stepSize"), self._get("minGain"))
        if n * d <= LOCAL_VALUES:
            return self._model(self._grown_locally(binned(rows, cuts), growth, d, width, scale), cuts)
        data = cut_lineage(binned(rows, cuts).withColumn("margin", F.lit(0.0))).persist()
        trees: list[Tree] = []
        written = 0
        try:
            for round_ in range(self._get("maxIter")):
                since = trees[written:]
                trees.append(growth(lambda tree, active: self.splits(data, since, tree, active, round_, d, width, scale,
                                                                     True).collect()))  # per open node and task
                if len(trees) - written >= REFRESH and round_ + 1 < self._get("maxIter"):
                    old, data = data, cut_lineage(data.mapInArrow(_margins(trees[written:], d), data.schema)).persist()
                    old.unpersist()
                    written = len(trees)
        finally:
            data.unpersist()
        return self._model(trees, cuts)

    def _round_seed(self, round_: int) -> int:
        return self.getSeed() * 1_000_003 + round_

    def _grown_locally(self, data: DataFrame, growth: Callable, d: int, width: int, scale: float) -> list[Tree]:
        """All trees, grown in one task."""
        params = [self._get(name) for name in ("subsamplingRate", "regLambda", "minChildWeight")]
        seeds = [self._round_seed(round_) for round_ in range(self._get("maxIter"))]

        def grow(batches):
            trees = _local_trees(list(batches), seeds, growth, d, width, scale, *params)
            yield pa.RecordBatch.from_arrays([pa.array([json.dumps(trees)])], names=["trees"])

        return json.loads(data.repartition(1).mapInArrow(grow, "trees string").collect()[0].trees)

    def splits(self, data: DataFrame, trees: list[Tree], tree: Tree, active: list[int], round_: int, d: int, width: int,
               scale: float, best_only: bool) -> DataFrame:
        """Splits of the ``active`` leaves of ``tree`` after ``trees``: all, or the best ones of each task."""
        parts = data.mapInArrow(_histogram(trees, tree, active, d, width, scale, self._get("subsamplingRate"),
                                           self._round_seed(round_)), HISTOGRAM)
        find = _splits(len(active), d, width, scale, self._get("regLambda"), self._get("minChildWeight"), best_only)
        return parts.repartition("feature").mapInArrow(find, SPLITS)

    def root_splits(self, df: DataFrame) -> DataFrame:
        """Every admissible split of the first tree's first node; ``threshold`` is NULL where all present values go left."""
        rows, n, most = self.weighted_rows(df)
        cuts = threshold_candidates(rows, self._get("maxBins"))
        scale, width = self.scale_of(n, most), 2 + max(map(len, cuts), default=0)
        data = binned(rows, cuts).withColumn("margin", F.lit(0.0))
        gains = self.splits(data, [], new_tree(), [0], 0, len(cuts), width, scale, False)
        # at most maxBins thresholds per feature
        names = df.sparkSession.createDataFrame([(f, b, c) for f, each in enumerate(cuts) for b, c in enumerate(each, 1)],
                                                "feature int, bin int, threshold double")
        return gains.join(F.broadcast(names), ["feature", "bin"], "left")

    def _model(self, trees: list[Tree], cuts: list[list[float]]) -> "HistogramBoostingModel":
        """Thresholds back from bin numbers to values; beyond the last one everything present goes left."""
        for t in trees:
            t["threshold"] = [((cuts[f] + [math.inf])[min(int(b) - 1, len(cuts[f]))] if f >= 0 else 0.0)
                              for f, b in zip(t["feature"], t["threshold"])]
        model = HistogramBoostingModel(trees=json.dumps(trees), numFeatures=len(cuts))
        return model._set(featuresCol=self.getFeaturesCol())


class HistogramBoostingModel(Model, HasFeaturesCol, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``margin`` (log odds) and the ``probability`` vector."""

    trees = Param(Params._dummy(), "trees", "the trees as JSON", TypeConverters.toString)
    numFeatures = Param(Params._dummy(), "numFeatures", "length of the feature vector", TypeConverters.toInt)

    def __init__(self, trees: str = "[]", numFeatures: int = 0):
        super().__init__()
        self._setDefault(featuresCol="features")
        self._set(trees=trees, numFeatures=numFeatures)

    def tree_list(self) -> list[Tree]:
        return json.loads(self.getOrDefault(self.trees))

    def _transform(self, df: DataFrame) -> DataFrame:
        trees = self.tree_list()

        def margin(x):
            return pd.Series(ensemble_value(trees, np.stack(x.to_numpy())) if len(x) else np.zeros(0))

        margin.__annotations__ = {"x": pd.Series, "return": pd.Series}
        scored = df.withColumn("margin", F.pandas_udf(margin, "double")(vector_to_array(self.getFeaturesCol())))
        p = 1.0 / (1.0 + F.exp(-F.col("margin")))
        return scored.withColumn("probability", array_to_vector(F.array(1.0 - p, p)))
