"""Candidate classifiers, class weighting and the search space.

Each candidate is a ``pyspark.ml`` pipeline builder: learned preprocessing stages
(``operators.transforms``) followed by a classifier estimator. Imbalance handling
lives inside estimators so it only ever sees the rows being fitted:

* A: L2 logistic regression; sklearn's ``C`` maps to ``regParam = 1 / (C * n)``
  with ``n`` counted at fit time;
* B: SMOTE + random forest (``operators.resample``);
* C: random forest with balanced class weights ``n / (2 * n_c)``;
* D: boosted trees with a learned side for missing values per split (``operators.boosting``)
  and ``scale_pos_weight`` = n_pass / max(n_fail, 1) as a row weight on positives, on
  un-imputed data.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field
from typing import Any, Callable

from pyspark import keyword_only
from pyspark.ml import Estimator, Pipeline, Transformer
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.boosting import HistogramBoosting
from sensor_yield.operators.resample import SmoteClassifier
from sensor_yield.operators.transforms import base_stages, native_missing_stages


class LogisticFromC(Estimator, HasFeaturesCol, HasLabelCol):
    """L2 logistic regression parameterised by the inverse strength ``C``
    (sum-of-losses convention) -> Spark's mean-loss ``regParam = 1 / (C n)``."""

    C = Param(Params._dummy(), "C", "inverse regularisation strength", TypeConverters.toFloat)
    maxIter = Param(Params._dummy(), "maxIter", "max iterations", TypeConverters.toInt)

    @keyword_only
    def __init__(self, C: float = 1.0, maxIter: int = config.LOGISTIC_MAX_ITER, featuresCol: str = "features",
                 labelCol: str = config.LABEL_COL):
        super().__init__()
        self._setDefault(C=1.0, maxIter=config.LOGISTIC_MAX_ITER, featuresCol="features", labelCol=config.LABEL_COL)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame):
        n = max(df.count(), 1)
        lr = LogisticRegression(featuresCol=self.getFeaturesCol(), labelCol=self.getLabelCol(),
                                regParam=1.0 / (self.getOrDefault(self.C) * n), elasticNetParam=0.0,
                                standardization=False, maxIter=self.getOrDefault(self.maxIter), tol=1e-6)
        return lr.fit(df)


class WeightedClassifier(Estimator, HasFeaturesCol, HasLabelCol):
    """Adds a weight column learned from the fit rows' class counts and
    fits ``classifier`` with it. ``mode='balanced'``: ``n / (2 n_c)``;
    ``mode='scale_pos'``: positives weigh ``n_pass / max(n_fail, 1)``."""

    mode = Param(Params._dummy(), "mode", "balanced | scale_pos", TypeConverters.toString)

    @keyword_only
    def __init__(self, classifier=None, mode: str = "balanced", featuresCol: str = "features",
                 labelCol: str = config.LABEL_COL):
        super().__init__()
        self.classifier = classifier
        kw = dict(self._input_kwargs)
        kw.pop("classifier", None)
        self._setDefault(mode="balanced", featuresCol="features", labelCol=config.LABEL_COL)
        self._set(**kw)

    def _fit(self, df: DataFrame):
        y = F.col(self.getLabelCol())
        c = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(y == 1).alias("n1"),
                   F.count_if(y == 0).alias("n0")).first()
        n, n1, n0 = c["n"], c["n1"], c["n0"]
        if self.getOrDefault(self.mode) == "balanced":
            w1 = n / (2.0 * n1) if n1 else 1.0
            w0 = n / (2.0 * n0) if n0 else 1.0
        else:
            w1, w0 = n0 / max(n1, 1), 1.0
        weighted = df.withColumn("__w", F.when(y == 1, F.lit(w1)).otherwise(F.lit(w0)))
        return self.classifier.copy().setWeightCol("__w").setFeaturesCol(self.getFeaturesCol()) \
            .setLabelCol(self.getLabelCol()).fit(weighted)


def positive_probability(prob_col: str = "probability") -> Column:
    """P(class 1) from the probability vector."""
    return vector_to_array(F.col(prob_col)).getItem(1)


def _depth(d: int | None) -> int:
    return config.SPARK_MAX_TREE_DEPTH if d is None else int(d)


@dataclass
class Candidate:
    """One candidate model: name, descriptive texts, preprocessing stages,
    classifier factory and search grid. The preprocessing does not depend on the
    classifier's parameters, so a search fits it once per fold."""

    name: str
    preprocessing: str
    sampling: str
    pre: Callable[[], list]
    clf: Callable[[dict[str, Any]], Estimator]
    grid: dict[str, list[Any]] = field(default_factory=dict)

    def build(self, params: dict[str, Any]) -> Pipeline:
        return Pipeline(stages=self.pre() + [self.clf(params)])

    def settings(self, n_iter: int = config.N_RANDOM_SEARCH_ITER, seed: int = config.SEED) -> list[dict[str, Any]]:
        """Up to ``n_iter`` distinct settings drawn without replacement from
        the grid (md5 order); a grid no larger than ``n_iter`` is used whole."""
        keys = sorted(self.grid)
        combos = [dict(zip(keys, vals)) for vals in itertools.product(*[self.grid[k] for k in keys])]
        if len(combos) <= n_iter:
            return combos
        import hashlib
        order = sorted(range(len(combos)),
                       key=lambda i: hashlib.md5(f"{seed}:{self.name}:{i}".encode()).hexdigest())
        return [combos[i] for i in sorted(order[:n_iter])]


def build_candidates(seed: int = config.SEED, include_boosting: bool = True,
                     grids: dict[str, dict[str, list[Any]]] | None = None) -> list[Candidate]:
    """The four candidates (A-D) with the reference search spaces (``grids``
    overrides them, e.g. a small grid in tests)."""
    grids = grids or {}
    y = config.LABEL_COL

    def forest(p):
        return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=_depth(p.get("max_depth")),
                                      minInstancesPerNode=int(p.get("min_samples_leaf", 1)),
                                      featureSubsetStrategy="sqrt", seed=seed, labelCol=y)

    def boosting(p):
        return HistogramBoosting(maxIter=int(p.get("n_estimators", 100)), maxDepth=int(p.get("max_depth", 3)),
                                 stepSize=float(p.get("learning_rate", 0.1)),
                                 subsamplingRate=float(p.get("subsample", 1.0)), scalePos=True, labelCol=y, seed=seed)

    forest_grid = {"n_estimators": list(config.FOREST_TREES_GRID), "max_depth": list(config.FOREST_DEPTH_GRID),
                   "min_samples_leaf": list(config.FOREST_MIN_LEAF_GRID)}
    m = config.MODEL_DESCRIPTIONS
    out = [
        Candidate(config.MODEL_LOGISTIC, *m[config.MODEL_LOGISTIC], lambda: base_stages(use_scaler=True),
                  lambda p: LogisticFromC(C=float(p.get("C", 1.0)), labelCol=y),
                  grids.get(config.MODEL_LOGISTIC, {"C": list(config.LOGISTIC_C_GRID)})),
        Candidate(config.MODEL_FOREST_SMOTE, *m[config.MODEL_FOREST_SMOTE], lambda: base_stages(),
                  lambda p: SmoteClassifier(classifier=forest(p), labelCol=y, seed=seed),
                  grids.get(config.MODEL_FOREST_SMOTE, forest_grid)),
        Candidate(config.MODEL_FOREST_WEIGHTS, *m[config.MODEL_FOREST_WEIGHTS], lambda: base_stages(),
                  lambda p: WeightedClassifier(classifier=forest(p), mode="balanced", labelCol=y),
                  grids.get(config.MODEL_FOREST_WEIGHTS, forest_grid)),
    ]
    if include_boosting:
        out.append(Candidate(config.MODEL_BOOSTING, *m[config.MODEL_BOOSTING], native_missing_stages, boosting,
                             grids.get(config.MODEL_BOOSTING, {
                                 "n_estimators": list(config.BOOST_ROUNDS_GRID),
                                 "max_depth": list(config.BOOST_DEPTH_GRID),
                                 "learning_rate": list(config.BOOST_RATE_GRID),
                                 "subsample": list(config.BOOST_SUBSAMPLE_GRID)})))
    return out


def scale_pos_weight(df: DataFrame, label_col: str = config.LABEL_COL) -> float:
    """M05 / A11 as a number (one aggregate)."""
    y = F.col(label_col)
    r = df.agg(F.count_if(y == 0).alias("p"), F.count_if(y == 1).alias("f")).first()
    return r["p"] / max(r["f"], 1)


__all__ = ["Candidate", "ExpressionScorer", "LogisticFromC", "WeightedClassifier", "build_candidates",
           "positive_probability", "scale_pos_weight"]


class ExpressionScorer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """A fixed scoring rule as a pipeline stage: a SQL expression over the feature
    columns gives P(Fail); emits the same ``probability`` vector as a classifier so
    every evaluation / importance path treats it like a fitted model."""

    expression = Param(Params._dummy(), "expression", "SQL expression for P(Fail)", TypeConverters.toString)
    usedCols = Param(Params._dummy(), "usedCols", "columns the expression reads", TypeConverters.toListString)

    @keyword_only
    def __init__(self, expression: str = "0.5", usedCols: list[str] | None = None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        p = F.expr(self.getOrDefault(self.expression)).cast("double")
        return df.withColumn("probability", array_to_vector(F.array(F.lit(1.0) - p, p)))
