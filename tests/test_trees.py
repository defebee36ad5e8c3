"""Trees as arrays and exact attributions: all coalitions by enumeration, sums, Spark's own ensembles."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sensor_yield.operators import importance as imp
from sensor_yield.operators.boosting import HistogramBoosting
from sensor_yield.operators.transforms import FeatureAssembler
from sensor_yield.operators.trees import (TreeArrays, ensemble_value, expected_value, new_tree, spark_trees, split_leaf,
                                          tree_attribution)


def random_tree(rng, n_features, depth):
    tree = new_tree(cover=float(rng.integers(500, 1000)))
    open_ = [(0, 0)]
    while open_:
        node, level = open_.pop()
        if level == depth or (level and rng.random() < 0.2):
            continue
        left = float(rng.integers(1, max(2, int(tree["cover"][node]))))
        kids = split_leaf(tree, node, int(rng.integers(n_features)), float(rng.normal()), bool(rng.random() < 0.5),
                          (rng.normal(), left), (rng.normal(), max(1.0, tree["cover"][node] - left)))
        tree["cover"][node] = tree["cover"][kids[0]] + tree["cover"][kids[1]]
        open_ += [(k, level + 1) for k in kids]
    return tree


def conditional(t: TreeArrays, x, known, node=0):
    """The tree's value when only the features in ``known`` are given."""
    f = t.feature[node]
    if f < 0:
        return t.value[node]
    if f in known:
        below = t.missing_left[node] if math.isnan(x[f]) else x[f] < t.threshold[node]
        return conditional(t, x, known, t.left[node] if below else t.right[node])
    return sum(t.cover[k] / t.cover[node] * conditional(t, x, known, k) for k in (t.left[node], t.right[node]))


def enumerated(t, x, d):
    phi = np.zeros(d)
    for i in range(d):
        rest = [j for j in range(d) if j != i]
        for size in range(d):
            weight = math.factorial(size) * math.factorial(d - size - 1) / math.factorial(d)
            for s in itertools.combinations(rest, size):
                phi[i] += weight * (conditional(t, x, {*s, i}) - conditional(t, x, set(s)))
    return phi


@pytest.mark.parametrize("d,depth", [(1, 3), (3, 2), (5, 6), (8, 5)])
def test_equals_all_coalitions(d, depth):
    rng = np.random.default_rng(d)
    for _ in range(4):
        tree = random_tree(rng, d, depth)
        t = TreeArrays(tree)
        x = rng.normal(size=(5, d))
        x[rng.random(x.shape) < 0.2] = np.nan
        phi = tree_attribution(t, x, d)
        assert np.allclose(phi, [enumerated(t, r, d) for r in x], atol=1e-9)
        assert np.allclose(phi.sum(1), ensemble_value([tree], x) - expected_value([tree]), atol=1e-9)


def sensor_rows(spark, n=300, missing=0.0):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 4))
    y = (x[:, 1] + 0.5 * x[:, 3] > 0.8).astype(int)
    x[rng.random(x.shape) < missing] = np.nan
    rows = [(i, int(c), *[None if math.isnan(v) else float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "row_id long, Pass_Fail int, " + ", ".join(f"feature_{j:03d} double" for j in range(4)))


@pytest.mark.parametrize("name", ["forest", "gbt", "histogram"])
def test_sums_and_scores_of_fitted_ensembles(spark, name):
    df = sensor_rows(spark, missing=0.1 if name == "histogram" else 0.0)
    clf = {"forest": RandomForestClassifier(numTrees=7, maxDepth=6, labelCol="Pass_Fail", seed=1),
           "gbt": GBTClassifier(maxIter=5, maxDepth=3, labelCol="Pass_Fail", seed=1),
           "histogram": HistogramBoosting(maxIter=5, maxDepth=3)}[name]
    model = Pipeline(stages=[FeatureAssembler(keepMissing=True), clf]).fit(df)
    scored = model.transform(df)
    if name == "forest":
        want = vector_to_array("probability")[1]
    else:  # Spark's boosted margin is half the log odds
        want = F.col("margin") if name == "histogram" else vector_to_array("rawPrediction")[1]
    phi, names, mean = imp.tree_attributions(model, df, "row_id")
    rows = scored.select("row_id", want.alias("want")).join(phi, "row_id").collect()
    assert len(rows) == 300 and names == [f"feature_{j:03d}" for j in range(4)]
    scale = 1.0 if name != "gbt" else 1.0
    assert max(abs(r.want * scale - mean - sum(r.phi)) for r in rows) < 1e-6
    ranked = imp.rank_features(imp.tree_attribution_importance(model, df, "row_id", n_rows=None)).orderBy("rank").collect()
    assert [r.feature_name for r in ranked[:2]] == ["feature_001", "feature_003"]


def test_spark_trees_score_alike(spark):
    df = FeatureAssembler().transform(sensor_rows(spark))
    model = RandomForestClassifier(numTrees=3, maxDepth=4, labelCol="Pass_Fail", seed=2).fit(df)
    trees, kind = spark_trees(model)
    rows = model.transform(df).select(vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    assert kind == "probability" and np.allclose(ensemble_value(trees, np.array([r.x for r in rows])), [r.p for r in rows])


def test_choice_of_method(spark):
    df = sensor_rows(spark)
    cols = [f"feature_{j:03d}" for j in range(4)]
    model = Pipeline(stages=[FeatureAssembler(), HistogramBoosting(maxIter=3)]).fit(df)
    for method in ("shap", "permutation_importance"):
        rows = imp.feature_importance(model, df, "row_id", "Pass_Fail", cols, method, repeats=2).collect()
        assert {r.feature_name for r in rows} == set(cols)
        assert max(rows, key=lambda r: r.importance).feature_name == "feature_001"
    with pytest.raises(ValueError, match="unknown importance method"):
        imp.feature_importance(model, df, "row_id", "Pass_Fail", cols, "gini")
    plain = PipelineModel(stages=[FeatureAssembler(), LogisticRegression(labelCol="Pass_Fail").fit(FeatureAssembler().transform(df))])
    assert imp.feature_importance(plain, df, "row_id", "Pass_Fail", cols, "shap").count() == 4
