"""Model-side operators against brute-force numpy on small fixtures (T05 + T07, M01)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA

from sensor_yield.operators.models import LogisticFromC
from sensor_yield.operators.transforms import FeatureAssembler, MedianImputer, StandardScaler


def _frame(spark, x, y=None):
    cols = [f"feature_{i:03d}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "Pass_Fail", y if y is not None else np.zeros(len(x), dtype=int))
    pdf.insert(0, "row_id", np.arange(len(x)))
    return spark.createDataFrame(pdf)


def test_pca_explained_variance_matches_numpy(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 6)) @ rng.normal(size=(6, 6))
    df = _frame(spark, x)
    model = Pipeline(stages=[MedianImputer(), StandardScaler(), FeatureAssembler(),
                             PCA(k=2, inputCol="features", outputCol="pca")]).fit(df)
    got = model.stages[-1].explainedVariance.toArray()
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    ev = np.sort(np.linalg.eigvalsh(np.cov(z, rowvar=False)))[::-1]
    assert np.allclose(got, ev[:2] / ev.sum(), atol=1e-8)


def test_logistic_c_maps_to_penalised_sum_of_losses(spark):
    rng = np.random.default_rng(8)
    n, d, c = 300, 4, 0.5
    x = rng.normal(size=(n, d))
    y = (x @ np.array([1.5, -1.0, 0.5, 0.0]) + rng.normal(0, 1, n) > 0).astype(int)
    df = FeatureAssembler().transform(_frame(spark, x, y))
    m = LogisticFromC(C=c).fit(df)
    # Newton's method on  C * sum log-loss + 0.5 * ||w||^2  (intercept not penalised)
    xa = np.hstack([x, np.ones((n, 1))])
    w = np.zeros(d + 1)
    reg = np.eye(d + 1)
    reg[-1, -1] = 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-xa @ w))
        g = c * xa.T @ (p - y) + reg @ w
        h = c * (xa.T * (p * (1 - p))) @ xa + reg
        w -= np.linalg.solve(h, g)
    assert np.allclose(m.coefficients.toArray(), w[:-1], atol=1e-3)
    assert abs(m.intercept - w[-1]) < 1e-3


def test_class_weight_ratio(spark):
    from sensor_yield.operators.models import scale_pos_weight
    from sensor_yield.operators.profile import class_ratio
    df = spark.createDataFrame([(0,)] * 80 + [(1,)] * 20, "Pass_Fail int")
    assert scale_pos_weight(df) == 4.0
    assert class_ratio(df).first()["scale_pos_weight"] == 4.0
    only_pass = spark.createDataFrame([(0,)] * 5, "Pass_Fail int")
    assert scale_pos_weight(only_pass) == 5.0  # max(n_fail, 1)


def test_missing_indicator_fill(spark):
    from sensor_yield.operators.transforms import MissingIndicatorFiller
    df = spark.createDataFrame([(1.0, None), (3.0, 2.0), (None, 5.0)], "feature_000 double, feature_001 double")
    out = MissingIndicatorFiller().fit(df).transform(df).toPandas()
    assert list(out["feature_000"]) == [1.0, 3.0, 0.0]
    assert list(out["feature_001"]) == [1.0, 2.0, 5.0]
    assert list(out["feature_000_missing"]) == [0.0, 0.0, 1.0]
    assert list(out["feature_001_missing"]) == [1.0, 0.0, 0.0]


def test_minority_knn_matches_numpy(spark):
    from pyspark.ml.feature import VectorAssembler

    from sensor_yield.operators.knn import neighbours
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["row_id"] = np.arange(40)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    got = neighbours(df, "row_id", "features", 4).toPandas().sort_values(["qid", "nb_rank"])
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    exp = np.argsort(d, axis=1, kind="stable")[:, :4]
    for q in range(40):
        assert list(got[got.qid == q]["nb_id"]) == list(exp[q])
