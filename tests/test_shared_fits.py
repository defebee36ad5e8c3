"""Shared preprocessing fits and mergeable median sketches."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import resample
from sensor_yield.operators.models import build_candidates
from sensor_yield.operators.quantiles import approximate_medians, exact_medians, median_sketches, training_medians
from sensor_yield.operators.transforms import MedianImputer
from sensor_yield.plans import training
from sensor_yield.plans.shared_fits import signature

COLS = [f"feature_{i:03d}" for i in range(3)]


def rows(spark, n=240):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] + rng.normal(scale=0.5, size=n) > 0.7).astype(int)
    data = [(i, int(c), *[None if rng.random() < 0.1 else float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "row_id long, Pass_Fail int, " + ", ".join(f"{c} double" for c in COLS))


def test_each_preprocessing_is_fitted_once_per_fold(spark):
    df = rows(spark)
    fits = training.shared_fits(df, "row_id", k=3)
    cands = build_candidates()
    with ThreadPoolExecutor(4) as pool:
        made = list(pool.map(lambda cf: fits.prepared(cf[1], cf[0].pre()), [(c, f) for c in cands for f in (None, 0, 1, 2)]))
    assert set(fits.fit_counts.values()) == {1}
    kinds = [(name, depth) for _, name, depth in fits.fit_counts]
    assert {k: kinds.count(k) for k in kinds} == {("MissingRatioDropper", 1): 4, ("MedianImputer", 2): 4, ("VarianceFilter", 3): 4,
                                                 ("StandardScaler", 4): 4, ("VarianceFilter", 2): 4}
    c = {c.name: c for c in cands}[config.MODEL_LOGISTIC]
    models, train, held = fits.prepared(1, c.pre())
    fit_rows = fits.folded.where("fold <> 1").drop("fold")
    plain = Pipeline(stages=c.pre()).fit(fit_rows)
    vec = lambda d: {r.row_id: r.features for r in d.collect()}
    assert vec(train) == vec(plain.transform(fit_rows)) and vec(held) == vec(plain.transform(fits.folded.where("fold = 1")))
    assert len(made) == 16 and len(models) == len(c.pre())
    fits.close()


def test_rows_are_resampled_once_per_fold(spark, monkeypatch):
    """All settings of a search are fitted on the same new rows, which stand in as many partitions as the fold's."""
    made, smote = [], resample.smote
    monkeypatch.setattr(resample, "smote", lambda df, *args: made.append(df) or smote(df, *args))
    cand = {c.name: c for c in build_candidates(grids={
        config.MODEL_FOREST_SMOTE: {"n_estimators": [2, 3], "max_depth": [2, 3], "min_samples_leaf": [1]}})}[config.MODEL_FOREST_SMOTE]
    df = rows(spark).repartition(2)
    fits = training.shared_fits(df, "row_id", k=2)
    found = training.random_search(cand, df, "row_id", k=2, fits=fits)
    assert len(made) == 3 and len(found.all_settings) == 4 and found.cv_summary["pr_auc"]["mean"] > 0.5
    train = fits.prepared(0, cand.pre())[1]
    more = cand.clf({}).resampled(train)
    assert more.rdd.getNumPartitions() == train.rdd.getNumPartitions()
    assert [r["count"] for r in more.groupBy("Pass_Fail").count().collect()] == [more.count() // 2] * 2
    fits.close()


def test_failed_fits_are_told_to_all(spark):
    fits = training.shared_fits(rows(spark, 60), "row_id", k=2)

    class Broken(MedianImputer):
        def _fit(self, df):
            raise ValueError("no")

    for _ in range(2):
        with pytest.raises(ValueError, match="no"):
            fits.prepared(0, [Broken()])


def test_signature_tells_parameters_apart():
    assert signature(MedianImputer()) == signature(MedianImputer())
    assert signature(MedianImputer()) != signature(MedianImputer(approximate=True))


def test_sketched_medians_are_near_in_rank(spark):
    n = 60_000
    df = spark.range(n).select((F.xxhash64("id") % 1_000_003).cast("double").alias("feature_000"),
                               F.exp((F.xxhash64(F.col("id") + 7) % 1000) / 100).alias("feature_001"),
                               F.lit(None).cast("double").alias("feature_002"), (F.col("id") % 4).cast("int").alias("fold"))
    got = {r.feature_name: r.median for r in approximate_medians(df, COLS).collect()}
    assert got["feature_002"] is None
    for c in COLS[:2]:
        below = df.where(F.col(c) < got[c]).count() / n
        upto = df.where(F.col(c) <= got[c]).count() / n
        assert below - 0.002 <= 0.5 <= upto + 0.002
    sketches = median_sketches(df, COLS, ["fold"])
    for r in training_medians(sketches, "fold", COLS, 4).collect():
        others = df.where(F.col("fold") != r.fold)
        m = others.count()
        assert others.where(F.col(r.feature_name) < r.median).count() / m - 0.002 <= 0.5
        assert 0.5 <= others.where(F.col(r.feature_name) <= r.median).count() / m + 0.002


def test_small_columns_give_a_middle_value(spark):
    df = rows(spark)
    model = MedianImputer(inputCols=COLS, approximate=True).fit(df)
    exact = {r.feature_name: r.median for r in exact_medians(df, COLS).collect()}
    for c, v in zip(model.getOrDefault(model.cols), model.getOrDefault(model.values)):
        assert abs(v - exact[c]) < 0.05
