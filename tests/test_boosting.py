"""Histogram boosting against a plain exact grower; missing values; reruns; saved models."""

from __future__ import annotations

import math
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from sensor_yield.operators import boosting
from sensor_yield.operators.boosting import HistogramBoosting, HistogramBoostingModel
from sensor_yield.operators.trees import ensemble_value


def frame(spark, x, y, parts=4):
    rows = [(i, int(c), [float(v) for v in r]) for i, (r, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "row_id long, Pass_Fail int, a array<double>")
    return df.select("row_id", "Pass_Fail", array_to_vector("a").alias("features")).repartition(parts)


def plain_boosting(x, y, rounds, depth, eta, lam=1.0, w1=1.0, min_child=1.0):
    """Margins of exact greedy boosting with a learned side for missing values."""
    w = np.where(y == 1, w1, 1.0)
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        leaves, step = [np.arange(len(y))], np.zeros(len(y))
        for _ in range(depth):
            grown = []
            for rows in leaves:
                best = (1e-6, None)
                for f in range(x.shape[1]):
                    v = x[rows, f]
                    gone = np.isnan(v)
                    for cut in [*sorted(set(v[~gone]))[1:], math.inf]:
                        for missing_left in ([False, True] if gone.any() else [False]):
                            left = np.where(gone, missing_left, v < cut)
                            if left.all() or not left.any():
                                continue
                            sides = [(g[rows][s].sum(), h[rows][s].sum()) for s in (left, ~left)]
                            if min(s[1] for s in sides) < min_child:
                                continue
                            gain = 0.5 * (sum(a * a / (b + lam) for a, b in sides)
                                          - g[rows].sum() ** 2 / (h[rows].sum() + lam))
                            if gain > best[0] + 1e-9:
                                best = (gain, left)
                if best[1] is not None:
                    for s in (best[1], ~best[1]):
                        grown.append(rows[s])
                        step[rows[s]] = -eta * g[rows[s]].sum() / (h[rows[s]].sum() + lam)
            if not grown:
                break
            leaves = grown
        margin += step
    return margin


def margins(model, df):
    return np.array([r.margin for r in model.transform(df).orderBy("row_id").select("margin").collect()])


@pytest.mark.parametrize("missing", [0.0, 0.25])
def test_equals_plain_grower(spark, missing):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(240, 4)), 1)
    y = (x[:, 0] - x[:, 1] * (x[:, 2] > 0) + rng.normal(scale=0.4, size=240) > 0.6).astype(int)
    x[rng.random(x.shape) < missing] = np.nan
    df = frame(spark, x, y)
    model = HistogramBoosting(maxIter=4, maxDepth=3, stepSize=0.3).fit(df)
    assert np.allclose(margins(model, df), plain_boosting(x, y, 4, 3, 0.3), atol=1e-6)


def test_class_ratio_weighs_class_one(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.normal(size=(200, 2)), 1)
    y = (x[:, 0] > 1.0).astype(int)
    df = frame(spark, x, y)
    model = HistogramBoosting(maxIter=2, maxDepth=2, stepSize=0.1, scalePos=True).fit(df)
    w1 = (y == 0).sum() / (y == 1).sum()
    assert np.allclose(margins(model, df), plain_boosting(x, y, 2, 2, 0.1, w1=w1), atol=1e-6)


def test_missing_means_fail(spark):
    """Only that a value is missing tells the classes apart."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 0.2).astype(int)
    x[y == 1, 1] = np.nan
    df = frame(spark, x, y)
    model = HistogramBoosting(maxIter=5, maxDepth=1).fit(df)
    trees = model.tree_list()
    assert trees[0]["feature"][0] == 1 and trees[0]["threshold"][0] == math.inf and not trees[0]["missing_left"][0]
    got = margins(model, df)
    assert got[y == 1].min() > got[y == 0].max()


def test_partitions_and_refresh_do_not_matter(spark, monkeypatch):
    from sensor_yield.operators import boosting

    rng = np.random.default_rng(6)
    x = rng.normal(size=(500, 5))
    x[rng.random(x.shape) < 0.1] = np.nan
    y = (np.nan_to_num(x[:, 0]) + rng.normal(size=500) > 0.5).astype(int)
    make = lambda: HistogramBoosting(maxIter=6, maxDepth=2, subsamplingRate=0.7, maxBins=16)
    first = make().fit(frame(spark, x, y, 1)).tree_list()
    monkeypatch.setattr(boosting, "REFRESH", 2)
    assert make().fit(frame(spark, x, y, 7)).tree_list() == first
    assert sum(t["cover"][0] for t in first) / 6 == pytest.approx(350, abs=40)


def test_quantile_thresholds_rank_a_planted_signal(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 4))
    y = (x[:, 2] > 1.0).astype(int)
    df = frame(spark, x, y)
    model = HistogramBoosting(maxIter=3, maxDepth=1, maxBins=64).fit(df)
    tree = model.tree_list()[0]
    assert tree["feature"][0] == 2 and abs(tree["threshold"][0] - 1.0) < 0.1


@pytest.mark.parametrize("y", [[0, 0, 0], [1, 1, 1], []])
def test_one_class_or_no_rows(spark, y):
    df = frame(spark, [[1.0, math.nan]] * len(y), y)
    model = HistogramBoosting(maxIter=2).fit(df)
    assert [len(t["feature"]) for t in model.tree_list()] in ([1, 1], [])
    assert model.transform(df).count() == len(y)


def test_columns_without_values_or_rows_without_class(spark):
    df = frame(spark, [[math.nan, 1.0], [math.nan, 2.0]] * 20, [0, 1] * 20)
    df = df.unionByName(df.withColumn("Pass_Fail", F.lit(None).cast("int")))
    model = HistogramBoosting(maxIter=1, maxDepth=1).fit(df)
    assert model.tree_list()[0]["feature"][0] == 1 and model.tree_list()[0]["cover"][0] == 40


def test_saved_model_scores_alike(spark, tmpdir_path):
    df = frame(spark, [[i % 7, i % 3] for i in range(80)], [int(i % 7 > 4) for i in range(80)])
    model = HistogramBoosting(maxIter=3).fit(df)
    path = os.path.join(tmpdir_path, "model")
    model.write().save(path)
    back = HistogramBoostingModel.load(path)
    assert np.array_equal(margins(back, df), margins(model, df))
    x = np.array([r.x for r in df.orderBy("row_id").select(vector_to_array("features").alias("x")).collect()])
    assert np.allclose(ensemble_value(back.tree_list(), x), margins(model, df))


def test_one_task_grows_the_same_trees(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(rng.normal(size=(300, 5)), 2)
    y = (x[:, 0] * x[:, 1] + x[:, 2] + rng.normal(scale=0.5, size=300) > 0.8).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    df = frame(spark, x, y).cache()
    monkeypatch.setattr(boosting, "REFRESH", 4)
    clf = HistogramBoosting(maxIter=6, maxDepth=4, stepSize=0.3, subsamplingRate=0.8, scalePos=True)
    here = clf.fit(df).tree_list()
    monkeypatch.setattr(boosting, "LOCAL_VALUES", 0)
    assert here == clf.fit(df).tree_list() and len(here) == 6 and min(len(t["feature"]) for t in here) > 8


def test_small_tables_take_no_job_per_level(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(200, 4))
    df = frame(spark, x, (x[:, 0] + rng.normal(scale=0.3, size=200) > 0.5).astype(int)).cache()
    df.count()
    jobs = []
    for rounds in (3, 60):
        spark.sparkContext.setJobGroup(f"boosting-{rounds}", "")
        assert len(HistogramBoosting(maxIter=rounds, maxDepth=5).fit(df).tree_list()) == rounds
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boosting-{rounds}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs[0] == jobs[1] < 20


def test_one_task_looks_at_few_cells_at_a_time(monkeypatch):
    rng = np.random.default_rng(11)
    bins = rng.integers(0, 6, (150, 4)).astype("<u2")
    bins[:, 3] = bins[:, 0]  # ties go to the first feature
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(150)), pa.array((bins[:, 0] > 2) * 1.0), pa.array(np.ones(150)),
                                       pa.array([r.tobytes() for r in bins], pa.binary())], names=["key", "y", "w", "bins"])
    grow = lambda: boosting._local_trees([rows], [1, 2], boosting._growth(3, 1.0, 0.3, 1e-6), 4, 7, 2.0 ** 30, 0.9, 1.0, 0.1)
    whole = grow()
    monkeypatch.setattr(boosting, "LOCAL_CELLS", 1)
    monkeypatch.setattr(boosting, "CHUNK", 16)
    assert grow() == whole and whole[0]["feature"][0] == 0
