"""Chart datasets of a normalised table and the guide's tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.labels import label_text
from sensor_yield.operators import charts
from sensor_yield.plans.eda import document_rows


@pytest.fixture(scope="module")
def sensors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(200, 4)) * [1, 5, 2, 0]
    rows = [(i, int(i % 8 == 0), *[None if j == 2 and i % 3 else float(v) for j, v in enumerate(r)]) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "row_id long, Pass_Fail int, " + ", ".join(f"feature_{j:03d} double" for j in range(4)))
    return df.withColumn(config.LABEL_TEXT_COL, label_text(F.col("Pass_Fail"))), x


def test_every_chart_has_its_rows(sensors):
    df, x = sensors
    got = {k: v.collect() for k, v in charts.chart_datasets(df, n_boxes=2).items()}
    assert {r["class"]: r.n for r in got["class_distribution"]} == {"Pass": 175, "Fail": 25}
    assert sum(r.n for r in got["missing_ratio_histogram"]) == 4 and len(got["missing_ratio_histogram"]) == 40
    assert got["top_missing_features"][0].feature_name == "feature_002"
    assert {r.kind: r.n_features for r in got["constant_feature_count"]} == {"Usable": 3, "Constant/Low-Variance": 1}
    assert len(got["correlation_heatmap_top_variance"]) == 9  # the constant column has no correlation
    boxes = {(r.feature_name, r["class"]): r.median for r in got["sensor_distribution_by_class"]}
    fails = np.arange(200) % 8 == 0
    assert boxes[("feature_001", "Fail")] == pytest.approx(np.median(x[fails, 1]))
    assert set(boxes) == {(f, c) for f in ("feature_001", "feature_002") for c in ("Pass", "Fail")}
    assert len(got["pca_2d_projection"]) == 200 and got["pca_2d_projection"][0].asDict().keys() == {"row_id", "class", "pc1", "pc2"}


def test_trellis_and_cross_table(spark, sensors):
    df, x = sensors
    master = df.withColumn("dataset_split", F.when(F.col("row_id") < 100, "test").otherwise("train"))
    summary = spark.createDataFrame([("feature_001", 1), ("feature_000", 2), ("feature_002", 3)], "feature_name string, rank int")
    rows = charts.sensor_trellis(master, summary).orderBy("rank", "class").collect()
    assert [(r["rank"], r.feature_name, r["class"]) for r in rows] == [(1, "feature_001", "Fail"), (1, "feature_001", "Pass"),
                                                                      (2, "feature_000", "Fail"), (2, "feature_000", "Pass")]
    assert rows[0].median == pytest.approx(np.median(x[:100][np.arange(100) % 8 == 0, 1]))
    t = spark.createDataFrame([("a", 0.5, 0.1, 0.2, 0.3), ("b", 0.5, 0.4, 0.5, 0.6), ("a", 0.6, 0.7, 0.8, 0.9)],
                              "model string, threshold double, recall double, precision double, f1 double")
    cells = {r.threshold: r.asDict() for r in charts.threshold_cross_table(t, ["a", "b"]).collect()}
    assert cells[0.5]["b_precision"] == 0.5 and cells[0.6]["a_f1"] == 0.9 and cells[0.6]["b_recall"] is None


def test_document_rows(spark):
    doc = {"n": 3, "text": "x", "flag": True, "none": None, "list": [1.5, 2], "t": [{"threshold": 0.4, "kept": 7}], "in": {"a": {"b": 1}}}
    assert {r.path: r.value for r in document_rows(spark, doc).collect()} == {
        "n": 3.0, "flag": 1.0, "list.0": 1.5, "list.1": 2.0, "t.0.4.kept": 7.0, "in.a.b": 1.0}
