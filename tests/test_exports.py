"""Sinks and mart readers on small frames."""

from __future__ import annotations

import os

import pytest

from sensor_yield.plans import exports
from sensor_yield.sources import marts


def test_threshold_partitions_and_absent_exports(spark, tmp_path):
    root = str(tmp_path / "m")
    assert marts.load_thresholds(spark, root, "A").count() == 0  # absent -> empty view
    assert not marts.data_is_available(spark, root)
    rows = [("A", 0.1, 1.0, 0.2, 0.3), ("A", 0.05, 1.0, 0.1, 0.2), ("B", 0.05, 0.5, 0.5, 0.5)]
    t = spark.createDataFrame(rows, "model string, threshold double, recall double, precision double, f1 double")
    exports.write_thresholds(t, root)
    assert os.path.isdir(os.path.join(root, "thresholds.parquet", "model=A"))
    a = marts.load_thresholds(spark, root, "A").toPandas()
    assert list(a["threshold"]) == [0.05, 0.1]
    with pytest.raises(marts.DashboardDataError):
        marts.load_feature_summary(spark, root)


def test_json_round_trip_and_filtered_export(spark, tmp_path):
    doc = {"best_model": "X", "nested": {"a": [1, 2.5, None]}, "n": 3}
    p = str(tmp_path / "doc.json")
    exports.write_json(spark, doc, p)
    assert exports.load_json(spark, p) == doc
    rows = spark.range(1234).withColumnRenamed("id", "row_id")
    out = str(tmp_path / "filtered")
    exports.export_filtered(rows.where("row_id % 2 = 0"), out)  # every filtered row, no cap
    assert spark.read.option("header", True).csv(out).count() == 617
