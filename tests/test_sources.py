"""Loading and normalising raw layouts."""

from __future__ import annotations

import os

import numpy as np
import pytest
from conftest import make_sensor_matrix, write_combined_csv, write_two_file_layout

from sensor_yield import config
from sensor_yield.functions.columns import feature_columns, generate_feature_names
from sensor_yield.functions.labels import convert_labels
from sensor_yield.sources import raw_files as rf


def test_feature_name_width():
    assert generate_feature_names(5)[-1] == "feature_004"
    names = generate_feature_names(1200)
    assert names[-1] == "feature_1199" and names[0] == "feature_0000"
    assert names == sorted(names)


def test_find_raw_files_and_missing_dir(spark, tmpdir_path):
    x, y = make_sensor_matrix(20, 5)
    write_two_file_layout(tmpdir_path, x, y)
    paths = rf.find_raw_files(spark, tmpdir_path)
    assert paths["features"].endswith("secom.data") and paths["labels"].endswith("secom_labels.data")
    with pytest.raises(FileNotFoundError):
        rf.find_raw_files(spark, os.path.join(tmpdir_path, "nope"))


def test_find_raw_files_by_pattern(spark, tmpdir_path):
    x, y = make_sensor_matrix(10, 4)
    write_two_file_layout(tmpdir_path, x, y, "sensors.txt", "my_labels.txt")
    paths = rf.find_raw_files(spark, tmpdir_path)
    assert paths["features"].endswith("sensors.txt") and paths["labels"].endswith("my_labels.txt")


def test_two_file_layout_shape(spark, tmpdir_path):
    x, y = make_sensor_matrix()
    write_two_file_layout(tmpdir_path, x, y)
    df = rf.load_raw(spark, tmpdir_path)
    assert df.columns[:5] == ["row_id", "Time", "Pass_Fail_Raw", "Pass_Fail", "Pass_Fail_Label"]
    assert feature_columns(df) == generate_feature_names(30)
    pdf = df.orderBy("row_id").toPandas()
    assert len(pdf) == 300 and list(pdf["row_id"]) == list(range(300))
    assert list(pdf["Pass_Fail_Raw"]) == list(y)
    got = pdf[generate_feature_names(30)].to_numpy(dtype=float)
    assert np.allclose(np.nan_to_num(got, nan=-999), np.nan_to_num(np.round(x, 6), nan=-999), atol=1e-6)
    assert pdf["Time"].notna().all()
    assert str(pdf["Time"].iloc[0]) == "2008-01-01 00:00:00"


def test_layouts_agree(spark, tmpdir_path):
    x, y = make_sensor_matrix()
    two = os.path.join(tmpdir_path, "two")
    one = os.path.join(tmpdir_path, "one")
    os.makedirs(two)
    os.makedirs(one)
    write_two_file_layout(two, x, y)
    write_combined_csv(os.path.join(one, "uci-secom.csv"), x, y, index_col=True)
    a = rf.load_raw(spark, two).orderBy("row_id").toPandas()
    b = rf.load_raw(spark, one).orderBy("row_id").toPandas()
    assert list(a.columns) == list(b.columns)
    cols = generate_feature_names(30)
    assert np.allclose(np.nan_to_num(a[cols].to_numpy(float), nan=0), np.nan_to_num(b[cols].to_numpy(float), nan=0),
                       rtol=1e-4)
    assert (a["Pass_Fail"] == b["Pass_Fail"]).all()


def test_combined_csv_discovered_by_header(spark, tmpdir_path):
    x, y = make_sensor_matrix(40, 6)
    write_combined_csv(os.path.join(tmpdir_path, "renamed_export.csv"), x, y, label_name=" Target ")
    found = rf.find_combined_csv(spark, tmpdir_path)
    assert found is not None and found.endswith("renamed_export.csv")
    df = rf.load_combined_csv(spark, found)
    assert df.count() == 40 and len(feature_columns(df)) == 6


def test_combined_csv_without_label_fails(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "x.csv")
    with open(p, "w") as fh:
        fh.write("Time,a,b\n2008-01-01 00:00:00,1,2\n")
    with pytest.raises(ValueError):
        rf.load_combined_csv(spark, p)


def test_row_count_mismatch(spark, tmpdir_path):
    x, y = make_sensor_matrix(30, 4)
    write_two_file_layout(tmpdir_path, x, y[:-1])
    with pytest.raises(ValueError, match="Row count mismatch"):
        rf.load_raw(spark, tmpdir_path)


def test_label_file_variants(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "labels.data")
    with open(p, "w") as fh:
        fh.write("-1\t19/07/2008 11:55:00\n\n1   19/07/2008 12:32:00\n-1\n")
    df = rf.load_labels(spark, p).orderBy("row_id").toPandas()
    assert list(df["Pass_Fail_Raw"]) == [-1, 1, -1]
    assert str(df["Time"].iloc[1]) == "2008-07-19 12:32:00"
    assert df["Time"].isna().iloc[2]


def test_feature_file_ragged_and_spaces(spark, tmpdir_path):
    p = os.path.join(tmpdir_path, "m.data")
    with open(p, "w") as fh:
        fh.write("1.0   2.0 NaN\n\n  4.0 x 6.0\n7.0 8.0\n")
    df = rf.load_features(spark, p).orderBy("row_id").toPandas()
    assert list(df.columns[:3]) == ["feature_000", "feature_001", "feature_002"]
    assert df.shape[0] == 3
    assert np.isnan(df["feature_002"].iloc[0]) and np.isnan(df["feature_001"].iloc[1])
    assert np.isnan(df["feature_002"].iloc[2])


def test_label_mapping_and_bad_labels(spark):
    df = spark.createDataFrame([(-1,), (1,), (-1,), (-1,), (1,)], "Pass_Fail_Raw int")
    out = convert_labels(df).toPandas()
    assert list(out["Pass_Fail"]) == [0, 1, 0, 0, 1]
    assert list(out["Pass_Fail_Label"]) == ["Pass", "Fail", "Pass", "Pass", "Fail"]
    assert df.columns == ["Pass_Fail_Raw"]
    bad = spark.createDataFrame([(-1,), (1,), (0,)], "Pass_Fail_Raw int")
    with pytest.raises(ValueError):
        convert_labels(bad)


def test_time_format_whole_column_rule(spark):
    from sensor_yield.functions.timestamps import parse_time_column
    rows = [("19/07/2008 11:55:00",)] * 9 + [("2008-07-19 11:55:00",)]
    out = parse_time_column(spark.createDataFrame(rows, "Time string"), "Time").toPandas()
    # day-first share is exactly 0.9, not above it: no single format wins, so every
    # value is parsed on its own
    assert out["Time"].notna().sum() == 10
    rows = [("19/07/2008 11:55:00",)] * 19 + [("junk",)]
    out = parse_time_column(spark.createDataFrame(rows, "Time string"), "Time").toPandas()
    assert out["Time"].notna().sum() == 19


def test_normalised_label_constant():
    assert config.LABEL_NAME_CANDIDATES[0] == "pass/fail"
