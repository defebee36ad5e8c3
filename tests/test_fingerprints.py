"""Duplicate rows by fingerprint: NULLs equal each other and stay in their column."""

from __future__ import annotations

from sensor_yield.operators.profile import duplicate_rows, row_fingerprint


def count(df, cols):
    return tuple(duplicate_rows(df, cols).first())


def test_nulls_order_and_groups(spark):
    rows = [(1.0, None, "x"), (None, 1.0, "x"), (1.0, None, "x"), (None, None, None), (None, None, None), (0.0, 2.0, ""),
            (-0.0, 2.0, ""), (0.0, 2.0, None)] + [(7.0, 7.0, "hot")] * 50
    df = spark.createDataFrame(rows, "a double, b double, c string").repartition(4)
    assert count(df, ["a", "b", "c"]) == (1 + 1 + 1 + 49, 6)
    assert count(df, ["c"]) == (len(rows) - 4, 4)
    assert count(df.limit(0), ["a", "b"]) == (0, 0)


def test_equal_fingerprints_do_not_make_rows_equal(spark, monkeypatch):
    from pyspark.sql import functions as F

    from sensor_yield.operators import profile

    monkeypatch.setattr(profile, "row_fingerprint", lambda cols: [F.lit(1).alias("__f1"), F.lit(2).alias("__f2")])
    df = spark.createDataFrame([(1,), (2,), (2,), (3,)], "a int")
    assert count(df, ["a"]) == (1, 3)


def test_missing_places_are_part_of_it(spark):
    df = spark.createDataFrame([(1, None), (None, 1)], "a int, b int").select(*row_fingerprint(["a", "b"]))
    assert len({tuple(r) for r in df.collect()}) == 2
