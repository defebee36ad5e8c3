"""One format learned per column from its layouts and value ranges."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensor_yield.functions.timestamps import inferred_format, parse_time_column


@pytest.mark.parametrize("values,fmt,first", [
    (["07/19/2008 11:55", "12/31/2008 01:05"], "M/d/yyyy H:mm", "2008-07-19 11:55:00"),
    (["01/02/2008 11:55", "19/02/2008 11:55"], "d/M/yyyy H:mm", "2008-02-01 11:55:00"),
    (["01/02/2008 11:55"], "M/d/yyyy H:mm", "2008-01-02 11:55:00"),
    (["1.2.2009 1:02:03", "19.12.2009 10:02:03"], "d.M.yyyy H:mm:ss", "2009-02-01 01:02:03"),
    (["2008/07/19 11:55:00.125"], "yyyy/M/d H:mm:ss.SSS", "2008-07-19 11:55:00.125000"),
    (["2008-07-19T11:55:00"], "yyyy-M-d'T'H:mm:ss", "2008-07-19 11:55:00"),
    (["19 Jul 2008 11:55", "2 Jan 2009 03:04"], "d MMM yyyy H:mm", "2008-07-19 11:55:00"),
    (["Jul 19, 2008 11:55 PM"], "MMM d, yyyy h:mm a", "2008-07-19 23:55:00"),
    (["July 19 2008"], "MMMM d yyyy", "2008-07-19 00:00:00"),
    (["3/14/08 1:02"], "M/d/yy H:mm", "2008-03-14 01:02:00"),
])
def test_layouts(spark, values, fmt, first):
    df = spark.createDataFrame([(v, i) for i, v in enumerate([*values, "junk", None, ""])], "t string, i int")
    assert inferred_format(df, F.col("t")) == fmt
    got = [r.t for r in parse_time_column(df, "t").orderBy("i").collect()]
    assert str(got[0]) == first and all(v is not None for v in got[:len(values)]) and got[len(values):] == [None] * 3


def test_the_most_frequent_layout_gives_the_format(spark):
    values = ["05/06/2008 11:55"] * 3 + ["25/06/2008 11:55"] + ["2008.05.06"] * 2
    df = spark.createDataFrame([(v,) for v in values], "t string")
    assert inferred_format(df, F.col("t")) == "d/M/yyyy H:mm"


def test_no_layout(spark):
    for values in (["x", "12"], []):
        df = spark.createDataFrame([(v,) for v in values], "t string")
        assert inferred_format(df, F.col("t")) is None and parse_time_column(df, "t").where("t IS NOT NULL").count() == 0
