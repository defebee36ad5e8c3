"""Keyed bijections: every position once, keys differ, no pattern left."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sensor_yield.functions.bijection import bijection, code_of


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 3001])
def test_every_position_once(spark, n):
    for code in (0, code_of("a", 1), (1 << 30) - 1):
        rows = spark.range(n).select(bijection(F.col("id"), F.lit(code), n).alias("p")).collect()
        assert sorted(r.p for r in rows) == list(range(n))


def test_codes_give_unrelated_orders(spark):
    n = 2000
    codes = [code_of(42, f, r) for f in ("feature_000", "feature_001") for r in range(3)]
    rows = spark.range(n).select("id", *[bijection(F.col("id"), F.lit(c), n).alias(f"p{i}") for i, c in enumerate(codes)]).toPandas()
    corr = rows.corr(method="spearman").to_numpy()
    assert abs(corr - corr.diagonal() * (corr == 1)).max() < 0.1
    assert all((rows[f"p{i}"] == rows["id"]).sum() < 12 for i in range(len(codes)))


def test_swaps_keep_the_column(spark):
    """Importance of a column that decides alone is large, of one that says nothing near 0, of an unread one 0."""
    from pyspark.ml import PipelineModel

    from sensor_yield.operators.importance import permutation_importance
    from sensor_yield.operators.models import ExpressionScorer

    df = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 5 == 0).cast("int").alias("Pass_Fail"),
                                 (F.col("id") % 5).cast("double").alias("feature_000"), F.lit(1.0).alias("feature_001"),
                                 F.col("id").cast("double").alias("feature_002"))
    model = PipelineModel(stages=[ExpressionScorer(expression="1 / (1 + feature_000 + 0 * feature_001)",
                                                   usedCols=["feature_000", "feature_001"])])
    cols = ["feature_000", "feature_001", "feature_002"]
    run = lambda **k: {r.feature_name: r.importance for r in permutation_importance(
        model, df.repartition(3), "row_id", "Pass_Fail", cols, repeats=4, **k).collect()}
    got = run()
    assert got["feature_000"] > 0.6 and got["feature_001"] == pytest.approx(0.0, abs=1e-9) and got["feature_002"] == 0.0
    assert run(max_rows=600) == got  # one pair at a time


def test_first_round_is_compiled(spark):
    """Rows that land inside on the first try pass no interpreted lambda: it stands in the last branch only."""
    plan = spark.range(1000).select(bijection(F.col("id"), F.lit(5), 1000).alias("p"))._jdf.queryExecution().analyzed().toString()
    assert "CASE WHEN" in plan and "lambda" not in plan[:plan.index("ELSE aggregate(")]
