"""One path at every size: quantiles, cuts, row ids, null groups, plans without hidden cross joins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensor_yield.operators import quantiles, splits
from sensor_yield.operators.ordering import cumulative_sums, key_rank, ordinal_within_group
from sensor_yield.operators.profile import is_monotonic
from sensor_yield.plans.catalog import QUERIES
from sensor_yield.sources.driver_tables import load_table
from sensor_yield.sources.raw_files import classify_header

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("probs", [[0.25, 0.5, 0.75], [0.5, 0.6], [0.5, 0.5001, 0.5002], [0.0, 1.0]])
def test_quantiles_of_a_large_group_come_from_the_first_brackets(spark, monkeypatch, probs):
    monkeypatch.setattr(quantiles, "WIDENINGS", quantiles.WIDENINGS[:1])  # no second attempt
    df = spark.range(200_001).select((F.pmod(F.col("id") * 7919, F.lit(200_001))).cast("double").alias("v"))
    row = quantiles.exact_quantiles(df, "v", [], probs, accuracy=50).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx([200_000 * p for p in probs])


def test_quantiles_of_small_groups_ties_and_null_groups(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "WIDENINGS", quantiles.WIDENINGS[:1])
    rng = np.random.default_rng(1)
    rows = [(g, float(v)) for g in (None, "a", "b", "c") for v in rng.integers(0, 4, {"a": 1, "b": 3}.get(g, 500))]
    got = quantiles.exact_quantiles(spark.createDataFrame([*rows, ("d", None), ("a", float("nan"))], "g string, v double"),
                                    "v", ["g"], [0.1, 0.75]).collect()
    assert {r["g"] for r in got} == {None, "a", "b", "c"}
    for r in got:
        mine = [v for g, v in rows if g == r["g"]]
        assert r["n"] == len(mine) and [r["q0"], r["q1"]] == pytest.approx(np.quantile(mine, [0.1, 0.75]))


def test_a_missed_bracket_is_widened(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "WIDENINGS", (-0.4, None))  # brackets that lie beside their rank
    df = spark.range(1001).select(F.col("id").cast("double").alias("v"))
    assert quantiles.exact_quantiles(df, "v", [], [0.5], accuracy=20).first()["q0"] == 500


def test_null_labels_raise_and_null_groups_stay(spark):
    df = spark.range(100).select("id", F.when(F.col("id") >= 10, F.col("id") % 2).cast("int").alias("y"))
    for make in (lambda: splits.stratified_split(df, "id", "y"), lambda: splits.stratified_folds(df, "id", "y"),
                 lambda: splits.stratified_sample(df, "id", "y", 20)):
        with pytest.raises(Exception, match="NULL in y"):
            make().collect()
    ranked = ordinal_within_group(df, ["y"], ["id"]).collect()
    assert len(ranked) == 100 and sorted(r.ordinal for r in ranked if r.y is None) == list(range(1, 11))
    sums = cumulative_sums(df.withColumn("one", F.lit(1)), ["y"], ["id"], ["one"]).collect()
    assert {(r.y, r.total_one) for r in sums} == {(None, 10), (0, 45), (1, 45)}


def test_key_rank_is_row_number(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("g"), F.md5((F.col("id") % 700).cast("string")).alias("k"))
    got = key_rank(df, ["g"], "k", "id", "rank").toPandas()
    want = got.sort_values(["g", "k", "id"]).groupby("g").cumcount() + 1
    assert (got["rank"].loc[want.index] == want).all()


def test_cut_moves_no_feature(spark):
    wide = spark.range(500).select("id", (F.col("id") % 2).cast("int").alias("y"), F.rand(1).alias("feature_000"))
    for made in (splits.stratified_split(wide, "id", "y"), splits.stratified_sample(wide, "id", "y", 50)):
        assert "Exchange hashpartitioning" not in made._jdf.queryExecution().executedPlan().toString()


def test_master_is_not_sorted_and_totals_are_not_cross_joined(spark):
    for name in ("master_table", "pr_curve", "roc_curve", "dashboard_kpis", "missing_ratio_histogram", "metrics_at_threshold",
                 "order_time_structure"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name
        assert name != "master_table" or "rangepartitioning" not in plan


def test_monotonic_ties_and_text_keys(spark):
    make = lambda rows, k: spark.createDataFrame(rows, f"k {k}, v double")
    check = lambda df: is_monotonic(df, "k", "v").first()[0]
    assert check(make([("a", 1.0), ("b", 3.0), ("b", 2.0), ("c", 3.0)], "string"))
    assert not check(make([("a", 1.0), ("b", 3.0), ("b", 2.0), ("c", 2.5)], "string"))
    assert check(make([(None, 0.0), (1, 1.0)], "int")) and not check(make([(None, 5.0), (1, 1.0)], "int"))
    assert not check(make([(1, 1.0), (2, None)], "int")) and check(make([], "int"))


def test_row_ids_follow_the_file(spark, tmp_path):
    from sensor_yield.sources.raw_files import with_file_order

    for name, n in (("b.txt", 700), ("a.txt", 1300)):
        (tmp_path / name).write_text("".join(f"{name}-{i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = with_file_order(spark.read.text(str(tmp_path))).orderBy("row_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.row_id for r in rows] == list(range(2000))
    assert [r.value for r in rows] == [f"a.txt-{i}" for i in range(1300)] + [f"b.txt-{i}" for i in range(700)]


def test_header_roles():
    assert classify_header(["Unnamed: 0", " TIME ", "0", "1", "Pass/Fail", "_c7"]) == ("Time" and " TIME ", "Pass/Fail", ["0", "1"])
    assert classify_header(["a", "time", "Time"]) == ("time", None, ["a", "Time"])


def test_embedding_width_is_checked(spark, tmp_path):
    from sensor_yield.sources.driver_tables import embedding_dim

    assert embedding_dim(spark, SF) == load_table(spark, SF, "embeddings").select(F.size("embedding")).first()[0]
    spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>").write.parquet(
        str(tmp_path / "embeddings.parquet"))
    with pytest.raises(ValueError, match="between 1 and 2"):
        embedding_dim(spark, str(tmp_path))


def test_neighbours_of_duplicates_do_not_depend_on_row_order(spark):
    from pyspark.ml.linalg import Vectors

    from sensor_yield.operators.knn import nearest, neighbours

    rng = np.random.default_rng(4)
    x = np.repeat(rng.normal(size=(40, 3)), 4, axis=0)
    ids = np.arange(len(x), dtype=np.int64)
    want = [sorted(((x[i] - x[j]) @ (x[i] - x[j]), j) for j in range(len(x)) if j != i)[:5] for i in range(len(x))]
    for order in (ids, ids[::-1], rng.permutation(ids)):
        q, _, near = nearest(order, x[order], order, x[order], 6)
        got = {}
        for a, b in zip(q, near, strict=True):
            got.setdefault(a, []).extend([b] if a != b else [])
        assert {i: near[:5] for i, near in got.items()} == {i: [j for _, j in w] for i, w in enumerate(want)}
    df = spark.createDataFrame([(int(i), Vectors.dense(x[i])) for i in ids], ["id", "v"])
    for block_rows, pivots in ((2048, 32), (7, 5), (10, 1)):
        rows = neighbours(df, "id", "v", 5, block_rows, pivots).orderBy("qid", "nb_rank").collect()
        assert [(r.qid, r.nb_rank, r.nb_id) for r in rows] == [(i, k, j) for i, w in enumerate(want) for k, (_, j) in enumerate(w)]


def _checkpointed_plans(build, monkeypatch) -> list[str]:
    from sensor_yield.session import cut_lineage
    plans = []
    monkeypatch.setattr(quantiles, "cut_lineage", lambda df, *a: plans.append(df) or cut_lineage(df, *a))
    build()
    return [p._jdf.queryExecution().optimizedPlan().toString() for p in plans]


def test_values_do_not_meet_by_group(spark, monkeypatch):
    """Brackets and quartiles, one row per group, are sent to the values: no value moves to its group."""
    from sensor_yield.operators.dashboard import grouped_boxes
    df = spark.range(5_000).select(F.lit("a").alias("k"), F.pmod(F.col("id") * 7919, F.lit(5_000)).cast("double").alias("v"))
    out = []
    texts = _checkpointed_plans(lambda: out.append(grouped_boxes(df, ["k"])), monkeypatch)
    assert texts and all("strategy=broadcast" in t for t in texts)
    assert "strategy=broadcast" in out[0]._jdf.queryExecution().optimizedPlan().toString()
    row = out[0].first()
    assert (row.q1, row.median, row.q3, row.n_outliers) == pytest.approx((1249.75, 2499.5, 3749.25, 0))


def test_medians_of_the_exploration_document_do_not_meet_by_feature(spark, monkeypatch):
    """The imputer's medians: the values of six columns are not sorted by feature in as few tasks."""
    from sensor_yield.plans.eda import eda_summary
    i = F.col("id")
    df = spark.range(2_000).select(i.alias("row_id"), (i % 5 == 0).cast("int").alias("Pass_Fail"),
                                   (i * 7919 % 2_000).cast("double").alias("feature_000"), (i % 7).cast("double").alias("feature_001"))
    docs = []
    texts = _checkpointed_plans(lambda: docs.append(eda_summary(df)), monkeypatch)
    assert texts and all("strategy=broadcast" in t for t in texts)
    assert docs[0]["n_rows"] == 2_000 and docs[0]["fail_rate"] == pytest.approx(0.2)
