"""Operator semantics on small fixtures (profile, ordering, splits, evaluation,
transforms, SMOTE, importance)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from conftest import make_sensor_matrix
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import correlation as corr
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators import profile as prof
from sensor_yield.operators.ordering import cumulative_sums, ordinal_within_group
from sensor_yield.operators.quantiles import exact_medians
from sensor_yield.operators.splits import split_allocation, stratified_folds, stratified_split
from sensor_yield.operators.transforms import MedianImputer, MissingRatioDropper, StandardScaler, VarianceFilter


def _matrix_df(spark, n=300, d=30, seed=0):
    x, y = make_sensor_matrix(n, d, seed=seed)
    cols = [f"feature_{i:03d}" for i in range(d)]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "Pass_Fail", (y == 1).astype(int))
    pdf.insert(0, "row_id", np.arange(n))
    df = spark.createDataFrame(pdf).select("row_id", "Pass_Fail", *[F.nanvl(F.col(c), F.lit(None)).alias(c)
                                                                   for c in cols])
    return df, cols, pdf


def test_profile_detects_missing_and_constant(spark):
    df, cols, pdf = _matrix_df(spark)
    p = {r["feature_name"]: r for r in prof.feature_profile(df, cols).collect()}
    assert p["feature_003"]["missing_ratio"] > 0.5
    assert p["feature_000"]["variance"] == 0.0
    low = [r["feature_name"] for r in prof.low_variance_features(prof.feature_profile(df, cols)).collect()]
    assert low == ["feature_000"]
    for c in cols[1:6]:
        assert abs(p[c]["variance"] - pdf[c].var()) < 1e-9
        assert abs(p[c]["missing_ratio"] - pdf[c].isna().mean()) < 1e-12
    # long path gives the same table as the wide path
    saved = prof.WIDE_AGG_LIMIT
    prof.WIDE_AGG_LIMIT = 0
    try:
        q = {r["feature_name"]: r for r in prof.feature_profile(df, cols).collect()}
    finally:
        prof.WIDE_AGG_LIMIT = saved
    for c in cols:
        assert q[c]["n_present"] == p[c]["n_present"]


def test_variance_rules(spark):
    pdf = pd.DataFrame({"feature_000": [5.0] * 50,
                        "feature_001": [float(i) for i in range(40)] + [None] * 10})
    df = spark.createDataFrame(pdf).select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in pdf.columns])
    m = VarianceFilter(threshold=1e-6, ddof=1, inclusive=True).fit(df)
    assert m.get_feature_names_out() == ["feature_001"]


def test_missing_dropper_learns_on_train_only(spark):
    train = spark.createDataFrame(pd.DataFrame({
        "feature_000": [None] * 90 + [1.0] * 10, "feature_001": [float(i) for i in range(100)]}))
    test = spark.createDataFrame(pd.DataFrame({
        "feature_000": [float(i) for i in range(20)], "feature_001": [float(i) for i in range(20)]}))
    train = train.select(*[F.nanvl(F.col(c), F.lit(None)).alias(c) for c in train.columns])
    m = MissingRatioDropper(threshold=0.5).fit(train)
    assert m.transform(test).columns == ["feature_001"]


def test_exact_median_even_count(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "feature_000 double")
    assert exact_medians(df, ["feature_000"]).first()["median"] == 2.5
    m = MedianImputer().fit(df.union(spark.createDataFrame([(None,)], "feature_000 double")))
    vals = sorted(r[0] for r in m.transform(spark.createDataFrame([(None,), (7.0,)], "feature_000 double")).collect())
    assert vals == [2.5, 7.0]


def test_exact_median_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = np.concatenate([rng.normal(size=5001), np.full(3000, 1.5)])
    df = spark.createDataFrame([(float(v),) for v in vals], "feature_000 double")
    import sensor_yield.operators.quantiles as qmod
    assert abs(exact_medians(df, ["feature_000"]).first()["median"] - np.median(vals)) < 1e-12
    # the only path, with a coarse sketch (small and large groups, misses: test_scale_rules.py)
    assert abs(exact_medians(df, ["feature_000"], accuracy=50).first()["median"] - np.median(vals)) < 1e-12
    q = qmod.exact_quantiles(df, "feature_000", [], [0.1, 0.75], accuracy=50).first()
    assert abs(q["q0"] - np.quantile(vals, 0.1)) < 1e-12 and abs(q["q1"] - np.quantile(vals, 0.75)) < 1e-12


def test_scaler_population_std(spark):
    df = spark.createDataFrame([(1.0, 3.0), (3.0, 3.0)], "feature_000 double, feature_001 double")
    out = StandardScaler().fit(df).transform(df).orderBy("feature_000").collect()
    assert [r["feature_000"] for r in out] == [-1.0, 1.0] and [r["feature_001"] for r in out] == [0.0, 0.0]


def test_ordinal_and_cumsum_match_windows(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "k": rng.permutation(500), "v": rng.integers(0, 9, 500)})
    df = spark.createDataFrame(pdf)
    got = ordinal_within_group(df, ["g"], ["k"]).toPandas().set_index("k")["ordinal"]
    exp = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("k"))).toPandas() \
        .set_index("k")["rn"]
    assert (got.sort_index() == exp.sort_index()).all()
    cs = cumulative_sums(df, ["g"], [F.desc("k")], ["v"]).toPandas().set_index("k")["cum_v"]
    w = Window.partitionBy("g").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    ex = df.withColumn("c", F.sum("v").over(w)).toPandas().set_index("k")["c"]
    assert (cs.sort_index() == ex.sort_index()).all()


def test_split_exact_and_complete(spark):
    df, cols, pdf = _matrix_df(spark, n=1567)
    n_fail = int(pdf["Pass_Fail"].sum())
    out = stratified_split(df.select("row_id", "Pass_Fail"), "row_id").toPandas()
    assert len(out) == 1567 and out["row_id"].nunique() == 1567
    test = out[out.dataset_split == "test"]
    assert len(test) == int(np.ceil(0.2 * 1567))
    assert abs(test["Pass_Fail"].mean() - n_fail / 1567) < 0.01


def test_reference_allocation(spark):
    # 1,463 pass + 104 fail -> test 293 + 21, train 1,170 + 83
    df = spark.createDataFrame([(0,)] * 1463 + [(1,)] * 104, "Pass_Fail int")
    a = {r["Pass_Fail"]: (r["n_train"], r["n_test"]) for r in split_allocation(df, "Pass_Fail").collect()}
    assert a == {0: (1170, 293), 1: (83, 21)}


def test_folds_balanced(spark):
    df, _, _ = _matrix_df(spark, n=300)
    f = stratified_folds(df.select("row_id", "Pass_Fail"), "row_id").toPandas()
    sizes = f.groupby("fold").size()
    assert sizes.max() - sizes.min() <= 1 and set(sizes.index) == set(range(5))
    per = f.groupby(["Pass_Fail", "fold"]).size()
    assert (per.groupby(level=0).max() - per.groupby(level=0).min()).max() <= 1


def test_tied_scores_ap_and_auc(spark):
    rows = [(0.9, 1), (0.8, 0), (0.8, 1), (0.7, 0), (0.6, 1), (0.4, 0), (0.4, 0), (0.1, 0)]
    df = spark.createDataFrame(rows, "score double, Pass_Fail int")
    r = ev.ranking_metrics(df, "Pass_Fail", "score").first()
    assert round(r["pr_auc"], 6) == 0.755556 and round(r["roc_auc"], 6) == 0.833333


def test_recommendations_on_stored_table(spark):
    # threshold table of the reference's selected model (test split), retyped as literals
    rows = [
        (0.05, 1.0, 0.0670926517571885, 0.12574850299401197, 292, 0, 21, 1),
        (0.1, 1.0, 0.07167235494880546, 0.1337579617834395, 272, 0, 21, 21),
        (0.15, 1.0, 0.08571428571428572, 0.15789473684210525, 224, 0, 21, 69),
        (0.2, 0.9047619047619048, 0.10734463276836158, 0.1919191919191919, 158, 2, 19, 135),
        (0.25, 0.8571428571428571, 0.14754098360655737, 0.2517482517482518, 104, 3, 18, 189),
        (0.3, 0.8095238095238095, 0.20987654320987653, 0.3333333333333333, 64, 4, 17, 229),
        (0.35, 0.6190476190476191, 0.2826086956521739, 0.3880597014925373, 33, 8, 13, 260),
        (0.4, 0.23809523809523808, 0.17857142857142858, 0.20408163265306123, 23, 16, 5, 270),
        (0.45, 0.19047619047619047, 0.26666666666666666, 0.2222222222222222, 11, 17, 4, 282),
        (0.5, 0.047619047619047616, 0.16666666666666666, 0.07407407407407407, 5, 20, 1, 288),
        (0.55, 0.0, 0.0, 0.0, 2, 21, 0, 291),
    ] + [(t, 0.0, 0.0, 0.0, 0, 21, 0, 293) for t in (0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95)]
    table = spark.createDataFrame(rows, "threshold double, recall double, precision double, f1 double, "
                                        "false_positives int, false_negatives int, true_positives int, "
                                        "true_negatives int")
    for r in rows:  # identities hold and rows sum to 314
        assert r[4] + r[5] + r[6] + r[7] == 314
    rec = {r["strategy"]: r for r in ev.recommend_thresholds(table).collect()}
    assert rec["max_f1"]["threshold"] == 0.35
    assert rec["high_recall_min_precision_0.2"]["threshold"] == 0.3
    assert rec["high_precision_min_recall_0.5"]["threshold"] == 0.35
    assert rec["max_f1"]["true_positives"] == 13


def test_threshold_table_matches_loop(spark):
    rng = np.random.default_rng(5)
    s = np.round(rng.random(400), 2)
    y = (rng.random(400) < s * 0.6).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"score": s, "Pass_Fail": y}))
    got = {round(r["threshold"], 2): r for r in ev.threshold_table(df, "Pass_Fail", "score").collect()}
    for t in config.THRESHOLD_GRID:
        pred = s >= t
        tp = int(((y == 1) & pred).sum())
        fp = int(((y == 0) & pred).sum())
        assert got[t]["true_positives"] == tp and got[t]["false_positives"] == fp


def test_best_row_empty(spark):
    empty = spark.createDataFrame([], "Model string, PR_AUC double")
    assert ev.best_row(empty, "PR_AUC", "Model").count() == 0


def test_correlated_pair_found(spark):
    df, cols, _ = _matrix_df(spark)
    pairs = corr.high_correlation_pairs(df, cols, 0.9).collect()
    assert ("feature_001", "feature_002") in {(r["feature_1"], r["feature_2"]) for r in pairs}
    # pairwise-complete values equal pandas
    pdf = df.toPandas()
    full = {(r["feature_1"], r["feature_2"]): r["correlation"] for r in corr.pairwise_correlation(df, cols[:6]).collect()}
    pc = pdf[cols[:6]].corr()
    for (a, b), v in full.items():
        assert abs(v - pc.loc[a, b]) < 1e-9


def test_monotonic_check(spark):
    inc = spark.createDataFrame([(i, float(i // 2)) for i in range(100)], "k long, v double")
    assert prof.is_monotonic(inc, "k", "v").first()[0] is True
    dec = spark.createDataFrame([(i, float(i if i != 50 else -1)) for i in range(100)], "k long, v double")
    assert prof.is_monotonic(dec, "k", "v").first()[0] is False
    nul = spark.createDataFrame([(i, None if i == 3 else float(i)) for i in range(10)], "k long, v double")
    assert prof.is_monotonic(nul, "k", "v").first()[0] is False


def test_smote_balances_and_interpolates(spark):
    from pyspark.ml.feature import VectorAssembler

    from sensor_yield.operators.knn import neighbours
    from sensor_yield.operators.resample import smote
    rng = np.random.default_rng(7)
    n = 120
    x = rng.normal(size=(n, 3))
    y = np.zeros(n, dtype=int)
    y[:15] = 1
    pdf = pd.DataFrame(x, columns=["a", "b", "c"])
    pdf["row_id"] = np.arange(n)
    pdf["Pass_Fail"] = y
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(spark.createDataFrame(pdf))
    out = smote(df, "row_id", "Pass_Fail", "features", k=5).toPandas()
    counts = out.groupby("Pass_Fail").size()
    assert counts[0] == counts[1] == 105
    synth = out[out.row_id < 0]
    mins = x[:15]
    for v in synth["features"].head(20):
        v = np.asarray(v.toArray())
        # lies on a segment between two minority points
        ok = False
        for i in range(15):
            for j in range(15):
                d = mins[j] - mins[i]
                if i != j and np.dot(d, d) > 0:
                    u = np.dot(v - mins[i], d) / np.dot(d, d)
                    if -1e-9 <= u <= 1 + 1e-9 and np.allclose(mins[i] + u * d, v, atol=1e-9):
                        ok = True
        assert ok
    mins_df = df.where("Pass_Fail = 1")
    a = neighbours(mins_df, "row_id", "features", 5).toPandas().sort_values(["qid", "nb_rank"])
    b = neighbours(mins_df, "row_id", "features", 5, block_rows=3, pivots=4).toPandas().sort_values(["qid", "nb_rank"])
    assert a[["qid", "nb_rank", "nb_id"]].values.tolist() == b[["qid", "nb_rank", "nb_id"]].values.tolist()


def test_planted_signal_models_and_importance(spark):
    from sensor_yield.operators.importance import permutation_importance, rank_features
    from sensor_yield.operators.models import build_candidates, positive_probability
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(size=(n, 10))
    s = x[:, 0] + x[:, 1] + rng.normal(0, 0.3, n)
    y = (s >= np.quantile(s, 0.9)).astype(int)
    cols = [f"feature_{i:03d}" for i in range(10)]
    pdf = pd.DataFrame(x, columns=cols)
    pdf.insert(0, "Pass_Fail", y)
    pdf.insert(0, "row_id", np.arange(n))
    df = spark.createDataFrame(pdf)
    split = stratified_split(df, "row_id")
    train = split.where("dataset_split = 'train'").drop("dataset_split")
    test = split.where("dataset_split = 'test'").drop("dataset_split")
    cands = {c.name: c for c in build_candidates()}
    for name, p in [(config.MODEL_LOGISTIC, {"C": 1.0}),
                    (config.MODEL_FOREST_SMOTE, {"n_estimators": 30, "max_depth": 5, "min_samples_leaf": 1})]:
        model = cands[name].build(p).fit(train)
        scored = model.transform(test).select("Pass_Fail", positive_probability().alias("p"))
        probs = [r["p"] for r in scored.collect()]
        assert all(0.0 <= v <= 1.0 for v in probs)
        ap = ev.ranking_metrics(scored, "Pass_Fail", "p").first()["pr_auc"]
        assert ap > 0.25, (name, ap)  # positive rate is 0.10
    model = cands[config.MODEL_LOGISTIC].build({"C": 1.0}).fit(train)
    imp = rank_features(permutation_importance(model, test, "row_id", "Pass_Fail", cols, repeats=3))
    top = [r["feature_name"] for r in imp.orderBy("rank").limit(2).collect()]
    assert set(top) == {"feature_000", "feature_001"}
    from sensor_yield.operators.importance import attribution_importance
    att = rank_features(attribution_importance(model, test, "row_id", n_rows=60, draws=6))
    assert {r["feature_name"] for r in att.orderBy("rank").limit(2).collect()} == {"feature_000", "feature_001"}
    assert train.select("Pass_Fail").distinct().count() == 2
