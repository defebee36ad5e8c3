"""Learned-transform and model queries.

``fitted_preprocessing`` has a SQL twin (every learned statistic is an aggregate
over the training split). The model queries fit iterative / randomised learners
and are checked by row counts here and by property tests in ``tests/``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.models import build_candidates
from sensor_yield.operators.resample import smote
from sensor_yield.operators.splits import stratified_split
from sensor_yield.operators.transforms import (FeatureAssembler, MedianImputer, MissingRatioDropper, StandardScaler,
                                               VarianceFilter, base_stages)
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.plans.flagship import scored_test_split
from sensor_yield.sources import driver_tables as D

EV = D.EVENT_FEATURES


def _event_split(spark, sf_dir):
    df = D.event_scores(spark, sf_dir).select(config.ROW_ID_COL, config.LABEL_COL, *EV)
    return stratified_split(df, config.ROW_ID_COL)


def _pre_sql() -> str:
    ratio = " UNION ALL ".join(
        f"SELECT '{c}' AS f, (count(*) - count({c})) / count(*) AS mr, median({c}) AS med FROM tr" for c in EV)
    return with_ctes(S.EVENT_SCORES, S.split_cte("ev"), f"""
tr AS (SELECT * FROM split WHERE dataset_split = 'train')""", f"""
st AS ({ratio})""", """
kept0 AS (SELECT f, med FROM st WHERE mr <= 0.5 AND med IS NOT NULL)""", f"""
trl AS (SELECT s.row_id, k.f, coalesce(v.value, k.med) AS x
        FROM tr s, kept0 k,
             LATERAL (SELECT CASE k.f {' '.join(f"WHEN '{c}' THEN s.{c}" for c in EV)} END AS value) v)""", """
vs AS (SELECT f, var_pop(x) AS vp, avg(x) AS mu, stddev_pop(x) AS sd FROM trl GROUP BY f)""", """
kept AS (SELECT k.f, k.med, vs.mu, CASE WHEN vs.sd = 0 OR vs.sd IS NULL THEN 1.0 ELSE vs.sd END AS sd
         FROM kept0 k JOIN vs USING (f) WHERE vs.vp > 1e-06)""", f"""
te AS (SELECT * FROM split WHERE dataset_split = 'test')""", f"""
tel AS (SELECT s.row_id, k.f AS feature_name, (coalesce(v.value, k.med) - k.mu) / k.sd AS value
        FROM te s, kept k,
             LATERAL (SELECT CASE k.f {' '.join(f"WHEN '{c}' THEN s.{c}" for c in EV)} END AS value) v)""") + f"""
SELECT row_id, feature_name, {R('value')} AS value FROM tel"""


@register("fitted_preprocessing", _pre_sql())
def q_fitted_preprocessing(spark, sf_dir):
    """T01 + T04 + T03 + T05 (T06 order): missing-ratio dropper, exact-median
    imputer, population-variance filter and scaler fitted on the training split of
    the events, applied to the test split; long form of the surviving columns."""
    split = _event_split(spark, sf_dir)
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    test = split.where(F.col("dataset_split") == "test").drop("dataset_split")
    pre = Pipeline(stages=[MissingRatioDropper(threshold=config.MODELING_MISSING_THRESHOLD), MedianImputer(),
                           VarianceFilter(threshold=config.LOW_VARIANCE_THRESHOLD, ddof=0, inclusive=False),
                           StandardScaler()]).fit(train)
    out = pre.transform(test)
    kept = [c for c in out.columns if c.startswith(config.FEATURE_PREFIX)]
    return rounded(out.select(config.ROW_ID_COL, *kept).unpivot([config.ROW_ID_COL], kept, "feature_name", "value"))


def _pca(spark, sf_dir, k: int = 2):
    df = D.embedding_sensors(spark, sf_dir)
    stages = [MedianImputer(), StandardScaler(), FeatureAssembler(), PCA(k=k, inputCol="features", outputCol="pca")]
    model = Pipeline(stages=stages).fit(df)
    return model, model.transform(df)


@register("pca_projection")
def q_pca_projection(spark, sf_dir):
    """Median-imputed, scaled full table projected on 2 principal components;
    sign fixed so each component's largest-magnitude loading is positive."""
    model, out = _pca(spark, sf_dir)
    pcs = model.stages[-1].pc.toArray()
    signs = [1.0 if pcs[abs(pcs[:, j]).argmax(), j] >= 0 else -1.0 for j in range(pcs.shape[1])]
    arr = vector_to_array(F.col("pca"))
    return out.select(config.ROW_ID_COL, config.LABEL_COL, (arr[0] * signs[0]).alias("pc1"),
                      (arr[1] * signs[1]).alias("pc2"))


@register("pca_explained_variance")
def q_pca_explained_variance(spark, sf_dir):
    """Explained variance ratio of the two components."""
    model, _ = _pca(spark, sf_dir)
    ev = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    return spark.createDataFrame([(i + 1, v) for i, v in enumerate(ev)], "component int, explained_variance double")


@register("pca_total_variance", with_ctes(S.EMBEDDING_LONG) + """
, f AS (SELECT f, var_pop(v) AS vp, count(*) AS n FROM long GROUP BY f)
SELECT CAST(count(*) AS BIGINT) AS n_components, round(sum(CASE WHEN vp > 0 THEN 1 ELSE 0 END) * max(n) / (max(n) - 1.0), 6) + 0.0
         AS total_variance, CAST(0 AS BIGINT) AS n_unordered FROM f""")
def q_pca_total_variance(spark, sf_dir):
    """Over all components, the variances of the projections fall and add up to the trace
    (one per scaled column, as a sample variance)."""
    df = D.embedding_sensors(spark, sf_dir)
    width = sum(c.startswith(config.FEATURE_PREFIX) for c in df.columns)
    _, out = _pca(spark, sf_dir, width)
    arr = vector_to_array(F.col("pca"))
    long = out.select(F.posexplode(arr).alias("i", "x")).groupBy("i").agg(F.var_samp("x").alias("v"))
    before = F.lag("v").over(Window.orderBy("i"))  # one row per component
    return rounded(long.withColumn("up", (F.col("v") > before + 1e-9).cast("int")).agg(
        F.count(F.lit(1)).alias("n_components"), F.sum("v").alias("total_variance"),
        F.coalesce(F.sum("up"), F.lit(0)).cast("bigint").alias("n_unordered")))


_SMOTE_COUNTS = with_ctes(S.EMBEDDING_ROWS, S.split_cte("emb"), """
c AS (SELECT Pass_Fail, count(*) AS n FROM split WHERE dataset_split = 'train' GROUP BY Pass_Fail)""", """
mino AS (SELECT Pass_Fail FROM c ORDER BY n, Pass_Fail LIMIT 1)""") + """
SELECT Pass_Fail, false AS synthetic, CAST(n AS BIGINT) AS n FROM c
UNION ALL
SELECT m.Pass_Fail, true, CAST((SELECT max(n) FROM c) - c.n AS BIGINT)
FROM mino m JOIN c USING (Pass_Fail) WHERE (SELECT max(n) FROM c) > c.n"""


@register("smote_training_rows", _SMOTE_COUNTS)
def q_smote_training_rows(spark, sf_dir):
    """Class counts of the embedding training split after SMOTE (minority
    raised to the majority count) on the preprocessed vectors; original and
    synthetic rows counted apart."""
    df = D.embedding_sensors(spark, sf_dir)
    split = stratified_split(df, config.ROW_ID_COL)
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    prepared = Pipeline(stages=base_stages()).fit(train).transform(train)
    res = smote(prepared, config.ROW_ID_COL, config.LABEL_COL, "features")
    return res.groupBy(config.LABEL_COL, (F.col(config.ROW_ID_COL) < 0).alias("synthetic")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@register("logistic_test_scores")
def q_logistic_test_scores(spark, sf_dir):
    """M01 + M08 + T06: the logistic baseline (C = 0.1) fitted on the embedding
    training split, positive-class probabilities of the test rows."""
    return scored_test_split(spark, sf_dir, config.MODEL_LOGISTIC, {"C": 0.1})


@register("forest_class_weight_scores")
def q_forest_class_weight_scores(spark, sf_dir):
    """Balanced-weight random forest (100 trees, depth 8, leaf 2) on the
    embedding training split, test-row probabilities."""
    return scored_test_split(spark, sf_dir, config.MODEL_FOREST_WEIGHTS,
                             {"n_estimators": 100, "max_depth": 8, "min_samples_leaf": 2})


@register("boosting_scale_pos_scores")
def q_boosting_scale_pos_scores(spark, sf_dir):
    """M04 + M05: boosted trees with the train class-ratio weight on un-imputed
    columns with missing indicators, test-row probabilities."""
    return scored_test_split(spark, sf_dir, config.MODEL_BOOSTING,
                             {"n_estimators": 50, "max_depth": 3, "learning_rate": 0.1, "subsample": 0.85})


_SCORE_FACTS = with_ctes(S.EMBEDDING_ROWS, S.split_cte("emb")) + """
SELECT row_id, Pass_Fail, true AS is_probability FROM split WHERE dataset_split = 'test'"""


def _score_facts(scored):
    """What holds of any fitted model's held-out scores: whose they are, and that they are
    probabilities."""
    p = F.col("fail_probability")
    return scored.select(config.ROW_ID_COL, config.LABEL_COL, (p.isNotNull() & p.between(0.0, 1.0)).alias("is_probability"))


@register("logistic_score_facts", _SCORE_FACTS)
def q_logistic_score_facts(spark, sf_dir):
    """M01 + M08: held-out rows, classes and range of the logistic scores."""
    return _score_facts(q_logistic_test_scores(spark, sf_dir))


@register("forest_score_facts", _SCORE_FACTS)
def q_forest_score_facts(spark, sf_dir):
    """Held-out rows, classes and range of the forest scores."""
    return _score_facts(q_forest_class_weight_scores(spark, sf_dir))


@register("boosting_score_facts", _SCORE_FACTS)
def q_boosting_score_facts(spark, sf_dir):
    """M04 + M05: held-out rows, classes and range of the boosted scores."""
    return _score_facts(q_boosting_scale_pos_scores(spark, sf_dir))


@register("model_comparison")
def q_model_comparison(spark, sf_dir):
    """M06 + M07 + A16 + E08 + M09: the four candidates searched with stratified
    5-fold CV on the embedding training split (20 settings of each whole search space),
    refitted, and compared on the test split (one row per model)."""
    from sensor_yield.plans import training

    return training.run_training(D.embedding_sensors(spark, sf_dir))["comparison"]


@register("attribution_importance")
def q_attribution_importance(spark, sf_dir):
    """E11 (re-aimed): Monte-Carlo Shapley mean |contribution| per model input of
    the logistic baseline, on a 200-row seeded sample of the embedding test split."""
    from sensor_yield.operators.importance import attribution_importance, rank_features

    df = D.embedding_sensors(spark, sf_dir)
    split = stratified_split(df, config.ROW_ID_COL)
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    test = split.where(F.col("dataset_split") == "test").drop("dataset_split")
    cand = {c.name: c for c in build_candidates()}[config.MODEL_LOGISTIC]
    model = cand.build({"C": 0.1}).fit(train)
    return rank_features(attribution_importance(model, test, config.ROW_ID_COL))
