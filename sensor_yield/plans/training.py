"""End-to-end training run (Entry 1): split -> search with stratified CV ->
held-out evaluation -> selection -> importance -> report and marts.

Data never leaves Spark: folds are a column, every fit sees only its fold's
training rows (all learned state sits in pipeline stages), every metric is one
grouped query over a union of score sets. The driver only loops over the small
list of (candidate, fold, setting) fits and collects small metric tables.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators.importance import feature_importance, rank_features
from sensor_yield.operators.models import Candidate, build_candidates, positive_probability
from sensor_yield.operators.splits import stratified_folds, stratified_split
from sensor_yield.plans.shared_fits import SharedFits
from sensor_yield.session import cut_lineage

SCORE = "fail_probability"
METRICS = ("recall", "precision", "f1", "pr_auc", "roc_auc")


@dataclass
class SearchResult:
    name: str
    best_params: dict[str, Any]
    cv_summary: dict[str, dict[str, float]]
    model: PipelineModel
    all_settings: list[dict[str, Any]] = field(default_factory=list)


def _score(model, df: DataFrame, id_col: str, label_col: str) -> DataFrame:
    return model.transform(df).select(id_col, label_col, positive_probability().alias(SCORE))


def score_rows(model, df: DataFrame, id_col: str = config.ROW_ID_COL) -> DataFrame:
    """Raw rows plus the model's ``fail_probability``. The fitted stages
    rewrite feature columns (imputed, scaled, dropped), so the probability is
    joined back to the untouched rows on the row key."""
    probs = model.transform(df).select(id_col, positive_probability().alias(SCORE))
    return df.join(probs, id_col, "inner")


def random_search(cand: Candidate, train: DataFrame, id_col: str, label_col: str = config.LABEL_COL,
                  n_iter: int = config.N_RANDOM_SEARCH_ITER, k: int = config.CV_FOLDS,
                  seed: int = config.SEED, parallelism: int = 4, fits: SharedFits | None = None) -> SearchResult:
    """Settings x folds fits; preprocessing is fitted once per fold (it does not depend on the
    classifier settings) and, with ``fits`` over the same folds, once for all candidates that begin alike;
    all fold scores are evaluated in one grouped plan; the best setting by mean
    CV PR-AUC (first setting wins ties) is refitted on the whole training set."""
    if fits is None:
        own = shared_fits(train, id_col, label_col, k, seed)
        try:
            return random_search(cand, train, id_col, label_col, n_iter, k, seed, parallelism, own)
        finally:
            own.close()
    settings = cand.settings(n_iter, seed)

    def run_fold(f: int) -> list[DataFrame]:
        va = fits.prepared(f, cand.pre())[2]
        # scores are written at once, so one model a fold is held, not all of the search
        return [cut_lineage(_score(fits.fit(f, cand.pre(), cand.clf(p)), va, id_col, label_col)
                            .withColumn("setting", F.lit(i)).withColumn("fold", F.lit(f)))
                for i, p in enumerate(settings)]

    # folds are independent: their fits run as concurrent Spark jobs
    with ThreadPoolExecutor(max_workers=max(1, min(k, parallelism))) as pool:
        scored_parts = [p for parts in pool.map(run_fold, range(k)) for p in parts]
    scores = scored_parts[0]
    for s in scored_parts[1:]:
        scores = scores.unionByName(s)
    fold_metrics = ev.metrics_at_threshold(scores, label_col, SCORE, config.DEFAULT_DECISION_THRESHOLD,
                                           ["setting", "fold"])
    summary = ev.cv_summary(fold_metrics, ["setting"], list(METRICS)).collect()
    table: dict[int, dict[str, dict[str, float]]] = {}
    for r in summary:
        table.setdefault(r["setting"], {})[r["metric"]] = {"mean": r["mean"], "std": r["std"]}

    def key(i):
        m = table.get(i, {}).get("pr_auc", {}).get("mean")
        return (-(m if m is not None else float("-inf")), i)

    best = min(range(len(settings)), key=key)
    models = fits.prepared(None, cand.pre())[0]
    model = PipelineModel(stages=[*models, fits.fit(None, cand.pre(), cand.clf(settings[best]))])
    return SearchResult(cand.name, settings[best], table.get(best, {}), model, settings)


def shared_fits(train: DataFrame, id_col: str, label_col: str = config.LABEL_COL, k: int = config.CV_FOLDS,
                seed: int = config.SEED) -> SharedFits:
    """Stratified folds of the training rows, assigned once, with the fits made on them."""
    return SharedFits(cut_lineage(stratified_folds(train, id_col, label_col, k, seed)))


def run_training(df: DataFrame, id_col: str = config.ROW_ID_COL, label_col: str = config.LABEL_COL,
                 feature_cols: list[str] | None = None, candidates: list[Candidate] | None = None,
                 n_iter: int = config.N_RANDOM_SEARCH_ITER, k: int = config.CV_FOLDS, seed: int = config.SEED,
                 importance_repeats: int = config.PERMUTATION_REPEATS, parallelism: int = 4,
                 select_on: str = "test", importance_method: str = "permutation_importance") -> dict[str, Any]:
    """Entry 1 as Spark jobs. Returns DataFrames and the final report dict.

    ``select_on='test'`` picks the final model by held-out PR-AUC (the
    reference's rule, which also tunes on the test split); ``'cv'`` picks by the
    mean cross-validated PR-AUC and leaves the test split untouched by selection.
    ``importance_method``: see ``feature_importance``."""
    feature_cols = feature_cols or [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]
    # the split's staged rows are already checkpointed inside the distributed
    # ordinal; the offset join on top is a broadcast, so caching suffices here
    split = stratified_split(df, id_col, label_col, config.TEST_SIZE, seed).cache()
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    test = split.where(F.col("dataset_split") == "test").drop("dataset_split")
    candidates = candidates or build_candidates(seed)

    fits = shared_fits(train, id_col, label_col, k, seed)
    try:
        # candidates are independent: their searches run as concurrent Spark jobs
        with ThreadPoolExecutor(max_workers=max(1, min(len(candidates), parallelism))) as pool:
            results = list(pool.map(lambda c: random_search(c, train, id_col, label_col, n_iter, k, seed, parallelism, fits),
                                    candidates))
    finally:
        fits.close()
    test_scores = None
    for r in results:
        s = _score(r.model, test, id_col, label_col).withColumn("model", F.lit(r.name))
        test_scores = s if test_scores is None else test_scores.unionByName(s)
    test_scores = cut_lineage(test_scores)
    metrics = ev.metrics_at_threshold(test_scores, label_col, SCORE, config.DEFAULT_DECISION_THRESHOLD, ["model"])
    thresholds = ev.threshold_table(test_scores, label_col, SCORE, config.THRESHOLD_GRID, ["model"])
    comparison = model_comparison(metrics, results, candidates)
    sel_metric = "PR_AUC" if select_on == "test" else "CV_PR_AUC_mean"
    best_name = ev.best_row(comparison, sel_metric, "Model").first()["Model"]
    best = {r.name: r for r in results}[best_name]
    recs = ev.recommend_thresholds(thresholds.where(F.col("model") == best_name).drop("model"))
    imp = rank_features(feature_importance(best.model, test, id_col, label_col, feature_cols, importance_method,
                                           importance_repeats, seed))
    counts = split.groupBy("dataset_split").agg(F.count(F.lit(1)).alias("n"),
                                                F.avg(F.col(label_col).cast("double")).alias("rate")).collect()
    sizes = {r["dataset_split"]: (r["n"], r["rate"]) for r in counts}
    best_metrics = metrics.where(F.col("model") == best_name).drop("model").first().asDict()
    report = {
        "best_model": best_name,
        "best_model_preprocessing": best_candidate(candidates, best_name).preprocessing,
        "best_model_sampling": best_candidate(candidates, best_name).sampling,
        "selection_criterion": "held-out test PR-AUC" if select_on == "test" else "mean CV PR-AUC",
        "test_metrics_threshold_0.5": best_metrics,
        "cross_validation_summary": best.cv_summary,
        "threshold_recommendations": {r["strategy"]: {k2: v for k2, v in r.asDict().items() if k2 != "strategy"}
                                      for r in recs.collect()},
        "importance_method": importance_method,
        "n_train": sizes.get("train", (0, None))[0], "n_test": sizes.get("test", (0, None))[0],
        "train_fail_rate": sizes.get("train", (0, None))[1], "test_fail_rate": sizes.get("test", (0, None))[1],
        "all_models_cv_summary": {r.name: r.cv_summary for r in results},
        "all_models_best_params": {r.name: r.best_params for r in results},
    }
    return {"split": split, "train": train, "test": test, "results": results, "test_scores": test_scores,
            "metrics": metrics, "thresholds": thresholds, "comparison": comparison, "best_model": best_name,
            "importance": imp, "recommendations": recs, "report": report}


def best_candidate(cands: list[Candidate], name: str) -> Candidate:
    return {c.name: c for c in cands}[name]


def model_comparison(metrics: DataFrame, results: list[SearchResult], cands: list[Candidate]) -> DataFrame:
    """One row per model: descriptive texts, test metrics at 0.5, CV mean/std."""
    spark = metrics.sparkSession
    rows = []
    for r in results:
        c = best_candidate(cands, r.name)
        cv = r.cv_summary
        rows.append((r.name, c.preprocessing, c.sampling,
                     cv.get("pr_auc", {}).get("mean"), cv.get("pr_auc", {}).get("std"),
                     cv.get("recall", {}).get("mean"), cv.get("recall", {}).get("std")))
    side = spark.createDataFrame(rows, "Model string, Preprocessing string, Sampling_Weighting string, "
                                       "CV_PR_AUC_mean double, CV_PR_AUC_std double, CV_Recall_mean double, "
                                       "CV_Recall_std double")
    m = metrics.select(F.col("model").alias("Model"), F.col("recall").alias("Recall"),
                       F.col("precision").alias("Precision"), F.col("f1").alias("F1"),
                       F.col("pr_auc").alias("PR_AUC"), F.col("roc_auc").alias("ROC_AUC"),
                       F.col("false_positives").alias("False_Positives"),
                       F.col("false_negatives").alias("False_Negatives"))
    return side.join(m, "Model").select("Model", "Preprocessing", "Sampling_Weighting", "Recall", "Precision", "F1",
                                        "PR_AUC", "ROC_AUC", "False_Positives", "False_Negatives", "CV_PR_AUC_mean",
                                        "CV_PR_AUC_std", "CV_Recall_mean", "CV_Recall_std")


def report_json(report: dict[str, Any]) -> str:
    """K06 helper: the nested report as JSON (numbers as plain floats/ints)."""
    return json.dumps(report, indent=2, default=lambda o: float(o) if hasattr(o, "__float__") else str(o))
