"""EDA summary document (Entry 2, B16, B17): counts, missing profile, threshold
comparison, low variance, correlated pairs, time structure, PCA variance."""

from __future__ import annotations

from typing import Any

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA
from pyspark.sql import DataFrame, SparkSession

from sensor_yield import config
from sensor_yield.operators import correlation as corr
from sensor_yield.operators import profile as prof
from sensor_yield.operators.transforms import FeatureAssembler, MedianImputer, StandardScaler


def eda_summary(df: DataFrame, order_col: str = config.ROW_ID_COL, feature_cols: list[str] | None = None,
                pca_components: int = 2) -> dict[str, Any]:
    """One cached scan feeding a handful of aggregate jobs; returns the nested doc."""
    feature_cols = feature_cols or [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]
    data = df.cache()
    counts = prof.class_counts(data).first()
    p = prof.feature_profile(data, feature_cols).cache()
    summary = prof.missing_ratio_summary(p).first()
    comp = {r["threshold"]: r for r in prof.missing_threshold_comparison(p).collect()}
    low = prof.low_variance_counts(p).first()
    pairs = corr.pairwise_correlation(data, feature_cols, config.HIGH_CORR_THRESHOLD).count()
    dups = prof.duplicate_rows(data, feature_cols).first()["n_duplicate_rows"]
    doc: dict[str, Any] = {
        "n_rows": counts["n_rows"], "n_features": len(feature_cols), "n_columns": len(df.columns),
        "column_type_counts": dict(sorted({t: sum(1 for _, u in df.dtypes if u == t)
                                           for _, t in df.dtypes}.items())),
        "n_duplicate_feature_rows": dups, "fail_rate": counts["fail_rate"],
        "class_counts": {config.PASS_TEXT: counts["n_pass"], config.FAIL_TEXT: counts["n_fail"]},
        "missing_ratio": {"mean": summary["mean"], "median": summary["median"], "max": summary["max"]},
        "missing_threshold_comparison": [
            {"threshold": t, "n_dropped": comp[t]["n_dropped"], "n_kept": comp[t]["n_kept"]}
            for t in sorted(comp)],
        "n_low_variance_features": low["n_low_variance"],
        "n_high_correlation_pairs": pairs,
    }
    if config.TIME_COL in df.columns:
        ts = prof.time_structure(data, order_col).first()
        months = {r["year_month"]: r["fail_rate"] for r in prof.monthly_fail_rate(data).collect()}
        doc["time_structure"] = {
            "is_monotonic_time": ts["is_monotonic_time"], "time_span_days": ts["time_span_days"],
            "fail_rate_by_month": dict(sorted(months.items())),
            "fail_rate_std_across_months": ts["fail_rate_std_across_months"]}
    model = Pipeline(stages=[MedianImputer(), StandardScaler(), FeatureAssembler(),
                             PCA(k=pca_components, inputCol="features", outputCol="pca")]).fit(data)
    doc["pca_explained_variance"] = [float(v) for v in model.stages[-1].explainedVariance.toArray()]
    p.unpersist()
    data.unpersist()
    return doc



def document_rows(spark: SparkSession, doc: dict[str, Any]) -> DataFrame:
    """The document's numbers as rows ``path, value``: nested names joined by dots; entries of a threshold list go
    by their threshold, of other lists by their place."""
    rows: list[tuple[str, float]] = []

    def walk(path: str, value: Any) -> None:
        if isinstance(value, dict):
            for k, v in value.items():
                walk(f"{path}.{k}" if path else str(k), v)
        elif isinstance(value, (list, tuple)):
            for i, v in enumerate(value):
                named = isinstance(v, dict) and "threshold" in v
                walk(f"{path}.{v['threshold'] if named else i}", {k: x for k, x in v.items() if k != "threshold"} if named else v)
        elif value is not None and not isinstance(value, str):
            rows.append((path, float(value)))

    walk("", doc)
    return spark.createDataFrame(rows, "path string, value double")
