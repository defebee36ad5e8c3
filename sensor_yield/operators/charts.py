"""The data behind the exploration charts and the dashboard guide's tables (B15, B17), one query each.

Everything is long form, so a chart reads rows and draws; nothing is drawn here. ``chart_datasets`` gathers
the exploration charts of a normalised table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.labels import label_text
from sensor_yield.operators import correlation as corr
from sensor_yield.operators import profile as prof
from sensor_yield.operators.dashboard import grouped_boxes, value_histogram
from sensor_yield.operators.transforms import FeatureAssembler, MedianImputer, StandardScaler

USABLE, UNUSABLE = "Usable", "Constant/Low-Variance"


def class_bars(df: DataFrame, label_col: str = config.LABEL_COL) -> DataFrame:
    """``class, n``: rows per class, larger first."""
    return (df.groupBy(label_text(F.col(label_col)).alias("class")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.desc("n"), "class"))


def usable_bars(profile: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD) -> DataFrame:
    """``kind, n_features``: usable features and those without variance."""
    kinds = F.array(F.struct(F.lit(USABLE).alias("kind"), F.col("n_usable").alias("n_features")),
                    F.struct(F.lit(UNUSABLE).alias("kind"), F.col("n_low_variance").alias("n_features")))
    return prof.low_variance_counts(profile, threshold).select(F.inline(kinds))


def heat_map(df: DataFrame, profile: DataFrame, n: int = config.TOP_N_FEATURES) -> DataFrame:
    """``feature_1, feature_2, correlation`` of the ``n`` features with the largest variance."""
    top = [r.feature_name for r in prof.top_features(profile, "variance", n).collect()]  # n names
    return corr.correlation_matrix(df, top)


def class_boxes(df: DataFrame, features: Sequence[str], class_col: Column | str = config.LABEL_TEXT_COL) -> DataFrame:
    """``feature_name, class`` and their box statistics: several sensors side by side, from one long table."""
    c = F.col(class_col) if isinstance(class_col, str) else class_col
    long = (df.select(c.alias("class"), *[F.col(f).cast("double").alias(f) for f in features])
            .unpivot(["class"], list(features), "feature_name", "v"))
    return grouped_boxes(long, ["feature_name", "class"])


def pca_points(df: DataFrame, feature_cols: Sequence[str], id_col: str = config.ROW_ID_COL,
               label_col: str = config.LABEL_COL) -> DataFrame:
    """``id, class, pc1, pc2`` of every row, imputed and scaled over the whole table; each component's largest
    loading is positive."""
    stages = [MedianImputer(inputCols=list(feature_cols)), StandardScaler(), FeatureAssembler(),
              PCA(k=2, inputCol="features", outputCol="pca")]
    rows = df.select(id_col, label_col, *feature_cols)
    model = Pipeline(stages=stages).fit(rows)
    loadings = model.stages[-1].pc.toArray()
    sign = [1.0 if loadings[abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in range(2)]
    at = vector_to_array("pca")
    return model.transform(rows).select(id_col, label_text(F.col(label_col)).alias("class"),
                                        *[(at[j] * sign[j]).alias(f"pc{j + 1}") for j in range(2)])


def chart_datasets(df: DataFrame, feature_cols: Sequence[str] | None = None, n_boxes: int = 6) -> dict[str, DataFrame]:
    """Chart name -> its rows, for a normalised table."""
    feature_cols = list(feature_cols or [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)])
    profile = prof.feature_profile(df, feature_cols).cache()  # one row per feature
    boxes = [r.feature_name for r in prof.top_features(profile, "variance", n_boxes).collect()]
    return {"class_distribution": class_bars(df),
            "missing_ratio_histogram": value_histogram(profile, "missing_ratio"),
            "top_missing_features": prof.top_features(profile, "missing_ratio"),
            "constant_feature_count": usable_bars(profile),
            "correlation_heatmap_top_variance": heat_map(df, profile),
            "sensor_distribution_by_class": class_boxes(df, boxes, label_text(F.col(config.LABEL_COL))),
            "pca_2d_projection": pca_points(df, feature_cols)}


def sensor_trellis(master: DataFrame, summary: DataFrame, n: int = 2) -> DataFrame:
    """Box statistics by class of the ``n`` most important sensors of the test rows, one panel per sensor
    (``rank, feature_name, class, ...``)."""
    top = {r.feature_name: r["rank"] for r in summary.where(F.col("rank") <= n).select("feature_name", "rank").collect()}  # n rows
    ranks = F.create_map(*[F.lit(v) for f, r in top.items() for v in (f, r)])
    boxes = class_boxes(master.where(F.col("dataset_split") == "test"), list(top))
    return boxes.withColumn("rank", ranks[F.col("feature_name")])


def threshold_cross_table(thresholds: DataFrame, models: Sequence[str], model_col: str = "model") -> DataFrame:
    """Thresholds down, ``<model>_recall``, ``_precision`` and ``_f1`` across."""
    cells = [F.first(c).alias(c) for c in ("recall", "precision", "f1")]
    return thresholds.groupBy("threshold").pivot(model_col, list(models)).agg(*cells)
