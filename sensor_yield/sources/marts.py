"""Readers of the exported marts (S07-S11), with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.plans.exports import (FEATURE_SUMMARY, IMPORTANCE, MASTER, MODEL_PERFORMANCE, THRESHOLDS,
                                        describe_path)
from sensor_yield.sources.raw_files import path_exists


class DashboardDataError(RuntimeError):
    """A required export is missing."""


FEATURE_SUMMARY_SCHEMA = "feature_name string, missing_ratio double, variance double, importance double, rank int"
MODEL_PERFORMANCE_SCHEMA = (
    "Model string, Preprocessing string, Sampling_Weighting string, Recall double, Precision double, F1 double, "
    "PR_AUC double, ROC_AUC double, False_Positives bigint, False_Negatives bigint, CV_PR_AUC_mean double, "
    "CV_PR_AUC_std double, CV_Recall_mean double, CV_Recall_std double")


def data_is_available(spark: SparkSession, root: str) -> bool:
    """The three exports the dashboard needs all exist."""
    return all(path_exists(spark, describe_path(root, n)) for n in (MASTER, FEATURE_SUMMARY, MODEL_PERFORMANCE))


def _require(spark: SparkSession, root: str, name: str) -> str:
    p = describe_path(root, name)
    if not path_exists(spark, p):
        raise DashboardDataError(f"Missing export {p}; run the training pipeline first.")
    return p


def load_master_table(spark: SparkSession, root: str) -> DataFrame:
    """Master table; ``Time`` re-parsed with invalid values to NULL."""
    df = spark.read.parquet(_require(spark, root, MASTER))
    t = F.col(config.TIME_COL)
    return df.withColumn(config.TIME_COL, F.try_to_timestamp(t.cast("string")).cast("timestamp_ntz"))


def load_feature_summary(spark: SparkSession, root: str) -> DataFrame:
    """S08."""
    return spark.read.schema(FEATURE_SUMMARY_SCHEMA).parquet(_require(spark, root, FEATURE_SUMMARY))


def load_model_performance(spark: SparkSession, root: str) -> DataFrame:
    """S08."""
    return spark.read.schema(MODEL_PERFORMANCE_SCHEMA).parquet(_require(spark, root, MODEL_PERFORMANCE))


def load_thresholds(spark: SparkSession, root: str, model: str) -> DataFrame:
    """One model's sweep sorted by threshold (partition pruning on ``model``);
    an empty frame when the export is absent."""
    p = describe_path(root, THRESHOLDS)
    if not path_exists(spark, p):
        return spark.createDataFrame([], "threshold double, recall double, precision double, f1 double")
    return spark.read.parquet(p).where(F.col("model") == model).orderBy("threshold")


def load_importance(spark: SparkSession, root: str) -> DataFrame:
    """S11."""
    return spark.read.parquet(_require(spark, root, IMPORTANCE))
