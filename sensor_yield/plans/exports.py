"""Sinks (K01-K09): the marts dashboards read, written once by Spark writers.

Every table is written as parquet (the format the readers prefer: typed,
column-pruned, predicate push-down) and, where a BI tool expects it, as CSV with a
header. Paths may be any cluster file system URI; nothing is staged locally.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

MASTER = "master"
FEATURE_SUMMARY = "feature_summary"
MODEL_PERFORMANCE = "model_performance"
THRESHOLDS = "thresholds"
IMPORTANCE = "feature_importance"


def _path(root: str, name: str, fmt: str = "parquet") -> str:
    return f"{root.rstrip('/')}/{name}.{fmt}"


def write_table(df: DataFrame, root: str, name: str, csv: bool = True, partition_by: str | None = None,
                order_by: str | None = None) -> None:
    """Parquet first; the CSV is written from it, so the plan of ``df`` runs once."""
    def writer(frame: DataFrame):
        w = frame.write.mode("overwrite")
        return w.partitionBy(partition_by) if partition_by else w

    writer(df.orderBy(order_by) if order_by else df).parquet(_path(root, name))
    if csv:
        written = df.sparkSession.read.parquet(_path(root, name))
        # reading packs files by size, so an ordered mart is ordered again (a sort of the mart alone)
        writer(written.orderBy(order_by) if order_by else written).option("header", True).csv(_path(root, name, "csv"))


def write_master(master: DataFrame, root: str) -> None:
    """All rows, both splits, sorted by row_id (range-partitioned sort)."""
    write_table(master, root, MASTER, order_by="row_id")


def write_feature_summary(summary: DataFrame, root: str) -> None:
    """K02."""
    write_table(summary, root, FEATURE_SUMMARY)


def write_model_performance(comparison: DataFrame, root: str) -> None:
    """Written once; both consumers read this one table."""
    write_table(comparison, root, MODEL_PERFORMANCE)


def write_thresholds(thresholds: DataFrame, root: str) -> None:
    """One long table partitioned by model (a model's sweep is one directory)."""
    write_table(thresholds, root, THRESHOLDS, partition_by="model")


def write_importance(importance: DataFrame, root: str) -> None:
    """K05."""
    write_table(importance, root, IMPORTANCE)


def write_json(spark: SparkSession, doc: dict[str, Any], path: str) -> None:
    """A nested document as one JSON line (numpy / Spark scalars as numbers)."""
    text = json.dumps(doc, default=lambda o: float(o) if hasattr(o, "__float__") else str(o))
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_json(spark: SparkSession, path: str) -> dict[str, Any]:
    """Read a document written by ``write_json``."""
    row = spark.read.text(path).first()
    return json.loads(row["value"]) if row else {}


def save_models(models: dict[str, PipelineModel], root: str, final_name: str | None = None) -> None:
    """Fitted pipelines via ML persistence (custom stages are ML-writable)."""
    for name, m in models.items():
        m.write().overwrite().save(f"{root.rstrip('/')}/models/{name}")
    if final_name is not None:
        models[final_name].write().overwrite().save(f"{root.rstrip('/')}/models/final_model")


def export_filtered(rows: DataFrame, path: str) -> None:
    """Every filtered detail row (no 500-row cap), CSV with header."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def describe_path(root: str, name: str) -> str:
    return _path(root, name)

