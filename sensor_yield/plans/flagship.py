"""Flagship query: split -> fit -> score -> threshold sweep on the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators.models import build_candidates, positive_probability
from sensor_yield.operators.splits import stratified_split
from sensor_yield.sources import driver_tables as D


def scored_test_split(spark: SparkSession, sf_dir: str, model_name: str = config.MODEL_LOGISTIC,
                      params: dict | None = None) -> DataFrame:
    """Exact stratified split of the embedding rows (Fail = class 0), candidate
    ``model_name`` fitted on train only, test rows scored: ``row_id, Pass_Fail,
    fail_probability``."""
    df = D.embedding_sensors(spark, sf_dir)
    split = stratified_split(df, config.ROW_ID_COL)
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    test = split.where(F.col("dataset_split") == "test").drop("dataset_split")
    cand = {c.name: c for c in build_candidates(include_boosting=True)}[model_name]
    model = cand.build(params or {"C": 1.0}).fit(train)
    return model.transform(test).select(config.ROW_ID_COL, config.LABEL_COL,
                                        positive_probability().alias("fail_probability"))


def flagship_threshold_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19-row threshold table of the logistic baseline on the held-out split."""
    scores = scored_test_split(spark, sf_dir)
    return ev.threshold_table(scores, config.LABEL_COL, "fail_probability")
