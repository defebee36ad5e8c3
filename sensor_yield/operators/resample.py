"""SMOTE oversampling inside an estimator's ``fit``.

Spark's ``Pipeline`` runs every stage at transform time, so resampling must live
inside ``fit`` to touch training rows only. Steps, all distributed:

1. class counts (one aggregate) fix the minority class and ``n_new = n_major - n_minor``;
2. exact k nearest minority neighbours of every minority row (``operators.knn``: pruned
   blocks, one path at every size);
3. synthetic row s picks a base row and one of its k neighbours and a step
   ``u`` from md5 keys of ``seed:s``: ``x + u * (nn - x)``, computed with
   ``zip_with`` on arrays (JVM side), then unioned with the original rows.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasSeed
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.keys import random_key, uniform01
from sensor_yield.operators.knn import neighbours
from sensor_yield.operators.ordering import ordinal_within_group


def synthetic_rows(df: DataFrame, id_col: str, label_col: str, features_col: str, k: int = config.SMOTE_NEIGHBOURS,
                   seed: int = config.SEED) -> DataFrame | None:
    """The new minority rows: ``s`` (0, 1, ...), ``label_col``, ``base_id``, ``nb_id``, ``u`` and ``x``, the point
    at share u of the way from the base to its neighbour; None where there is nothing to add."""
    counts = {r[label_col]: r["c"] for r in df.groupBy(label_col).agg(F.count(F.lit(1)).alias("c")).collect()}
    if len(counts) < 2:
        return None
    minority = min(counts, key=lambda c: (counts[c], c))
    n_min, n_maj = counts[minority], max(counts.values())
    n_new = n_maj - n_min
    if n_new <= 0 or n_min < 2:
        return None
    kk = min(k, n_min - 1)
    mins = df.where(F.col(label_col) == minority).select(F.col(id_col).cast("long").alias("base_id"),
                                                         F.col(features_col).alias("v"))
    ordered = ordinal_within_group(mins.select("base_id"), [], ["base_id"], out_col="base_ord")
    pick = F.floor(uniform01(random_key("s", seed, salt="smote_pick")) * F.lit(n_min * kk)).cast("long")
    synth = df.sparkSession.range(n_new).select(F.col("id").alias("s")).select(
        "s", ((pick / kk).cast("long") + 1).alias("base_ord"), (pick % kk).cast("int").alias("nb_rank"),
        uniform01(random_key("s", seed, salt="smote_step")).alias("u"))
    arrs = mins.select("base_id", vector_to_array("v").alias("bx"))
    rows = (synth.join(ordered, "base_ord")
            .join(neighbours(mins, "base_id", "v", kk).withColumnRenamed("qid", "base_id"), ["base_id", "nb_rank"])
            .join(arrs, "base_id")
            .join(arrs.withColumnRenamed("base_id", "nb_id").withColumnRenamed("bx", "nx"), "nb_id"))
    return rows.select("s", F.lit(minority).cast(df.schema[label_col].dataType).alias(label_col), "base_id", "nb_id", "u",
                       F.zip_with("bx", "nx", lambda a, b: a + F.col("u") * (b - a)).alias("x"))


def smote(df: DataFrame, id_col: str, label_col: str, features_col: str, k: int = config.SMOTE_NEIGHBOURS,
          seed: int = config.SEED) -> DataFrame:
    """Original rows plus synthetic minority rows up to the majority count.
    Output columns: ``id_col, label_col, features_col``; synthetic ids are negative."""
    base = df.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col), F.col(features_col))
    new = synthetic_rows(base, id_col, label_col, features_col, k, seed)
    if new is None:
        return base
    return base.unionByName(new.select((-(F.col("s") + 1)).alias(id_col), label_col, array_to_vector("x").alias(features_col)))


class SmoteClassifier(Estimator, HasFeaturesCol, HasLabelCol, HasSeed):
    """Fits ``classifier`` on SMOTE-resampled training rows; the fitted model is
    the classifier's own model, so scoring never resamples (R05 + M02)."""

    k = Param(Params._dummy(), "k", "neighbours", TypeConverters.toInt)
    idCol = Param(Params._dummy(), "idCol", "row id column", TypeConverters.toString)

    @keyword_only
    def __init__(self, classifier=None, k: int = config.SMOTE_NEIGHBOURS, idCol: str = config.ROW_ID_COL,
                 featuresCol: str = "features", labelCol: str = config.LABEL_COL, seed: int = config.SEED):
        super().__init__()
        self.classifier = classifier
        kwargs = dict(self._input_kwargs)
        kwargs.pop("classifier", None)
        self._setDefault(k=config.SMOTE_NEIGHBOURS, idCol=config.ROW_ID_COL, featuresCol="features",
                         labelCol=config.LABEL_COL, seed=config.SEED)
        self._set(**kwargs)

    def resampled(self, df: DataFrame) -> DataFrame:
        """The rows that the classifier is fitted on; they do not depend on its parameters. They are at most twice
        as many as those of ``df`` and stand in as many partitions, not in those of the joins that made them."""
        return smote(df, self.getOrDefault(self.idCol), self.getLabelCol(), self.getFeaturesCol(),
                     self.getOrDefault(self.k), self.getSeed()).coalesce(max(1, df.rdd.getNumPartitions()))

    def _fit(self, df: DataFrame):
        res = self.resampled(df).persist()
        try:  # one resampling per fit, however often the learner reads its rows
            return self.fit_resampled(res)
        finally:
            res.unpersist()

    def fit_resampled(self, res: DataFrame):
        return self.classifier.copy().setFeaturesCol(self.getFeaturesCol()).setLabelCol(
            self.getLabelCol()).fit(res)
