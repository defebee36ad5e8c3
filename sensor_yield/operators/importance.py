"""Permutation importance, attributions and feature ranking.

importance(f) = AP(baseline) - mean over repeats of AP(scores with column f
permuted), on held-out rows. Rows are numbered once; a keyed bijection of their
positions (``functions.bijection``, one key per feature and repeat) says where a row's
value goes, so a repeat needs no sort. Only (position, value) pairs are shuffled; they
come back as one array per row, and the copies that one ``model.transform`` scores are
made next to it and not moved. Batches keep rows x batch under a bound. Columns that
the fitted pipeline drops cannot change a score; they get importance 0 without scoring.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.bijection import bijection, code_of
from sensor_yield.operators.boosting import HistogramBoostingModel
from sensor_yield.operators.evaluation import ranking_metrics
from sensor_yield.operators.models import positive_probability
from sensor_yield.operators.ordering import ordinal_within_group
from sensor_yield.operators.splits import sample_rows
from sensor_yield.operators.trees import attributions, expected_value, spark_trees

MAX_REPLICATED_ROWS = 50_000_000
#: (feature, repeat) pairs scored together: the length of a row's array of incoming values.
MAX_BATCH = 256


def used_features(model: PipelineModel, cols: Sequence[str]) -> list[str]:
    """Input columns that survive the fitted selection / imputation stages."""
    dropped: set[str] = set()
    only: set[str] | None = None
    for st in model.stages:
        if st.hasParam("droppedCols"):
            dropped |= set(st.getOrDefault(st.getParam("droppedCols")))
        if st.hasParam("usedCols") and st.isDefined(st.getParam("usedCols")):
            only = set(st.getOrDefault(st.getParam("usedCols")))
    return [c for c in cols if c not in dropped and (only is None or c in only)]


def permutation_importance(model: PipelineModel, df: DataFrame, id_col: str, label_col: str,
                           cols: Sequence[str], repeats: int = config.PERMUTATION_REPEATS,
                           seed: int = config.SEED, max_rows: int = MAX_REPLICATED_ROWS) -> DataFrame:
    """``feature_name, importance`` for every column of ``cols``."""
    spark = df.sparkSession
    cols = list(cols)
    # the numbered rows are checkpointed: the table is made once for the baseline and every batch
    numbered = ordinal_within_group(df.select(id_col, label_col, *cols), [], [id_col], out_col="__pos") \
        .withColumn("__pos", F.col("__pos") - 1)
    base = numbered.drop("__pos")
    score = positive_probability().alias("__score")
    baseline = ranking_metrics(model.transform(base).select(label_col, score), label_col, "__score") \
        .first()["pr_auc"]
    n_rows = base.count()
    active = used_features(model, cols)
    pairs = [(f, r) for f in active for r in range(repeats)]
    batch = max(1, min(len(pairs), MAX_BATCH, max_rows // max(n_rows, 1)))
    results = []
    for s in range(0, len(pairs), batch):
        part = pairs[s:s + batch]
        entries = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(code_of(seed, f, r)).alias("code"),
                                     F.col(f).cast("double").alias("v")) for i, (f, r) in enumerate(part)])
        sent = (numbered.select("__pos", F.explode(entries).alias("e"))
                .select(bijection(F.col("__pos"), F.col("e.code"), n_rows).alias("__pos"), "e.i", "e.v"))
        swaps = sent.groupBy("__pos").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("__swaps"))
        index = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(r).alias("r")) for f, r in part])
        copies = (numbered.join(swaps, "__pos").select(*base.columns, F.explode("__swaps").alias("__s"))
                  .select(*base.columns, F.col("__s.v").alias("__v"), index[F.col("__s.i")].alias("__p"))
                  .select(label_col, F.col("__p.f").alias("__f"), F.col("__p.r").alias("__r"), id_col, *[
                      F.when(F.col("__p.f") == c, F.col("__v")).otherwise(F.col(c).cast("double")).alias(c) for c in cols]))
        scored = model.transform(copies).select("__f", "__r", label_col, score)
        results.append(ranking_metrics(scored, label_col, "__score", ["__f", "__r"]))
    names = spark.createDataFrame([(c,) for c in cols], "feature_name string")
    if not results:
        return names.select("feature_name", F.lit(0.0).alias("importance"))
    allr = results[0]
    for r in results[1:]:
        allr = allr.unionByName(r)
    imp = allr.groupBy(F.col("__f").alias("feature_name")).agg(
        (F.lit(float(baseline)) - F.avg("pr_auc")).alias("importance"))
    return names.join(imp, "feature_name", "left").select(
        "feature_name", F.coalesce(F.col("importance"), F.lit(0.0)).alias("importance"))


def rank_features(importance: DataFrame) -> DataFrame:
    """Unique 1..n rank by importance descending, feature name breaking ties.
    One row per feature, so the global window is bounded by the feature count."""
    w = Window.orderBy(F.desc_nulls_last("importance"), F.asc("feature_name"))
    return importance.withColumn("rank", F.row_number().over(w).cast("int"))


def model_trees(clf) -> tuple[list, str] | None:
    """The trees of a fitted tree ensemble and what they add up to; None for other classifiers."""
    if isinstance(clf, HistogramBoostingModel):
        return clf.tree_list(), "margin"
    if isinstance(clf, (RandomForestClassificationModel, GBTClassificationModel)):
        return spark_trees(clf)
    return None


def tree_attributions(model: PipelineModel, df: DataFrame, id_col: str) -> tuple[DataFrame, list[str], float]:
    """E11, exact: ``id_col, phi`` of every row of ``df`` (path-dependent Shapley values of the classifier's
    inputs), the inputs' names and the mean value; mean + sum(phi) is the row's probability for a forest and
    its margin for boosted trees."""
    prepared = PipelineModel(stages=model.stages[:-1]).transform(df)
    names = [c for c in prepared.columns if c.startswith(config.FEATURE_PREFIX)]
    trees, _ = model_trees(model.stages[-1])
    rows = prepared.select(id_col, vector_to_array("features").alias("x"))
    return attributions(rows, id_col, trees, len(names)), names, expected_value(trees)


def tree_attribution_importance(model: PipelineModel, df: DataFrame, id_col: str,
                                n_rows: int | None = config.ATTRIBUTION_SAMPLE_ROWS, seed: int = config.SEED) -> DataFrame:
    """Mean absolute exact attribution per classifier input over a seeded sample of ``n_rows`` rows
    (None: all): ``feature_name, importance``."""
    rows = df if n_rows is None else sample_rows(df, id_col, n_rows, seed)
    phi, names, _ = tree_attributions(model, rows, id_col)
    means = phi.select(F.posexplode("phi").alias("j", "v")).groupBy("j").agg(F.avg(F.abs("v")).alias("importance"))
    index = df.sparkSession.createDataFrame(list(enumerate(names)), "j int, feature_name string")
    return index.join(means, "j", "left").select("feature_name", F.coalesce("importance", F.lit(0.0)).alias("importance"))


def feature_importance(model: PipelineModel, df: DataFrame, id_col: str, label_col: str, cols: Sequence[str],
                       method: str = "permutation_importance", repeats: int = config.PERMUTATION_REPEATS,
                       seed: int = config.SEED) -> DataFrame:
    """``feature_name, importance`` by ``method``: ``permutation_importance`` (E10), or ``shap`` (E11): exact for
    tree ensembles, Monte-Carlo for other classifiers."""
    if method == "permutation_importance":
        return permutation_importance(model, df, id_col, label_col, cols, repeats, seed)
    if method != "shap":
        raise ValueError(f"unknown importance method {method!r}")
    exact = model_trees(model.stages[-1]) is not None
    return tree_attribution_importance(model, df, id_col, seed=seed) if exact else \
        attribution_importance(model, df, id_col, seed=seed)


def attribution_importance(model: PipelineModel, df: DataFrame, id_col: str,
                           n_rows: int = config.ATTRIBUTION_SAMPLE_ROWS, draws: int = 8,
                           seed: int = config.SEED, max_rows: int = 2_000_000) -> DataFrame:
    """E11 for classifiers without trees: mean absolute Monte-Carlo Shapley contribution per model
    input on a seeded sample of at most ``n_rows`` preprocessed rows
    (permutation sampling, Strumbelj & Kononenko 2014).

    Each (row x, draw m) gets a background row z from the same sample and an input
    order from md5 keys. Walking that order, chain_k takes the first k inputs from
    x and the rest from z; input i's contribution in the draw is
    f(chain_{rank(i)+1}) - f(chain_{rank(i)}). Every chain point of a batch of
    (row, draw) pairs is built with array functions (JVM side) and scored by ONE
    classifier ``transform``; batches keep (rows x draws x (inputs + 1)) under
    ``max_rows``. Output: ``feature_name, importance`` over the classifier's inputs.
    """
    spark = df.sparkSession
    pre = PipelineModel(stages=model.stages[:-1])
    clf = model.stages[-1]
    prepared = pre.transform(df)
    names = [c for c in prepared.columns if c.startswith(config.FEATURE_PREFIX)]
    d = len(names)
    sample = sample_rows(prepared.select(id_col, "features"), id_col, n_rows, seed)
    sample = ordinal_within_group(sample.select(id_col, vector_to_array("features").alias("x")), [], [id_col],
                                  out_col="__ord").cache()
    n = sample.count()
    if n == 0 or d == 0:
        return spark.createDataFrame([(c, 0.0) for c in names], "feature_name string, importance double")
    background = sample.select(F.col("__ord").alias("__bord"), F.col("x").alias("z"))
    draws_per_batch = max(1, min(draws, max_rows // max(1, n * (d + 1))))
    results = []
    for s in range(0, draws, draws_per_batch):
        ms = list(range(s, min(draws, s + draws_per_batch)))
        rows = sample.select(id_col, "x", F.explode(F.array(*[F.lit(m) for m in ms])).alias("m"))
        tag = F.concat_ws(":", F.lit(str(seed)), F.lit("shap"), F.col(id_col).cast("string"),
                          F.col("m").cast("string"))
        rows = rows.withColumn("__bord", (F.conv(F.substring(F.md5(tag), 1, 8), 16, 10).cast("long")
                                          % F.lit(n)) + 1).join(F.broadcast(background), "__bord")
        # input order of this draw: indices sorted by md5(tag:i); rank[i] = position of input i
        order = F.transform(F.array_sort(F.transform(
            F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.struct(F.md5(F.concat_ws(":", tag, i.cast("string")))
                                                                  .alias("key"), i.alias("i")))),
            lambda t: t["i"])
        rows = rows.withColumn("__order", order).withColumn(
            "__rank", F.transform(F.sequence(F.lit(0), F.lit(d - 1)),
                                  lambda i: F.array_position(F.col("__order"), i) - 1))
        chain = rows.select(id_col, "m", "__rank", "x", "z",
                            F.explode(F.sequence(F.lit(0), F.lit(d))).alias("k"))
        point = F.transform("x", lambda v, i: F.when(F.element_at("__rank", i + 1) < F.col("k"), v)
                            .otherwise(F.element_at("z", i + 1)))
        pts = chain.select(id_col, "m", "k", "__rank", array_to_vector(point).alias("features"))
        scored = clf.transform(pts).select(id_col, "m", "k", "__rank",
                                           vector_to_array("probability").getItem(1).alias("__p"))
        w = Window.partitionBy(id_col, "m").orderBy("k")
        steps = scored.withColumn("__gain", F.lead("__p").over(w) - F.col("__p")).where(F.col("k") < d)
        # the input whose rank is k enters at step k
        per = steps.select(id_col, "m", "__gain",
                           (F.array_position(F.col("__rank"), F.col("k")) - 1).cast("int").alias("j"))
        results.append(per.groupBy(id_col, "j").agg(F.sum("__gain").alias("__s"), F.count(F.lit(1)).alias("__c")))
    allr = results[0]
    for r in results[1:]:
        allr = allr.unionByName(r)
    phi = allr.groupBy(id_col, "j").agg((F.sum("__s") / F.lit(float(draws))).alias("phi"))
    imp = phi.groupBy("j").agg(F.avg(F.abs("phi")).alias("importance"))
    idx = spark.createDataFrame([(i, c) for i, c in enumerate(names)], "j int, feature_name string")
    out = idx.join(imp, "j", "left").select("feature_name", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    return out
