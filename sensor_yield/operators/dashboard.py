"""BI marts and dashboard data as DataFrame queries (B01-B15, P05-P12, A12-A15,
L05-L09, J02, J04, J05, U01, R01).

The dashboard never recomputes predictions: everything reads the master table
(one row per scored row) and the feature summary. Each chart's data is a
parameterised query, so filters push down to the parquet scan of the exports.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.labels import label_text
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators.profile import feature_profile
from sensor_yield.operators.quantiles import exact_quantiles
from sensor_yield.operators.splits import stratified_sample
from sensor_yield.session import settled

ERROR_TYPES = config.ERROR_TYPES


def build_master(scored: DataFrame, model_name: str, top_features: Sequence[str],
                 threshold: float = config.DEFAULT_DECISION_THRESHOLD, id_col: str = config.ROW_ID_COL) -> DataFrame:
    """B01 (+ J02, P09, P11, L09, U01): one row per scored row, train and test
    together (``plans.exports`` orders it by row_id when it writes the mart).

    ``scored`` holds ``row_id, Time, Pass_Fail, Pass_Fail_Label, dataset_split,
    fail_probability`` and the feature columns -- i.e. the model has scored the
    rows in place (``model.transform`` keeps every input column), so the
    reference's index-aligned lookup of base columns and its train/test
    concatenation need neither a join nor a union: the split is a column.
    """
    p = F.col("fail_probability")
    pred = ev.decision(p, threshold)
    return scored.select(
        id_col, config.TIME_COL, config.LABEL_COL, config.LABEL_TEXT_COL, "dataset_split",
        F.lit(model_name).alias("model_used"), p.alias("fail_probability"),
        F.lit(float(threshold)).alias("prediction_threshold"), pred.alias("predicted_class"),
        label_text(pred).alias("model_prediction"), *top_features)


def error_type(actual_text: Column | None = None, predicted_text: Column | None = None) -> Column:
    """TP / TN / FP / FN, anything else 'NA'."""
    actual_text = F.col(config.LABEL_TEXT_COL) if actual_text is None else actual_text
    predicted_text = F.col("model_prediction") if predicted_text is None else predicted_text
    f, p = F.lit(config.FAIL_TEXT), F.lit(config.PASS_TEXT)
    return (F.when((actual_text == f) & (predicted_text == f), "TP")
            .when((actual_text == p) & (predicted_text == p), "TN")
            .when((actual_text == p) & (predicted_text == f), "FP")
            .when((actual_text == f) & (predicted_text == p), "FN").otherwise(config.ERROR_TYPE_OTHER))


def with_error_type(master: DataFrame) -> DataFrame:
    return master.withColumn("error_type", error_type())


def detail_filter(master: DataFrame, actual: str = "ALL", predicted: str = "ALL", error: str = "All",
                  prob_range: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """Conjunctive optional filters; probability bounds inclusive."""
    cond = F.lit(True)
    if actual != "ALL":
        cond = cond & (F.col(config.LABEL_TEXT_COL) == actual)
    if predicted != "ALL":
        cond = cond & (F.col("model_prediction") == predicted)
    if error != "All":
        cond = cond & (F.col("error_type") == error)
    lo, hi = prob_range
    cond = cond & F.col("fail_probability").between(float(lo), float(hi))
    return master.where(cond)


def model_performance(rows: DataFrame, score_col: str = "fail_probability", model_col: str = "model_used",
                      threshold: float = config.DEFAULT_DECISION_THRESHOLD) -> DataFrame:
    """E08 shape: one performance row per model over the rows it is judged on."""
    return ev.metrics_at_threshold(rows, config.LABEL_COL, score_col, threshold, [model_col]).select(
        F.col(model_col).alias("model"), "recall", "precision", "pr_auc")


def kpis(master: DataFrame, split: str = "test", threshold_col: str = "prediction_threshold",
         performance: DataFrame | None = None) -> DataFrame:
    """Total, fail count, fail rate (0 when empty) and the threshold of the first
    row, counted on ``split``; recall, precision and PR-AUC read from the selected model's row of
    ``performance`` (model, recall, precision, pr_auc); by default that of the test rows."""
    if performance is None:
        performance = model_performance(master.where(F.col("dataset_split") == "test"))
    rows = master if split == "all" else master.where(F.col("dataset_split") == split)
    y = F.col(config.LABEL_COL)
    counted = rows.groupBy(F.col("model_used").alias("model")).agg(
        F.count(F.lit(1)).cast("bigint").alias("total"), F.count_if(y == 1).cast("bigint").alias("fails"),
        F.min_by(F.col(threshold_col), F.col(config.ROW_ID_COL)).alias("selected_threshold"))
    # both have at most one row per model: stacked and grouped, so a constant model joins nothing
    both = (performance.select("model", "recall", "precision", "pr_auc")
            .unionByName(counted, allowMissingColumns=True).groupBy("model")
            .agg(*[F.max(c).alias(c) for c in ("recall", "precision", "pr_auc", "total", "fails", "selected_threshold")]))
    total, fails = F.coalesce("total", F.lit(0)), F.coalesce("fails", F.lit(0))
    return both.select(
        total.alias("total_samples"), fails.alias("fail_count"), "selected_threshold",
        F.coalesce(F.try_divide(fails, total.cast("double")), F.lit(0.0)).alias("fail_rate"),
        "recall", "precision", "pr_auc")


def probability_histogram(rows: DataFrame, bins: int = config.PROBABILITY_HIST_BINS,
                          class_col: str = config.LABEL_TEXT_COL) -> DataFrame:
    """Equal bins on [0, 1] (last bin closed) per class, zero-filled,
    plus the tallest bin."""
    p = F.col("fail_probability")
    b = F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")
    counts = rows.where(p.between(0.0, 1.0)).groupBy(F.col(class_col).alias("class"), b.alias("bin")) \
        .agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    classes = rows.select(F.col(class_col).alias("class")).distinct()
    grid = classes.select("class", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counts, ["class", "bin"], "left").fillna(0, ["n"])
    return full.select("class", "bin", (F.col("bin") / F.lit(float(bins))).alias("bin_start"),
                       ((F.col("bin") + 1) / F.lit(float(bins))).alias("bin_end"), "n",
                       F.max("n").over(Window.partitionBy()).alias("max_bin_count"))


def value_histogram(values: DataFrame, col: str, bins: int = config.MISSING_HIST_BINS) -> DataFrame:
    """Equal bins over the data range (a constant column spans [v-0.5, v+0.5])."""
    x = F.col(col).cast("double")
    least, most = values.agg(F.min(x), F.max(x)).first()  # one row: the range becomes two constants
    if least is not None and least == most:
        least, most = least - 0.5, most + 0.5
    lo, hi = F.lit(least).cast("double"), F.lit(most).cast("double")
    b = F.least(F.floor((x - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    counts = values.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    grid = values.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").fillna(0, ["n"]).select(
        "bin", (lo + (hi - lo) * F.col("bin") / bins).alias("bin_start"),
        (lo + (hi - lo) * (F.col("bin") + 1) / bins).alias("bin_end"), "n")


def grouped_boxes(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Box statistics of the column ``v`` per group: quartiles (linear), whiskers at 1.5 IQR (most extreme
    values inside the fences) and outlier counts."""
    keys = list(keys)
    values = rows.select(*keys, F.col("v").cast("double").alias("v")).where(F.col("v").isNotNull())
    q = exact_quantiles(values, "v", keys, [0.25, 0.5, 0.75])
    q = q.select(*keys, F.col("q0").alias("q1"), F.col("q1").alias("median"), F.col("q2").alias("q3"))
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    q = settled(q)  # one row per group: values do not meet by group
    j = values.join(q, keys)
    lo_f = F.col("q1") - 1.5 * F.col("iqr")
    hi_f = F.col("q3") + 1.5 * F.col("iqr")
    w = j.groupBy(*keys).agg(
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_low"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_high"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).cast("bigint").alias("n_outliers"))
    return q.join(w, keys)


def box_stats(rows: DataFrame, value_col: str, class_col: str = config.LABEL_TEXT_COL) -> DataFrame:
    """Box statistics of one sensor per class."""
    return grouped_boxes(rows.select(F.col(class_col).alias("class"), F.col(value_col).alias("v")), ["class"])


def confusion_text(rows: DataFrame) -> DataFrame:
    """Counts per (actual, predicted) text with the 2x2 grid zero-filled."""
    counts = rows.groupBy(F.col(config.LABEL_TEXT_COL).alias("actual"),
                          F.col("model_prediction").alias("predicted")).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    labels = [config.PASS_TEXT, config.FAIL_TEXT]
    grid = rows.sparkSession.createDataFrame([(a, p) for a in labels for p in labels], "actual string, predicted string")
    return grid.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def top_ranked(summary: DataFrame, k: int, present: Sequence[str] | None = None) -> DataFrame:
    """L05 + J05: features with ``rank <= k`` (NULL ranks dropped), optionally only
    those present as master columns (semi join with the column list)."""
    out = summary.where(F.col("rank").isNotNull() & (F.col("rank") <= k))
    if present is not None:
        cols = summary.sparkSession.createDataFrame([(c,) for c in present], "feature_name string")
        out = out.join(cols, "feature_name", "left_semi")
    return out.orderBy("rank")


def ranked_feature_names(summary: DataFrame, k: int, present: Sequence[str]) -> list[str]:
    """Top-k names in rank order (k is a small report constant)."""
    return [r["feature_name"] for r in top_ranked(summary, k, present).select("feature_name").collect()]


def scatter_rows(rows: DataFrame, x_feature: str, y_feature: str | None = None) -> DataFrame:
    """Two-sensor scatter rows with hover columns (one feature plots against itself)."""
    y_feature = y_feature or x_feature
    return rows.select(config.ROW_ID_COL, config.LABEL_TEXT_COL, F.col(x_feature).alias("x"),
                       F.col(y_feature).alias("y"), "fail_probability", "model_prediction")


def threshold_curve_long(table: DataFrame) -> DataFrame:
    """Recall / precision / F1 against threshold in long form."""
    ids = [c for c in table.columns if c not in ("recall", "precision", "f1")]
    return table.select(*ids, "recall", "precision", "f1").unpivot(
        ids, ["recall", "precision", "f1"], "metric", "value").select("threshold", "metric", "value",
                                                                       *[c for c in ids if c == "model"])


def detail_table(rows: DataFrame, selected: Sequence[str], n: int = config.DETAIL_TABLE_ROWS) -> DataFrame:
    """L07 + P12: first ``n`` rows by row_id, columns de-duplicated, numbers
    rounded half-even to 4 places (the 500-row cap is the feature)."""
    cols = list(dict.fromkeys([config.ROW_ID_COL, config.LABEL_TEXT_COL, "model_prediction", "fail_probability",
                               "error_type", *selected]))
    out = rows.select(*cols).orderBy(config.ROW_ID_COL).limit(n)
    dtypes = dict(out.dtypes)
    return out.select(*[F.bround(F.col(c), 4).alias(c) if dtypes[c] in ("double", "float") else F.col(c)
                        for c in cols])


def misclassified(rows: DataFrame, per_type: int = config.MISCLASSIFIED_ROWS_PER_TYPE) -> DataFrame:
    """Per error type and for 'All', the ``per_type`` rows with the highest
    probability (row_id breaks ties). The rank filter becomes a per-partition
    top-k (WindowGroupLimit) before the shuffle."""
    w = Window.partitionBy("error_type").orderBy(F.desc("fail_probability"), F.asc(config.ROW_ID_COL))
    per = rows.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= per_type) \
        .select(F.col("error_type").alias("slice"), config.ROW_ID_COL, "fail_probability", "error_type")
    every = rows.orderBy(F.desc("fail_probability"), F.asc(config.ROW_ID_COL)).limit(per_type) \
        .select(F.lit(config.ALL_SLICE).alias("slice"), config.ROW_ID_COL, "fail_probability", "error_type")
    return per.unionByName(every)


def distribution_rows(master: DataFrame, features: Sequence[str]) -> DataFrame:
    """B12 + R01: one row per (row, sensor) for the given top sensors."""
    feats = list(features)
    return master.select(config.ROW_ID_COL, config.LABEL_TEXT_COL, "fail_probability",
                         *[F.col(c).cast("double").alias(c) for c in feats]).unpivot(
        [config.ROW_ID_COL, config.LABEL_TEXT_COL, "fail_probability"], feats, "feature_name", "value")


def match_flag() -> Column:
    """P10: Correct when the predicted text equals the actual text."""
    return F.when(F.col("model_prediction") == F.col(config.LABEL_TEXT_COL), config.MATCH_TEXT) \
        .otherwise(config.MISMATCH_TEXT)


def scatter_matrix_rows(master: DataFrame, features: Sequence[str],
                        max_rows: int = config.SCATTER_SAMPLE_ROWS) -> DataFrame:
    """Test rows only (P07), top sensors, match flag, class-stratified
    sample when there are more than ``max_rows`` rows (R06, class column kept)."""
    test = master.where(F.col("dataset_split") == "test")
    sampled = stratified_sample(test, config.ROW_ID_COL, config.LABEL_COL, max_rows)
    return sampled.select(config.ROW_ID_COL, config.LABEL_TEXT_COL, "fail_probability", "model_prediction",
                          match_flag().alias("prediction_match"), *features)


def error_type_by_split(master: DataFrame) -> DataFrame:
    """Cross table of split x error type (pivot with a fixed value list, zero-filled)."""
    return master.groupBy("dataset_split").pivot("error_type", list(ERROR_TYPES) + [config.ERROR_TYPE_OTHER]) \
        .agg(F.count(F.lit(1)).cast("bigint")).fillna(0)


def feature_summary(df: DataFrame, feature_cols: Sequence[str], importance: DataFrame) -> DataFrame:
    """B02 + J03 + J04 + L09: missing ratio and sample variance on the full data,
    left join importance and rank (unmatched keep NULL), importance descending,
    NULLs last."""
    prof = feature_profile(df, feature_cols).select("feature_name", "missing_ratio", "variance")
    return prof.join(importance.select("feature_name", "importance", "rank"), "feature_name", "left") \
        .orderBy(F.desc_nulls_last("importance"), F.asc("feature_name"))


def threshold_kpi_text(table: DataFrame) -> DataFrame:
    """B14 + F10: one KPI line per threshold of a sweep (values half-even rounded
    before formatting so the text never depends on binary ties)."""
    r3 = lambda c: F.bround(F.col(c), 3)
    text = F.format_string(config.THRESHOLD_KPI_FORMAT,
                           F.bround(F.col("threshold"), 2), r3("recall"), r3("precision"), r3("f1"),
                           F.col("false_positives"), F.col("false_negatives"))
    return table.select("threshold", text.alias("kpi_text"))


def kpi_cards(k: DataFrame) -> DataFrame:
    """B04 + F10: the KPI row as display text (``1,234``, ``6.64%``, ``0.619``)."""
    return k.select(
        F.format_number(F.col("total_samples").cast("double"), 0).alias("total_samples_text"),
        F.format_number(F.col("fail_count").cast("double"), 0).alias("fail_count_text"),
        F.format_string("%.2f%%", F.bround(F.col("fail_rate") * 100, 2)).alias("fail_rate_text"),
        F.format_string("%.3f", F.bround(F.col("recall"), 3)).alias("recall_text"),
        F.format_string("%.3f", F.bround(F.col("precision"), 3)).alias("precision_text"),
        F.format_string("%.3f", F.bround(F.col("pr_auc"), 3)).alias("pr_auc_text"),
        F.format_string("%.2f", F.bround(F.col("selected_threshold"), 2)).alias("threshold_text"))


def cv_text(summary: DataFrame) -> DataFrame:
    """``mean ± std`` text per (group, metric) of a CV summary."""
    keys = [c for c in summary.columns if c not in ("mean", "std")]
    return summary.select(*keys, F.format_string(config.CV_TEXT_FORMAT, F.bround("mean", 3), F.bround("std", 3))
                          .alias("text"))
