"""Score-set evaluation.

A score set is any DataFrame with a 0/1 label, a probability-like score and
optional grouping columns (model, fold, setting, feature/repeat for permutation
importance). Every metric is computed for all groups in one plan:

* threshold metrics are conditional counts (one partial aggregate);
* ranking metrics first collapse rows to distinct ``(group, score)`` levels, then
  run the distributed prefix sums of ``operators.ordering`` over those levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.ordering import cumulative_sums


def _safe_ratio(num: Column, den: Column) -> Column:
    """``num / den`` with 0 when undefined (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def decision(score: Column, threshold: float | Column) -> Column:
    """``score >= t`` as 0/1."""
    t = threshold if isinstance(threshold, Column) else F.lit(threshold)
    return (score >= t).cast("int")


def confusion_counts(df: DataFrame, label_col: str, pred_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """``true_negatives, false_positives, false_negatives, true_positives``."""
    y, p = F.col(label_col), F.col(pred_col)
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    return g.agg(
        F.count_if((y == 0) & (p == 0)).cast("bigint").alias("true_negatives"),
        F.count_if((y == 0) & (p == 1)).cast("bigint").alias("false_positives"),
        F.count_if((y == 1) & (p == 0)).cast("bigint").alias("false_negatives"),
        F.count_if((y == 1) & (p == 1)).cast("bigint").alias("true_positives"),
    )


def rate_columns(tp: Column, fp: Column, fn: Column) -> list[Column]:
    """recall, precision, F1 with zero_division=0."""
    return [
        _safe_ratio(tp, tp + fn).alias("recall"),
        _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def score_levels(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Distinct score levels with positives / negatives at each level, plus the
    running totals from the highest score down (W03)."""
    y = F.col(label_col)
    levels = df.groupBy(*group_cols, F.col(score_col).alias("score")).agg(
        F.count_if(y == 1).cast("bigint").alias("pos"),
        F.count_if(y == 0).cast("bigint").alias("neg"))
    cum = cumulative_sums(levels, list(group_cols), [F.desc("score")], ["pos", "neg"])
    # the totals come with the running sums: no second pass, no join with a one-row table
    return cum.withColumnsRenamed({"total_pos": "n_pos", "total_neg": "n_neg"})


def ranking_metrics(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """E04 + E05: average precision and ROC-AUC per group.

    AP = sum over levels of pos_k * precision_k / P (step-wise, no interpolation);
    ROC-AUC counts ties as one half: sum pos_k * (negatives below + neg_k / 2) / (P N).
    Undefined values (no positive or no negative) are NULL.
    """
    lv = score_levels(df, label_col, score_col, group_cols)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    below = F.col("n_neg") - F.col("cum_neg")
    g = lv.groupBy(*group_cols) if group_cols else lv.groupBy()
    return g.agg(
        F.try_divide(F.sum(F.col("pos") * prec), F.first("n_pos").cast("double")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                     F.first("n_pos").cast("double") * F.first("n_neg").cast("double")).alias("roc_auc"),
    )


def metrics_at_threshold(df: DataFrame, label_col: str, score_col: str,
                         threshold: float = config.DEFAULT_DECISION_THRESHOLD,
                         group_cols: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, F1, PR-AUC, ROC-AUC, accuracy and the 2x2 counts.

    The rows are scanned once, into the distinct score levels; the confusion counts
    at the cut and both ranking metrics are aggregates of that (small) table."""
    lv = score_levels(df, label_col, score_col, group_cols)
    above = F.col("score") >= F.lit(threshold)
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    below = F.col("n_neg") - F.col("cum_neg")
    g = lv.groupBy(*group_cols) if group_cols else lv.groupBy()
    agg = g.agg(
        F.sum(F.when(above, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(above, F.col("neg")).otherwise(0)).alias("fp"),
        F.first("n_pos").alias("__np"), F.first("n_neg").alias("__nn"),
        F.try_divide(F.sum(F.col("pos") * prec), F.first("n_pos").cast("double")).alias("pr_auc"),
        F.try_divide(F.sum(F.col("pos") * (below + F.col("neg") / 2.0)),
                     F.first("n_pos").cast("double") * F.first("n_neg").cast("double")).alias("roc_auc"))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("__np") - tp, F.col("__nn") - fp
    return agg.select(*group_cols, *rate_columns(tp, fp, fn),
                      _safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
                      tn.cast("bigint").alias("true_negatives"), fp.cast("bigint").alias("false_positives"),
                      fn.cast("bigint").alias("false_negatives"), tp.cast("bigint").alias("true_positives"),
                      "pr_auc", "roc_auc")


def threshold_table(df: DataFrame, label_col: str, score_col: str,
                    grid: Sequence[float] = config.THRESHOLD_GRID,
                    group_cols: Sequence[str] = ()) -> DataFrame:
    """E02 + J06: one row per grid threshold (per group) with rates and counts.

    One partial aggregate computes, for every grid point, the positives and
    negatives scoring at or above it (2 x 19 conditional counts inside codegen,
    one state per group per task); a ``stack`` generator then turns the single
    row per group into the 19 threshold rows. No join with the grid is needed.
    """
    grid = sorted(float(t) for t in grid)
    s, y = F.col(score_col), F.col(label_col)
    aggs = [F.count_if(y == 1).alias("__np"), F.count_if(y == 0).alias("__nn")]
    for i, t in enumerate(grid):
        aggs.append(F.count_if((y == 1) & (s >= F.lit(t))).alias(f"__tp{i}"))
        aggs.append(F.count_if((y == 0) & (s >= F.lit(t))).alias(f"__fp{i}"))
    g = df.groupBy(*group_cols) if group_cols else df.groupBy()
    wide = g.agg(*aggs)
    parts = ", ".join(f"CAST({t!r} AS DOUBLE), __tp{i}, __fp{i}" for i, t in enumerate(grid))
    t = wide.selectExpr(*[f"`{c}`" for c in group_cols], "__np", "__nn",
                        f"stack({len(grid)}, {parts}) AS (threshold, tp, fp)")
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("__np") - tp, F.col("__nn") - fp
    return t.select(
        *group_cols, "threshold", *rate_columns(tp, fp, fn),
        fp.cast("bigint").alias("false_positives"), fn.cast("bigint").alias("false_negatives"),
        tp.cast("bigint").alias("true_positives"), tn.cast("bigint").alias("true_negatives"),
    )


def recommend_thresholds(table: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """E03 with L10: max F1; max recall with precision >= 0.2; max precision with
    recall >= 0.5. Ties go to the lowest threshold; a rule with no qualifying row
    yields no row."""
    row = F.struct("threshold", "recall", "precision", "f1", "false_positives", "false_negatives",
                   "true_positives", "true_negatives")

    def best(metric: str, where: Column | None, key: str) -> DataFrame:
        src = table if where is None else table.where(where)
        g = src.groupBy(*group_cols) if group_cols else src.groupBy()
        return g.agg(F.max_by(row, F.struct(F.col(metric), -F.col("threshold"))).alias("r")) \
            .where(F.col("r").isNotNull()).select(*group_cols, F.lit(key).alias("strategy"), "r.*")

    k1, k2, k3 = config.RECOMMENDATION_KEYS
    return (best("f1", None, k1)
            .unionByName(best("recall", F.col("precision") >= config.MIN_PRECISION_FOR_RECALL_RULE, k2))
            .unionByName(best("precision", F.col("recall") >= config.MIN_RECALL_FOR_PRECISION_RULE, k3)))


def pr_curve(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """Precision / recall at every distinct score plus the terminal point
    (recall 0, precision 1, threshold NULL)."""
    lv = score_levels(df, label_col, score_col, group_cols)
    pts = lv.select(*group_cols, F.col("score").alias("threshold"),
                    (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
                    F.try_divide(F.col("cum_pos"), F.col("n_pos").cast("double")).alias("recall"))
    ends = (lv.select(*group_cols).distinct() if group_cols else df.sparkSession.range(1).select())
    ends = ends.select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                       F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return pts.unionByName(ends)


def roc_curve(df: DataFrame, label_col: str, score_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(fpr, tpr) at every distinct score, from the origin (threshold NULL)."""
    lv = score_levels(df, label_col, score_col, group_cols)
    pts = lv.select(*group_cols, F.col("score").alias("threshold"),
                    F.try_divide(F.col("cum_neg"), F.col("n_neg").cast("double")).alias("fpr"),
                    F.try_divide(F.col("cum_pos"), F.col("n_pos").cast("double")).alias("tpr"))
    origin = (lv.select(*group_cols).distinct() if group_cols else df.sparkSession.range(1).select())
    origin = origin.select(*group_cols, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def cv_summary(fold_metrics: DataFrame, group_cols: Sequence[str], metric_cols: Sequence[str]) -> DataFrame:
    """Mean and population std of each metric over folds (long form)."""
    long = fold_metrics.unpivot(list(group_cols), list(metric_cols), "metric", "value")
    return long.groupBy(*group_cols, "metric").agg(F.avg("value").alias("mean"),
                                                   F.stddev_pop("value").alias("std"))


def best_row(df: DataFrame, metric: str, tie_col: str) -> DataFrame:
    """The row with the largest ``metric`` (first ``tie_col`` wins ties);
    empty input gives an empty result."""
    return df.orderBy(F.desc_nulls_last(metric), F.asc(tie_col)).limit(1)


__all__ = [
    "best_row",
    "confusion_counts",
    "cv_summary",
    "decision",
    "metrics_at_threshold",
    "pr_curve",
    "ranking_metrics",
    "recommend_thresholds",
    "roc_curve",
    "score_levels",
    "threshold_table",
]
