"""Evaluation queries on the events score set."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators import splits
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.sources import driver_tables as D

Y, P = config.LABEL_COL, "fail_probability"

# SQL building blocks -------------------------------------------------------

_LEVELS = """
lv AS (SELECT {g}fail_probability AS score, count(*) FILTER (WHERE Pass_Fail = 1) AS pos,
              count(*) FILTER (WHERE Pass_Fail = 0) AS neg FROM {src} GROUP BY {g}fail_probability),
cl AS (SELECT *, sum(pos) OVER (PARTITION BY {gp} ORDER BY score DESC) AS cum_pos,
              sum(neg) OVER (PARTITION BY {gp} ORDER BY score DESC) AS cum_neg,
              sum(pos) OVER (PARTITION BY {gp}) AS n_pos, sum(neg) OVER (PARTITION BY {gp}) AS n_neg FROM lv)"""


def _levels(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    gp = group if group else "1"
    return _LEVELS.format(g=g, gp=gp, src=src)


_RANK_AGG = """sum(pos * cum_pos / (cum_pos + cum_neg)) / max(n_pos) AS pr_auc,
       sum(pos * ((n_neg - cum_neg) + neg / 2.0)) / (max(n_pos) * max(n_neg)) AS roc_auc"""

_GRID_VALUES = ", ".join(f"({t}::DOUBLE)" for t in config.THRESHOLD_GRID)


def _rates(tp: str, fp: str, fn: str) -> str:
    return (f"{R(f'coalesce({tp} / nullif({tp} + {fn}, 0), 0)')} AS recall, "
            f"{R(f'coalesce({tp} / nullif({tp} + {fp}, 0), 0)')} AS precision, "
            f"{R(f'coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0)')} AS f1")


_THRESHOLD_TABLE = f"""
tt0 AS (SELECT g.threshold,
               count(*) FILTER (WHERE e.Pass_Fail = 1 AND e.fail_probability >= g.threshold) AS tp,
               count(*) FILTER (WHERE e.Pass_Fail = 0 AND e.fail_probability >= g.threshold) AS fp,
               count(*) FILTER (WHERE e.Pass_Fail = 1 AND e.fail_probability < g.threshold) AS fn,
               count(*) FILTER (WHERE e.Pass_Fail = 0 AND e.fail_probability < g.threshold) AS tn
        FROM ev e, (VALUES {_GRID_VALUES}) g(threshold) GROUP BY g.threshold),
tt AS (SELECT threshold, {_rates('tp', 'fp', 'fn')},
              CAST(fp AS BIGINT) AS false_positives, CAST(fn AS BIGINT) AS false_negatives,
              CAST(tp AS BIGINT) AS true_positives, CAST(tn AS BIGINT) AS true_negatives FROM tt0)"""


@register("confusion_counts", with_ctes(S.EVENT_SCORES) + """
SELECT CAST(count(*) FILTER (WHERE Pass_Fail = 0 AND fail_probability < 0.5) AS BIGINT) AS true_negatives,
       CAST(count(*) FILTER (WHERE Pass_Fail = 0 AND fail_probability >= 0.5) AS BIGINT) AS false_positives,
       CAST(count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability < 0.5) AS BIGINT) AS false_negatives,
       CAST(count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability >= 0.5) AS BIGINT) AS true_positives
FROM ev""")
def q_confusion_counts(spark, sf_dir):
    """A12 + P09 at the 0.5 cut."""
    df = D.event_scores(spark, sf_dir).withColumn("pred", ev.decision(F.col(P), 0.5))
    return ev.confusion_counts(df, Y, "pred")


@register("metrics_at_threshold", with_ctes(S.EVENT_SCORES, _levels("ev")) + f"""
, cm AS (SELECT count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability >= 0.5) AS tp,
               count(*) FILTER (WHERE Pass_Fail = 0 AND fail_probability >= 0.5) AS fp,
               count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability < 0.5) AS fn,
               count(*) FILTER (WHERE Pass_Fail = 0 AND fail_probability < 0.5) AS tn FROM ev),
rk AS (SELECT {_RANK_AGG} FROM cl)
SELECT {_rates('tp', 'fp', 'fn')}, {R('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy,
       CAST(tn AS BIGINT) AS true_negatives, CAST(fp AS BIGINT) AS false_positives,
       CAST(fn AS BIGINT) AS false_negatives, CAST(tp AS BIGINT) AS true_positives,
       {R('rk.pr_auc')} AS pr_auc, {R('rk.roc_auc')} AS roc_auc
FROM cm, rk""")
def q_metrics_at_threshold(spark, sf_dir):
    """Full metric set at 0.5 (tied scores)."""
    return rounded(ev.metrics_at_threshold(D.event_scores(spark, sf_dir), Y, P, 0.5))


@register("ranking_metrics_by_hour", with_ctes(S.EVENT_SCORES, "evh AS (SELECT *, CAST(hour(\"Time\") AS INTEGER) AS hr FROM ev)",
                                               _levels("evh", "hr")) + f"""
SELECT hr, {R('sum(pos * cum_pos / (cum_pos + cum_neg)) / max(n_pos)')} AS pr_auc,
       {R('sum(pos * ((n_neg - cum_neg) + neg / 2.0)) / (max(n_pos) * max(n_neg))')} AS roc_auc
FROM cl GROUP BY hr""")
def q_ranking_metrics_by_hour(spark, sf_dir):
    """E04 + E05 + W03 grouped (24 score sets in one plan)."""
    df = D.event_scores(spark, sf_dir).withColumn("hr", F.hour(config.TIME_COL))
    return rounded(ev.ranking_metrics(df, Y, P, ["hr"]))


@register("threshold_table", with_ctes(S.EVENT_SCORES, _THRESHOLD_TABLE) + " SELECT * FROM tt")
def q_threshold_table(spark, sf_dir):
    """19-row sweep 0.05..0.95."""
    return rounded(ev.threshold_table(D.event_scores(spark, sf_dir), Y, P))


@register("threshold_recommendations", with_ctes(S.EVENT_SCORES, _THRESHOLD_TABLE) + """
, r1 AS (SELECT 'max_f1' AS strategy, * FROM tt ORDER BY f1 DESC, threshold ASC LIMIT 1),
r2 AS (SELECT 'high_recall_min_precision_0.2' AS strategy, * FROM tt WHERE precision >= 0.2
       ORDER BY recall DESC, threshold ASC LIMIT 1),
r3 AS (SELECT 'high_precision_min_recall_0.5' AS strategy, * FROM tt WHERE recall >= 0.5
       ORDER BY precision DESC, threshold ASC LIMIT 1)
SELECT * FROM r1 UNION ALL SELECT * FROM r2 UNION ALL SELECT * FROM r3""")
def q_threshold_recommendations(spark, sf_dir):
    """E03 + L10 (first row wins ties)."""
    table = rounded(ev.threshold_table(D.event_scores(spark, sf_dir), Y, P))
    return ev.recommend_thresholds(table)


@register("pr_curve", with_ctes(S.EVENT_SCORES, _levels("ev")) + f"""
SELECT {R('score')} AS threshold, {R('cum_pos / (cum_pos + cum_neg)')} AS precision,
       {R('cum_pos / n_pos')} AS recall FROM cl
UNION ALL SELECT NULL, 1.0, 0.0""")
def q_pr_curve(spark, sf_dir):
    """PR points at every distinct score plus the terminal point."""
    return rounded(ev.pr_curve(D.event_scores(spark, sf_dir), Y, P))


@register("roc_curve", with_ctes(S.EVENT_SCORES, _levels("ev")) + f"""
SELECT {R('score')} AS threshold, {R('cum_neg / n_neg')} AS fpr, {R('cum_pos / n_pos')} AS tpr FROM cl
UNION ALL SELECT NULL, 0.0, 0.0""")
def q_roc_curve(spark, sf_dir):
    """ROC points from the origin."""
    return rounded(ev.roc_curve(D.event_scores(spark, sf_dir), Y, P))


_FOLDS = f"""
fr AS (SELECT row_id, Pass_Fail, fail_probability,
              row_number() OVER (PARTITION BY Pass_Fail ORDER BY {S.md5_key('row_id', salt='fold')}, row_id) AS ord
       FROM ev),
fc AS (SELECT Pass_Fail, count(*) AS n FROM ev GROUP BY Pass_Fail),
fo AS (SELECT Pass_Fail, coalesce(sum(n) OVER (ORDER BY Pass_Fail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              AS o FROM fc),
fe AS (SELECT fr.*, CAST((ord - 1 + o) % {config.CV_FOLDS} AS INTEGER) AS fold FROM fr JOIN fo USING (Pass_Fail))"""

_FOLD_METRICS = f"""
fm0 AS (SELECT fold, count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability >= 0.5) AS tp,
               count(*) FILTER (WHERE Pass_Fail = 0 AND fail_probability >= 0.5) AS fp,
               count(*) FILTER (WHERE Pass_Fail = 1 AND fail_probability < 0.5) AS fn FROM fe GROUP BY fold),
flv AS (SELECT fold, fail_probability AS score, count(*) FILTER (WHERE Pass_Fail = 1) AS pos,
               count(*) FILTER (WHERE Pass_Fail = 0) AS neg FROM fe GROUP BY fold, fail_probability),
fcl AS (SELECT *, sum(pos) OVER (PARTITION BY fold ORDER BY score DESC) AS cum_pos,
               sum(neg) OVER (PARTITION BY fold ORDER BY score DESC) AS cum_neg,
               sum(pos) OVER (PARTITION BY fold) AS n_pos, sum(neg) OVER (PARTITION BY fold) AS n_neg FROM flv),
frk AS (SELECT fold, {_RANK_AGG} FROM fcl GROUP BY fold),
fm AS (SELECT fold, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, pr_auc, roc_auc
       FROM fm0 JOIN frk USING (fold))"""


def _fold_scores(spark, sf_dir):
    df = D.event_scores(spark, sf_dir).select(config.ROW_ID_COL, Y, P)
    return splits.stratified_folds(df, config.ROW_ID_COL)


@register("cv_fold_metrics", with_ctes(S.EVENT_SCORES, _FOLDS, _FOLD_METRICS) + f"""
SELECT fold, {R('recall')} AS recall, {R('precision')} AS precision, {R('f1')} AS f1,
       {R('pr_auc')} AS pr_auc, {R('roc_auc')} AS roc_auc FROM fm""")
def q_cv_fold_metrics(spark, sf_dir):
    """E01 grouped by fold (R04 folds): the per-fold scores of a CV run."""
    m = ev.metrics_at_threshold(_fold_scores(spark, sf_dir), Y, P, 0.5, ["fold"])
    return rounded(m.select("fold", "recall", "precision", "f1", "pr_auc", "roc_auc"))


@register("cv_summary", with_ctes(S.EVENT_SCORES, _FOLDS, _FOLD_METRICS) + f"""
, lg AS (UNPIVOT fm ON recall, precision, f1, pr_auc, roc_auc INTO NAME metric VALUE value)
SELECT metric, {R('avg(value)')} AS mean, {R('stddev_pop(value)')} AS std FROM lg GROUP BY metric""")
def q_cv_summary(spark, sf_dir):
    """Mean and population std over the 5 folds, per metric."""
    m = ev.metrics_at_threshold(_fold_scores(spark, sf_dir), Y, P, 0.5, ["fold"])
    return rounded(ev.cv_summary(m, [], ["recall", "precision", "f1", "pr_auc", "roc_auc"]))
