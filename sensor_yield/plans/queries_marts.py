"""BI mart / dashboard queries over the scored events (B01-B15, E08, E10, L05-L09,
P05-P12, W01, J02-J05, U01).

The scored set is the events table with the fixed ``ValueRatioScore`` rule as the
model (an ``ExpressionScorer`` stage), an exact stratified split, and the master
table built from them. Permutation importance is that of a second rule that reads three
sensors (the others are exactly 0).
Views that show chosen sensors take the sensor list as an explicit input, as
the dashboard's sensor selector does.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.bijection import bijection_ctes, code_of
from sensor_yield.operators import dashboard as db
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators.importance import permutation_importance, rank_features
from sensor_yield.operators.models import ExpressionScorer
from sensor_yield.operators.profile import feature_profile
from sensor_yield.operators.splits import stratified_split
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.sources import driver_tables as D

EV = D.EVENT_FEATURES
MODEL = D.EVENT_MODEL_NAME
SCORE_EXPR = "floor(feature_000) / (floor(feature_000) + 50.0)"
#: The rule whose importances are shown: value, hour and whether a third sensor is missing.
RULE_COLS = ["feature_000", "feature_002", "feature_003"]
RULE_SUM = "(floor({feature_000}) + 3 * {feature_002} + CASE WHEN {feature_003} IS NULL THEN 0 ELSE 100 END)"


def rule_sql(**columns: str) -> str:
    total = RULE_SUM.format(**{c: columns.get(c, c) for c in RULE_COLS})
    return f"CAST({total} AS DOUBLE) / ({total} + 150.0)"


def importance_model() -> PipelineModel:
    return PipelineModel(stages=[ExpressionScorer(expression=rule_sql(), usedCols=RULE_COLS)])


def event_model() -> PipelineModel:
    return PipelineModel(stages=[ExpressionScorer(expression=SCORE_EXPR, usedCols=["feature_000"])])


def event_split(spark, sf_dir):
    """The scored events with an exact stratified ``dataset_split`` column (the
    split carries every column through its checkpoint: no join back)."""
    return stratified_split(D.event_scores(spark, sf_dir), config.ROW_ID_COL)


def event_master(spark, sf_dir):
    """B01 over the events: both splits, the rule's probability, 0.5 cut, features."""
    return db.build_master(event_split(spark, sf_dir), MODEL, EV)


def event_kpis(spark, sf_dir):
    """KPIs of the held-out events with the performance row of the rule that scored them."""
    master = event_master(spark, sf_dir)
    performance = db.model_performance(master.where(F.col("dataset_split") == "test"))
    return db.kpis(master, split="test", performance=performance)


def event_importance(spark, sf_dir):
    b = event_split(spark, sf_dir)
    test = b.where(F.col("dataset_split") == "test")
    return rank_features(permutation_importance(importance_model(), test, config.ROW_ID_COL, config.LABEL_COL, EV))


def event_summary(spark, sf_dir):
    return db.feature_summary(D.event_scores(spark, sf_dir), EV, event_importance(spark, sf_dir))


# --------------------------------------------------------------------------- SQL
_SPLIT = S.split_cte("ev")
_MASTER = f"""
master AS (
  SELECT row_id, "Time", Pass_Fail, Pass_Fail_Label, dataset_split, '{MODEL}' AS model_used,
         fail_probability, CAST(0.5 AS DOUBLE) AS prediction_threshold,
         CAST(fail_probability >= 0.5 AS INTEGER) AS predicted_class,
         CASE WHEN fail_probability >= 0.5 THEN 'Fail' ELSE 'Pass' END AS model_prediction,
         {', '.join(EV)},
         CASE WHEN Pass_Fail_Label = 'Fail' AND fail_probability >= 0.5 THEN 'TP'
              WHEN Pass_Fail_Label = 'Pass' AND fail_probability < 0.5 THEN 'TN'
              WHEN Pass_Fail_Label = 'Pass' AND fail_probability >= 0.5 THEN 'FP'
              WHEN Pass_Fail_Label = 'Fail' AND fail_probability < 0.5 THEN 'FN' ELSE 'NA' END AS error_type
  FROM split)"""

_LV = """
{name}_lv AS (SELECT {g}score, count(*) FILTER (WHERE Pass_Fail = 1) AS pos, count(*) FILTER (WHERE Pass_Fail = 0) AS neg
       FROM {src} GROUP BY {g}score),
{name}_cl AS (SELECT *, sum(pos) OVER (PARTITION BY {gp} ORDER BY score DESC) AS cum_pos,
       sum(neg) OVER (PARTITION BY {gp} ORDER BY score DESC) AS cum_neg, sum(pos) OVER (PARTITION BY {gp}) AS n_pos,
       sum(neg) OVER (PARTITION BY {gp}) AS n_neg FROM {name}_lv),
{name} AS (SELECT {g}sum(pos * cum_pos / (cum_pos + cum_neg)) / max(n_pos) AS ap,
       sum(pos * ((n_neg - cum_neg) + neg / 2.0)) / (max(n_pos) * max(n_neg)) AS auc FROM {name}_cl
       {gb})"""


def _lv(name: str, src: str, group: str | None = None) -> str:
    return _LV.format(name=name, src=src, g=f"{group}, " if group else "", gp=group or "1",
                      gb=f"GROUP BY {group}" if group else "")


_FEATURE_VALUES = ", ".join(f"('{c}')" for c in EV)
_CODES = ", ".join(f"('{f}', {r}, {code_of(config.SEED, f, r)}::BIGINT)" for f in RULE_COLS for r in range(config.PERMUTATION_REPEATS))
_SWAPPED = {c: f"CASE WHEN moved.f = '{c}' THEN src.{c} ELSE dst.{c} END" for c in RULE_COLS}
_IMPORTANCE = [
    "test AS (SELECT *, row_number() OVER (ORDER BY row_id) - 1 AS pos FROM split WHERE dataset_split = 'test')",
    f"tscore AS (SELECT Pass_Fail, {rule_sql()} AS score FROM test)",
    _lv("base_ap", "tscore"),
    *bijection_ctes("SELECT count(*) FROM test", f"SELECT * FROM (VALUES {_CODES}) c(f, r, code)", "f, r"),
    f"""pscore AS (SELECT moved.f, moved.r, dst.Pass_Fail, {rule_sql(**_SWAPPED)} AS score
        FROM moved JOIN test src ON src.pos = moved.x JOIN test dst ON dst.pos = moved.p)""",
    _lv("perm_ap", "pscore", "f, r"),
    "imp0 AS (SELECT f AS feature_name, (SELECT ap FROM base_ap) - avg(ap) AS importance FROM perm_ap GROUP BY f)",
    f"allf AS (SELECT f AS feature_name FROM (VALUES {_FEATURE_VALUES}) t(f))",
    "imp1 AS (SELECT allf.feature_name, coalesce(imp0.importance, 0.0) AS importance "
    "FROM allf LEFT JOIN imp0 USING (feature_name))",
    "imp AS (SELECT feature_name, importance, "
    "CAST(row_number() OVER (ORDER BY importance DESC, feature_name) AS INTEGER) AS rank FROM imp1)",
]


def _profile_ctes() -> list[str]:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, (count(*) - count({c})) / count(*) AS missing_ratio, "
        f"var_samp({c}) AS variance FROM ev" for c in EV)
    return [f"prof AS ({parts})"]


def _base(*extra: str) -> str:
    return with_ctes(S.EVENT_SCORES, _SPLIT, *extra).replace("WITH ", "WITH RECURSIVE ", 1)


_MASTER_COLS = ", ".join(
    ["row_id", '"Time"', "Pass_Fail", "Pass_Fail_Label", "dataset_split", "model_used",
     f"{R('fail_probability')} AS fail_probability", "prediction_threshold", "predicted_class", "model_prediction"]
    + [f"{R(c)} AS {c}" for c in EV])


@register("master_table", _base(_MASTER) + f" SELECT {_MASTER_COLS} FROM master")
def q_master_table(spark, sf_dir):
    """B01 + J02 + P09 + P11 + L09 + U01: the master table of the scored events."""
    return rounded(event_master(spark, sf_dir))


@register("error_type_by_split", _base(_MASTER) + """
SELECT dataset_split,
       CAST(count(*) FILTER (WHERE error_type = 'TP') AS BIGINT) AS TP,
       CAST(count(*) FILTER (WHERE error_type = 'TN') AS BIGINT) AS TN,
       CAST(count(*) FILTER (WHERE error_type = 'FP') AS BIGINT) AS FP,
       CAST(count(*) FILTER (WHERE error_type = 'FN') AS BIGINT) AS FN,
       CAST(count(*) FILTER (WHERE error_type = 'NA') AS BIGINT) AS NA
FROM master GROUP BY dataset_split""")
def q_error_type_by_split(spark, sf_dir):
    """P06 + B15: error-type cross table by split (pivot)."""
    return db.error_type_by_split(db.with_error_type(event_master(spark, sf_dir)))


@register("filtered_detail", _base(_MASTER) + f"""
SELECT row_id, Pass_Fail_Label, model_prediction, {R('fail_probability')} AS fail_probability, error_type
FROM master WHERE Pass_Fail_Label = 'Fail' AND fail_probability BETWEEN 0.2 AND 0.8""")
def q_filtered_detail(spark, sf_dir):
    """Actual Fail, any prediction, any error type, probability in [0.2, 0.8]."""
    m = db.with_error_type(event_master(spark, sf_dir))
    f = db.detail_filter(m, actual="Fail", prob_range=(0.2, 0.8))
    return rounded(f.select(config.ROW_ID_COL, config.LABEL_TEXT_COL, "model_prediction", "fail_probability",
                            "error_type"))


@register("dashboard_kpis", _base(_MASTER, "t AS (SELECT *, fail_probability AS score FROM master "
                                          "WHERE dataset_split = 'test')", _lv("rk", "t")) + f"""
SELECT CAST(count(*) AS BIGINT) AS total_samples, CAST(count(*) FILTER (WHERE Pass_Fail = 1) AS BIGINT) AS fail_count,
       {R('arg_min(prediction_threshold, row_id)')} AS selected_threshold,
       {R('coalesce(count(*) FILTER (WHERE Pass_Fail = 1) / nullif(count(*), 0), 0)')} AS fail_rate,
       {R("coalesce(count(*) FILTER (WHERE error_type = 'TP') / nullif(count(*) FILTER (WHERE Pass_Fail = 1), 0), 0)")}
         AS recall,
       {R("coalesce(count(*) FILTER (WHERE error_type = 'TP') / nullif(count(*) FILTER (WHERE predicted_class = 1), 0), 0)")}
         AS precision,
       {R('(SELECT ap FROM rk)')} AS pr_auc
FROM t""")
def q_dashboard_kpis(spark, sf_dir):
    """A13 / B04 on the test split, rates from the model's performance row."""
    return rounded(event_kpis(spark, sf_dir))


@register("probability_histogram", _base(_MASTER) + """
, c AS (SELECT Pass_Fail_Label AS class, CAST(least(floor(fail_probability * 25), 24) AS INTEGER) AS bin, count(*) AS n
        FROM master WHERE fail_probability BETWEEN 0 AND 1 GROUP BY ALL),
g AS (SELECT class, CAST(b AS INTEGER) AS bin FROM (SELECT DISTINCT Pass_Fail_Label AS class FROM master), range(25) t(b)),
f AS (SELECT g.class, g.bin, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (class, bin))
SELECT class, bin, round(bin / 25.0, 6) + 0.0 AS bin_start, round((bin + 1) / 25.0, 6) + 0.0 AS bin_end, n,
       max(n) OVER () AS max_bin_count FROM f""")
def q_probability_histogram(spark, sf_dir):
    """25 bins on [0, 1] per actual class, zero-filled."""
    return rounded(db.probability_histogram(event_master(spark, sf_dir)))


@register("missing_ratio_histogram", with_ctes(S.EVENT_SCORES, *_profile_ctes()) + f"""
, r AS (SELECT CASE WHEN min(missing_ratio) = max(missing_ratio) THEN min(missing_ratio) - 0.5 ELSE min(missing_ratio) END AS lo,
              CASE WHEN min(missing_ratio) = max(missing_ratio) THEN max(missing_ratio) + 0.5 ELSE max(missing_ratio) END AS hi
       FROM prof),
c AS (SELECT CAST(least(floor((missing_ratio - lo) / (hi - lo) * 40), 39) AS INTEGER) AS bin, count(*) AS n
      FROM prof, r WHERE missing_ratio IS NOT NULL GROUP BY 1),
g AS (SELECT CAST(b AS INTEGER) AS bin, lo, hi FROM r, range(40) t(b))
SELECT g.bin, {R('lo + (hi - lo) * g.bin / 40')} AS bin_start, {R('lo + (hi - lo) * (g.bin + 1) / 40')} AS bin_end,
       CAST(coalesce(c.n, 0) AS BIGINT) AS n
FROM g LEFT JOIN c USING (bin)""")
def q_missing_ratio_histogram(spark, sf_dir):
    """40 bins over the range of the per-feature missing ratios."""
    prof = feature_profile(D.event_scores(spark, sf_dir), EV)
    return rounded(db.value_histogram(prof, "missing_ratio", config.MISSING_HIST_BINS))


@register("sensor_box_stats", _base(_MASTER) + f"""
, q AS (SELECT Pass_Fail_Label AS class, quantile_cont(feature_000, 0.25) AS q1, quantile_cont(feature_000, 0.5) AS median,
              quantile_cont(feature_000, 0.75) AS q3 FROM master GROUP BY 1),
j AS (SELECT q.*, m.feature_000 AS v FROM master m JOIN q ON m.Pass_Fail_Label = q.class WHERE m.feature_000 IS NOT NULL)
SELECT class, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, {R('q3 - q1')} AS iqr,
       {R('min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
       {R('max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
       CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers
FROM j GROUP BY class, q1, median, q3""")
def q_sensor_box_stats(spark, sf_dir):
    """Box statistics of the first selected sensor by class."""
    return rounded(db.box_stats(event_master(spark, sf_dir), "feature_000"))


@register("filtered_confusion", _base(_MASTER) + """
, c AS (SELECT Pass_Fail_Label AS actual, model_prediction AS predicted, count(*) AS n FROM master
        WHERE fail_probability BETWEEN 0.1 AND 0.9 GROUP BY 1, 2),
g AS (SELECT a.x AS actual, p.x AS predicted FROM (VALUES ('Pass'), ('Fail')) a(x), (VALUES ('Pass'), ('Fail')) p(x))
SELECT g.actual, g.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM g LEFT JOIN c USING (actual, predicted)""")
def q_filtered_confusion(spark, sf_dir):
    """B07 + A12: Pass/Fail confusion counts of the rows in probability [0.1, 0.9]."""
    m = db.with_error_type(event_master(spark, sf_dir))
    return db.confusion_text(db.detail_filter(m, prob_range=(0.1, 0.9)))


@register("permutation_importance", _base(*_IMPORTANCE) + f"""
SELECT feature_name, {R('importance')} AS importance, rank FROM imp""")
def q_permutation_importance(spark, sf_dir):
    """E10 + W01 + R08: 10-repeat permutation importance of the score rule on the
    held-out events, ranked."""
    return rounded(event_importance(spark, sf_dir))


@register("feature_summary", _base(*_IMPORTANCE, *_profile_ctes()) + f"""
SELECT p.feature_name, {R('p.missing_ratio')} AS missing_ratio, {R('p.variance')} AS variance,
       {R('i.importance')} AS importance, i.rank FROM prof p LEFT JOIN imp i USING (feature_name)""")
def q_feature_summary(spark, sf_dir):
    """B02 + J03 + J04 + L09: full-data profile joined with importance and rank."""
    return rounded(event_summary(spark, sf_dir))


@register("importance_top", _base(*_IMPORTANCE) + f"""
SELECT feature_name, {R('importance')} AS importance, rank FROM imp WHERE rank <= {config.TOP_IMPORTANCE_CHART}""")
def q_importance_top(spark, sf_dir):
    """The 20 best-ranked features."""
    s = event_summary(spark, sf_dir)
    return rounded(db.top_ranked(s, config.TOP_IMPORTANCE_CHART).select("feature_name", "importance", "rank"))


SELECTED_SENSORS = ["feature_000", "feature_003"]  # the dashboard's sensor selection input


@register("detail_table", _base(_MASTER) + """
SELECT row_id, Pass_Fail_Label, model_prediction, round_even(fail_probability, 4) + 0.0 AS fail_probability, error_type,
       round_even(feature_000, 4) + 0.0 AS feature_000, round_even(feature_003, 4) + 0.0 AS feature_003
FROM master WHERE model_prediction = 'Pass' ORDER BY row_id LIMIT 500""")
def q_detail_table(spark, sf_dir):
    """L07 + P12: first 500 rows of the detail view (rows predicted Pass) with the
    selected sensors (de-duplicated), half-even rounded to 4 places."""
    m = db.with_error_type(event_master(spark, sf_dir))
    return db.detail_table(db.detail_filter(m, predicted="Pass"), SELECTED_SENSORS + ["feature_000"])


@register("misclassified_rows", _base(_MASTER) + f"""
, per AS (SELECT error_type AS slice, row_id, fail_probability, error_type,
                 row_number() OVER (PARTITION BY error_type ORDER BY fail_probability DESC, row_id) AS rn FROM master),
allr AS (SELECT 'All' AS slice, row_id, fail_probability, error_type FROM master
         ORDER BY fail_probability DESC, row_id LIMIT {config.MISCLASSIFIED_ROWS_PER_TYPE})
SELECT slice, row_id, {R('fail_probability')} AS fail_probability, error_type FROM per
WHERE rn <= {config.MISCLASSIFIED_ROWS_PER_TYPE}
UNION ALL SELECT slice, row_id, {R('fail_probability')}, error_type FROM allr""")
def q_misclassified_rows(spark, sf_dir):
    """Top-150 rows by probability per error type, plus the All slice."""
    return rounded(db.misclassified(db.with_error_type(event_master(spark, sf_dir))))


_TT_TEST = """
tt0 AS (SELECT g.threshold,
               count(*) FILTER (WHERE m.Pass_Fail = 1 AND m.fail_probability >= g.threshold) AS tp,
               count(*) FILTER (WHERE m.Pass_Fail = 0 AND m.fail_probability >= g.threshold) AS fp,
               count(*) FILTER (WHERE m.Pass_Fail = 1 AND m.fail_probability < g.threshold) AS fn
        FROM (SELECT * FROM master WHERE dataset_split = 'test') m, (VALUES {grid}) g(threshold) GROUP BY g.threshold),
tt AS (SELECT threshold, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(tp / nullif(tp + fp, 0), 0) AS precision,
              coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM tt0)""".format(
    grid=", ".join(f"({t}::DOUBLE)" for t in config.THRESHOLD_GRID))


@register("threshold_curve_long", _base(_MASTER, _TT_TEST) + f"""
, lg AS (UNPIVOT tt ON recall, precision, f1 INTO NAME metric VALUE value)
SELECT threshold, metric, {R('value')} AS value FROM lg""")
def q_threshold_curve_long(spark, sf_dir):
    """The held-out threshold sweep in long form (threshold, metric, value)."""
    m = event_master(spark, sf_dir).where(F.col("dataset_split") == "test")
    t = ev.threshold_table(m, config.LABEL_COL, "fail_probability")
    return rounded(db.threshold_curve_long(t.select("threshold", "recall", "precision", "f1")))


@register("distribution_rows", _base(_MASTER) + f"""
, mm AS (SELECT row_id, Pass_Fail_Label, fail_probability, {', '.join(EV)} FROM master),
lg AS (SELECT * FROM mm UNPIVOT INCLUDE NULLS (value FOR feature_name IN ({', '.join(EV)})))
SELECT row_id, Pass_Fail_Label, {R('fail_probability')} AS fail_probability, feature_name, {R('value')} AS value
FROM lg""")
def q_distribution_rows(spark, sf_dir):
    """B12 + R01 + J05: long rows (row, class, sensor, value) of the top-8 ranked
    sensors present in the master table (all six here)."""
    m = event_master(spark, sf_dir)
    feats = db.ranked_feature_names(event_summary(spark, sf_dir), config.TOP_DISTRIBUTION_SENSORS, m.columns)
    return rounded(db.distribution_rows(m, feats))


SCATTER_SENSORS = EV[:5]  # explicit sensor list for the scatter matrix


@register("scatter_matrix_rows", _base(_MASTER) + f"""
, t AS (SELECT * FROM master WHERE dataset_split = 'test'),
c AS (SELECT Pass_Fail, count(*) AS nc, sum(count(*)) OVER () AS n FROM t GROUP BY Pass_Fail),
q AS (SELECT Pass_Fail, CASE WHEN n > {config.SCATTER_SAMPLE_ROWS}
                             THEN round_even({float(config.SCATTER_SAMPLE_ROWS)} / n * nc, 0) ELSE nc END AS keep FROM c),
r AS (SELECT t.*, row_number() OVER (PARTITION BY Pass_Fail ORDER BY {S.md5_key('row_id', salt='sample')}, row_id) AS ord
      FROM t)
SELECT row_id, Pass_Fail_Label, {R('fail_probability')} AS fail_probability, model_prediction,
       CASE WHEN model_prediction = Pass_Fail_Label THEN 'Correct' ELSE 'Incorrect' END AS prediction_match,
       {', '.join(f"{R(c)} AS {c}" for c in EV[:5])}
FROM r JOIN q USING (Pass_Fail) WHERE ord <= keep""")
def q_scatter_matrix_rows(spark, sf_dir):
    """B13 + P07 + P10 + R06: test rows, five sensors, match flag, 500-row
    class-stratified sample."""
    return rounded(db.scatter_matrix_rows(event_master(spark, sf_dir), SCATTER_SENSORS))


@register("scatter_rows", _base(_MASTER) + f"""
SELECT row_id, Pass_Fail_Label, {R('feature_000')} AS x, {R('feature_001')} AS y,
       {R('fail_probability')} AS fail_probability, model_prediction
FROM master WHERE model_prediction = 'Fail'""")
def q_scatter_rows(spark, sf_dir):
    """Two-sensor scatter of the rows predicted Fail."""
    m = db.with_error_type(event_master(spark, sf_dir))
    return rounded(db.scatter_rows(db.detail_filter(m, predicted="Fail"), "feature_000", "feature_001"))


SCORERS = {
    "ValueRatioScore": SCORE_EXPR,
    "RawValueRatio": "feature_000 / (feature_000 + 50.0)",
    "HourOfDay": "feature_002 / 24.0",
}
_SCORERS_SQL = " UNION ALL ".join(
    f"SELECT '{name}' AS Model, Pass_Fail, {expr} AS score FROM split WHERE dataset_split = 'test'"
    for name, expr in SCORERS.items())
_COMPARISON = [
    f"sc AS ({_SCORERS_SQL})",
    _lv("rk", "sc", "Model"),
    """cm AS (SELECT Model, count(*) FILTER (WHERE Pass_Fail = 1 AND score >= 0.5) AS tp,
              count(*) FILTER (WHERE Pass_Fail = 0 AND score >= 0.5) AS fp,
              count(*) FILTER (WHERE Pass_Fail = 1 AND score < 0.5) AS fn FROM sc GROUP BY Model)""",
    f"""cmp AS (SELECT Model, {R('coalesce(tp / nullif(tp + fn, 0), 0)')} AS Recall,
              {R('coalesce(tp / nullif(tp + fp, 0), 0)')} AS Precision,
              {R('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS F1,
              {R('ap')} AS PR_AUC, {R('auc')} AS ROC_AUC,
              CAST(fp AS BIGINT) AS False_Positives, CAST(fn AS BIGINT) AS False_Negatives
       FROM cm JOIN rk USING (Model))""",
]


def _scorer_comparison(spark, sf_dir):
    test = event_split(spark, sf_dir).where(F.col("dataset_split") == "test")
    parts = None
    for name, expr in SCORERS.items():
        p = test.select(F.lit(name).alias("Model"), config.LABEL_COL, F.expr(expr).cast("double").alias("score"))
        parts = p if parts is None else parts.unionByName(p)
    m = ev.metrics_at_threshold(parts, config.LABEL_COL, "score", 0.5, ["Model"])
    return rounded(m.select("Model", F.col("recall").alias("Recall"), F.col("precision").alias("Precision"),
                            F.col("f1").alias("F1"), F.col("pr_auc").alias("PR_AUC"), F.col("roc_auc").alias("ROC_AUC"),
                            F.col("false_positives").alias("False_Positives"),
                            F.col("false_negatives").alias("False_Negatives")))


@register("scorer_comparison", _base(*_COMPARISON) + " SELECT * FROM cmp")
def q_scorer_comparison(spark, sf_dir):
    """E08 shape: three fixed scoring rules compared on the held-out events in one
    grouped plan (metrics at 0.5, PR-AUC, ROC-AUC)."""
    return _scorer_comparison(spark, sf_dir)


@register("best_scorer", _base(*_COMPARISON) + " SELECT * FROM cmp ORDER BY PR_AUC DESC, Model LIMIT 1")
def q_best_scorer(spark, sf_dir):
    """Best by held-out PR-AUC, first name wins ties."""
    return ev.best_row(_scorer_comparison(spark, sf_dir), "PR_AUC", "Model")


_TT_FULL = _TT_TEST.replace("coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM tt0)",
                            "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, fp, fn FROM tt0)")


@register("threshold_kpi_text", _base(_MASTER, _TT_FULL) + """
SELECT threshold, printf('Threshold=%.2f  |  Recall=%.3f  |  Precision=%.3f  |  F1=%.3f  |  FP=%d  |  FN=%d',
                         round_even(threshold, 2), round_even(recall, 3), round_even(precision, 3), round_even(f1, 3),
                         CAST(fp AS INTEGER), CAST(fn AS INTEGER)) AS kpi_text
FROM tt""")
def q_threshold_kpi_text(spark, sf_dir):
    """B14 + F10: KPI text line per threshold of the held-out sweep."""
    m = event_master(spark, sf_dir).where(F.col("dataset_split") == "test")
    return db.threshold_kpi_text(ev.threshold_table(m, config.LABEL_COL, "fail_probability"))


@register("kpi_cards", _base(_MASTER, "t AS (SELECT *, fail_probability AS score FROM master "
                                      "WHERE dataset_split = 'test')", _lv("rk", "t")) + """
, k AS (SELECT count(*) AS total, count(*) FILTER (WHERE Pass_Fail = 1) AS fails,
               arg_min(prediction_threshold, row_id) AS thr,
               coalesce(count(*) FILTER (WHERE Pass_Fail = 1) / nullif(count(*), 0), 0) AS rate,
               coalesce(count(*) FILTER (WHERE error_type = 'TP') / nullif(count(*) FILTER (WHERE Pass_Fail = 1), 0), 0)
                 AS recall,
               coalesce(count(*) FILTER (WHERE error_type = 'TP') / nullif(count(*) FILTER (WHERE predicted_class = 1), 0), 0)
                 AS precision,
               (SELECT ap FROM rk) AS ap FROM t)
SELECT format('{:,}', total) AS total_samples_text, format('{:,}', fails) AS fail_count_text,
       printf('%.2f%%', round_even(rate * 100, 2)) AS fail_rate_text, printf('%.3f', round_even(recall, 3)) AS recall_text,
       printf('%.3f', round_even(precision, 3)) AS precision_text, printf('%.3f', round_even(ap, 3)) AS pr_auc_text,
       printf('%.2f', round_even(thr, 2)) AS threshold_text
FROM k""")
def q_kpi_cards(spark, sf_dir):
    """B04 + F10: KPI cards as display text."""
    return db.kpi_cards(event_kpis(spark, sf_dir))
