"""Chart datasets of the exploration and the dashboard guide, and the exploration document's figures."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators import charts
from sensor_yield.operators import evaluation as ev
from sensor_yield.operators import profile as prof
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.plans.eda import document_rows, eda_summary
from sensor_yield.plans.queries_marts import _IMPORTANCE, _MASTER, _base, event_importance, event_master, rule_sql
from sensor_yield.sources import driver_tables as D

EV, LI = D.EVENT_FEATURES, D.LINEITEM_FEATURES


@register("chart_class_distribution", with_ctes(S.LINEITEM_SENSORS) + """
SELECT CASE WHEN Pass_Fail = 1 THEN 'Fail' ELSE 'Pass' END AS class, CAST(count(*) AS BIGINT) AS n FROM li GROUP BY 1""")
def q_chart_class_distribution(spark, sf_dir):
    """Class bars of the order lines."""
    return charts.class_bars(D.lineitem_sensors(spark, sf_dir))


@register("chart_usable_features", with_ctes(S.LINEITEM_SENSORS, "v AS (" + " UNION ALL ".join(
    f"SELECT var_samp({c}) AS x FROM li" for c in LI) + ")") + f"""
SELECT 'Usable' AS kind, CAST(count(*) FILTER (WHERE x >= {config.LOW_VARIANCE_THRESHOLD}) AS BIGINT) AS n_features FROM v
UNION ALL SELECT 'Constant/Low-Variance',
       CAST(count(*) FILTER (WHERE x IS NULL OR x < {config.LOW_VARIANCE_THRESHOLD}) AS BIGINT) FROM v""")
def q_chart_usable_features(spark, sf_dir):
    """Usable against constant features."""
    return charts.usable_bars(prof.feature_profile(D.lineitem_sensors(spark, sf_dir), LI))


def _boxes_sql(rows: str, extra: str = "") -> str:
    """Box statistics of ``lg`` (feature_name, class, v)."""
    return f"""
lg AS ({rows}),
q AS (SELECT feature_name, class, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3
      FROM lg WHERE v IS NOT NULL GROUP BY ALL)
SELECT {extra}feature_name, class, {R('q1')} AS q1, {R('median')} AS median, {R('q3')} AS q3, {R('q3 - q1')} AS iqr,
       {R('min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
       {R('max(v) FILTER (WHERE v <= q3 + 1.5 * (q3 - q1))')} AS whisker_high,
       CAST(count(*) FILTER (WHERE v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS n_outliers"""


@register("chart_sensor_boxes", with_ctes(S.LINEITEM_SENSORS) + "," + _boxes_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, CASE WHEN Pass_Fail = 1 THEN 'Fail' ELSE 'Pass' END AS class, {c} AS v FROM li"
    for c in ("feature_000", "feature_005", "feature_007"))) + """
FROM lg JOIN q USING (feature_name, class) WHERE v IS NOT NULL GROUP BY feature_name, class, q1, median, q3""")
def q_chart_sensor_boxes(spark, sf_dir):
    """B17 + A15: box statistics of several sensors by class, from one long table."""
    return rounded(charts.class_boxes(D.lineitem_sensors(spark, sf_dir), ["feature_000", "feature_005", "feature_007"]))


@register("sensor_trellis", _base(_MASTER, *_IMPORTANCE) + "," + _boxes_sql(" UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, Pass_Fail_Label AS class, {c} AS v FROM master WHERE dataset_split = 'test'" for c in EV),
    "rank, ") + """
FROM lg JOIN q USING (feature_name, class) JOIN imp USING (feature_name) WHERE v IS NOT NULL AND rank <= 2
GROUP BY rank, feature_name, class, q1, median, q3""")
def q_sensor_trellis(spark, sf_dir):
    """The two most important sensors of the held-out events, a panel each, boxes by class."""
    return rounded(charts.sensor_trellis(event_master(spark, sf_dir), event_importance(spark, sf_dir)))


_MODELS = {"ValueRatio": "fail_probability", "ThreeSensors": rule_sql()}


@register("threshold_cross_table", _base(
    "sc AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, Pass_Fail, {e} AS score FROM split WHERE dataset_split = 'test'"
                                   for m, e in _MODELS.items()) + ")",
    "g AS (SELECT t / 100.0 AS threshold FROM range(5, 100, 5) r(t))",
    """m AS (SELECT model, threshold, count(*) FILTER (WHERE Pass_Fail = 1 AND score >= threshold) AS tp,
       count(*) FILTER (WHERE Pass_Fail = 0 AND score >= threshold) AS fp,
       count(*) FILTER (WHERE Pass_Fail = 1 AND score < threshold) AS fn FROM sc, g GROUP BY ALL)""") + """
SELECT threshold, """ + ", ".join(
    f"""max(CASE WHEN model = '{m}' THEN {R('coalesce(tp / nullif(tp + fn, 0), 0)')} END) AS "{m}_recall",
max(CASE WHEN model = '{m}' THEN {R('coalesce(tp / nullif(tp + fp, 0), 0)')} END) AS "{m}_precision",
max(CASE WHEN model = '{m}' THEN {R('coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0)')} END) AS "{m}_f1\"""" for m in _MODELS)
    + " FROM m GROUP BY threshold")
def q_threshold_cross_table(spark, sf_dir):
    """Recall, precision and F1 per threshold, two rules side by side, on the held-out events."""
    test = event_master(spark, sf_dir).where(F.col("dataset_split") == "test")
    models = F.array(*[F.struct(F.lit(m).alias("model"), F.expr(e).cast("double").alias("score")) for m, e in _MODELS.items()])
    scores = test.select(config.LABEL_COL, F.inline(models))
    table = ev.threshold_table(scores, config.LABEL_COL, "score", config.THRESHOLD_GRID, ["model"])
    return rounded(charts.threshold_cross_table(table, list(_MODELS)))


def _document_sql() -> str:
    profile = " UNION ALL ".join(f"SELECT (count(*) - count({c})) / count(*) AS mr, var_samp({c}) AS vs FROM ev" for c in EV)
    pairs = " + ".join(f"(CASE WHEN isfinite(corr({a}, {b})) AND abs(corr({a}, {b})) > {config.HIGH_CORR_THRESHOLD} THEN 1 ELSE 0 END)"
                       for a, b in combinations(EV, 2))
    figures = {
        "n_rows": "(SELECT count(*) FROM ev)", "n_features": str(len(EV)),
        "n_duplicate_feature_rows": f"(SELECT coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM ev GROUP BY {', '.join(EV)}))",
        "fail_rate": "(SELECT avg(Pass_Fail) FROM ev)",
        "class_counts.Pass": "(SELECT count(*) FROM ev WHERE Pass_Fail = 0)",
        "class_counts.Fail": "(SELECT count(*) FROM ev WHERE Pass_Fail = 1)",
        "missing_ratio.mean": "(SELECT avg(mr) FROM p)", "missing_ratio.median": "(SELECT median(mr) FROM p)",
        "missing_ratio.max": "(SELECT max(mr) FROM p)",
        "n_low_variance_features": f"(SELECT count(*) FROM p WHERE vs IS NULL OR vs < {config.LOW_VARIANCE_THRESHOLD})",
        "n_high_correlation_pairs": f"(SELECT {pairs} FROM ev)",
        "time_structure.fail_rate_std_across_months": "(SELECT stddev_pop(r) FROM mo)",
    }
    for t in config.MISSING_RATIO_THRESHOLDS:
        figures[f"missing_threshold_comparison.{t}.n_dropped"] = f"(SELECT count(*) FROM p WHERE mr > {t})"
        figures[f"missing_threshold_comparison.{t}.n_kept"] = f"(SELECT count(*) FROM p WHERE mr <= {t})"
    rows = " UNION ALL ".join(f"SELECT '{k}' AS path, {R(v)} AS value" for k, v in figures.items())
    return with_ctes(S.EVENT_SCORES, f"p AS ({profile})",
                     """mo AS (SELECT strftime("Time", '%Y-%m') AS m, avg(Pass_Fail) AS r FROM ev GROUP BY 1)""") + f"""
{rows} UNION ALL SELECT 'time_structure.fail_rate_by_month.' || m, {R('r')} FROM mo"""


@register("eda_document_figures", _document_sql())
def q_eda_document_figures(spark, sf_dir):
    """The figures of the exploration document of the events, one row per figure (without the components'
    variance and the time span, which other queries cover)."""
    df = D.event_scores(spark, sf_dir).drop("fail_probability", config.LABEL_TEXT_COL)
    rows = document_rows(spark, eda_summary(df))
    return rounded(rows.where(~F.col("path").rlike("^(pca_|n_columns|column_type|time_structure.(is_|time_span))")))
