"""Queries of the tree learner, of exact attributions and of synthetic minority points, each with SQL that
follows the arithmetic (M04, E11, R05, J08).

The sensors of the first two are events with at most 256 distinct values each, so the learner's thresholds are
all of them and SQL can enumerate the same splits; two sensors miss values, one of them mostly in failures.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.boosting import HistogramBoosting
from sensor_yield.operators.importance import tree_attributions
from sensor_yield.operators.resample import synthetic_rows
from sensor_yield.operators.splits import stratified_split
from sensor_yield.operators.transforms import FeatureAssembler, base_stages
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.sources import driver_tables as D

SENSORS = [f"feature_{i:03d}" for i in range(6)]
#: The sensors over ``events``, in words that both engines read.
EXPRESSIONS = ["floor(value / 4)", "CAST(user_id % 50 AS DOUBLE)", "CAST(hour(ts) AS DOUBLE)",
               "CASE WHEN event_type = 'view' THEN NULL ELSE floor(value / 4) END",
               "CASE WHEN event_type = 'error' AND user_id % 3 < 2 THEN NULL ELSE CAST(user_id % 7 AS DOUBLE) END",
               "CAST(1 AS DOUBLE)"]
#: 1.1 is no sum of hessians, so no split is admitted or not by rounding.
RATE, LEAST = 0.3, 1.1
DEPTH_ONE = {"maxIter": 1, "maxDepth": 1, "stepSize": RATE, "minChildWeight": LEAST, "scalePos": True}


def event_bins(spark, sf_dir):
    return D.load_table(spark, sf_dir, "events").selectExpr(
        "event_id AS row_id", f"CAST(event_type = 'error' AS INT) AS {config.LABEL_COL}",
        *[f"CAST({e} AS DOUBLE) AS {c}" for e, c in zip(EXPRESSIONS, SENSORS)])


_GAINS = with_ctes(f"""
ev AS (SELECT event_id AS row_id, CAST(event_type = 'error' AS INTEGER) AS y,
              [{', '.join(f'CAST({e} AS DOUBLE)' for e in EXPRESSIONS)}] AS x FROM events)""", """
wt AS (SELECT sum(1 - y) / greatest(sum(y), 1) AS w1 FROM ev)""", """
gr AS (SELECT row_id, x, CASE WHEN y = 1 THEN w1 ELSE 1.0 END * (0.5 - y) AS g,
              CASE WHEN y = 1 THEN w1 ELSE 1.0 END * 0.25 AS h FROM ev, wt)""", """
whole AS (SELECT sum(g) AS g, sum(h) AS h, count(*) AS n FROM gr)""", """
lg AS (SELECT i AS f, x[i + 1] AS v, g, h FROM gr, range(6) r(i))""", """
ag AS (SELECT f, v, sum(g) AS g, sum(h) AS h, count(*) AS n FROM lg GROUP BY f, v)""", """
gone AS (SELECT f, g, h, n FROM ag WHERE v IS NULL)""", """
up AS (SELECT f, lead(v) OVER w AS threshold, sum(g) OVER w AS g, sum(h) OVER w AS h, sum(n) OVER w AS n
       FROM ag WHERE v IS NOT NULL WINDOW w AS (PARTITION BY f ORDER BY v))""", """
sides AS (SELECT f, threshold, false AS missing_left, g, h, n FROM up
          UNION ALL SELECT up.f, threshold, true, up.g + gone.g, up.h + gone.h, up.n + gone.n FROM up JOIN gone ON up.f = gone.f)""", f"""
gains AS (SELECT f, threshold, missing_left, s.g AS gl, s.h AS hl, s.n AS nl, a.g - s.g AS gr, a.h - s.h AS hr, a.n - s.n AS nr,
                 0.5 * (s.g * s.g / (s.h + 1) + (a.g - s.g) * (a.g - s.g) / (a.h - s.h + 1) - a.g * a.g / (a.h + 1)) AS gain
          FROM sides s, whole a WHERE s.n > 0 AND s.n < a.n AND s.h >= {LEAST} AND a.h - s.h >= {LEAST})""")


@register("boosting_split_gains", _GAINS + f"""
SELECT CAST(f AS INTEGER) AS feature, threshold, missing_left, {R('gain', 4)} AS gain, CAST(nl AS BIGINT) AS n_left,
       CAST(nr AS BIGINT) AS n_right FROM gains""")
def q_boosting_split_gains(spark, sf_dir):
    """Every split of the first node of the first tree with its gain, missing values on either side."""
    df = FeatureAssembler(keepMissing=True).transform(event_bins(spark, sf_dir))
    return rounded(HistogramBoosting(**DEPTH_ONE).root_splits(df).select(
        "feature", "threshold", "missing_left", "gain", "n_left", "n_right"), 4)


@register("boosting_stump_attribution", _GAINS + f"""
, best AS (SELECT *, -{RATE} * gl / (hl + 1) AS vl, -{RATE} * gr / (hr + 1) AS vr FROM gains
           ORDER BY gain DESC, f, threshold NULLS LAST, missing_left LIMIT 1),
scored AS (SELECT row_id, f, (nl * vl + nr * vr) / (nl + nr) AS mean,
                  CASE WHEN x[f + 1] IS NULL THEN CASE WHEN missing_left THEN vl ELSE vr END
                       WHEN threshold IS NULL OR x[f + 1] < threshold THEN vl ELSE vr END AS margin FROM gr, best)
SELECT row_id, {R('margin')} AS margin, {', '.join(f"{R(f'CASE WHEN f = {i} THEN margin - mean ELSE 0 END')} AS phi_{i}" for i in range(6))}
FROM scored""")
def q_boosting_stump_attribution(spark, sf_dir):
    """M04 + E11: one split learned on all events; every event's margin and the exact attribution of each sensor."""
    df = event_bins(spark, sf_dir)
    model = Pipeline(stages=[FeatureAssembler(keepMissing=True), HistogramBoosting(**DEPTH_ONE)]).fit(df)
    phi, names, _ = tree_attributions(model, df, config.ROW_ID_COL)
    margins = model.transform(df).select(config.ROW_ID_COL, "margin")
    return rounded(margins.join(phi, config.ROW_ID_COL).select(
        config.ROW_ID_COL, "margin", *[F.col("phi")[i].alias(f"phi_{i}") for i in range(len(names))]))


_POINTS = with_ctes(S.EMBEDDING_ROWS, S.split_cte("emb"), """
tr AS (SELECT s.row_id, s.Pass_Fail, list_transform(e.embedding, lambda v: CAST(v AS DOUBLE)) AS x
       FROM split s JOIN embeddings e ON e.vec_id = s.row_id WHERE dataset_split = 'train')""", """
cls AS (SELECT Pass_Fail, count(*) AS n FROM tr GROUP BY Pass_Fail)""", """
least AS (SELECT Pass_Fail, n, (SELECT max(n) FROM cls) - n AS n_new FROM cls ORDER BY n, Pass_Fail LIMIT 1)""", """
mn AS (SELECT tr.*, row_number() OVER (ORDER BY row_id) AS ord, least.n, n_new FROM tr JOIN least USING (Pass_Fail))""", """
ds AS (SELECT a.row_id AS q, b.row_id AS nb, list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
       FROM mn a JOIN mn b ON a.row_id <> b.row_id)""", """
nn AS (SELECT q, nb, row_number() OVER (PARTITION BY q ORDER BY d, nb) - 1 AS r FROM ds QUALIFY r < 5)""", f"""
pk AS (SELECT s, CAST(floor(CAST(('0x' || substr({S.md5_key('s', salt='smote_pick')}, 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0
                            * (n * least(5, n - 1))) AS BIGINT) AS p, least(5, n - 1) AS k,
              CAST(('0x' || substr({S.md5_key('s', salt='smote_step')}, 1, 13))::UBIGINT AS DOUBLE) / 4503599627370496.0 AS u
       FROM least, LATERAL (SELECT unnest(range(n_new)) AS s))""") + f"""
SELECT s, a.row_id AS base_id, b.row_id AS nb_id, CAST(i - 1 AS INTEGER) AS i, {R('a.x[i] + u * (b.x[i] - a.x[i])')} AS value
FROM pk JOIN mn a ON a.ord = p // k + 1 JOIN nn ON nn.q = a.row_id AND nn.r = p % k JOIN mn b ON b.row_id = nn.nb,
     LATERAL (SELECT unnest(range(1, len(a.x) + 1)) AS i)"""


@register("smote_points", _POINTS)
def q_smote_points(spark, sf_dir):
    """R05 + J08: the synthetic minority points of the embedding training split: base row, the neighbour picked
    among its five nearest, and every value of the point between them."""
    split = stratified_split(D.embedding_sensors(spark, sf_dir), config.ROW_ID_COL)
    train = split.where(F.col("dataset_split") == "train").drop("dataset_split")
    prepared = Pipeline(stages=base_stages()).fit(train).transform(train)
    new = synthetic_rows(prepared, config.ROW_ID_COL, config.LABEL_COL, "features")
    return rounded(new.select("s", "base_id", "nb_id", F.posexplode("x").alias("i", "value")))


@register("boosting_attribution_importance")
def q_boosting_attribution_importance(spark, sf_dir):
    """Exact attributions of boosted trees (20 of depth 3) over all events, their mean size per sensor, and
    how far the rows' sums are from margin minus mean at most."""
    df = event_bins(spark, sf_dir)
    model = Pipeline(stages=[FeatureAssembler(keepMissing=True), HistogramBoosting(
        maxIter=20, maxDepth=3, scalePos=True, maxBins=64)]).fit(df)
    phi, names, mean = tree_attributions(model, df, config.ROW_ID_COL)
    scored = PipelineModel(stages=model.stages).transform(df).select(config.ROW_ID_COL, "margin").join(phi, config.ROW_ID_COL)
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return scored.select("phi", F.abs(F.col("margin") - mean - total).alias("off")).select(
        F.posexplode("phi").alias("i", "v"), "off").groupBy("i").agg(
        F.avg(F.abs("v")).alias("importance"), F.max("off").alias("largest_gap"))
