"""Profile, correlation, time-structure and split queries (A01-A11, A17-A19, A20,
L01-L03, P03-P04, W02, R03-R08, U02)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.columns import feature_columns
from sensor_yield.functions.labels import unexpected_raw_labels
from sensor_yield.operators import correlation as corr
from sensor_yield.operators import profile as prof
from sensor_yield.operators import splits
from sensor_yield.operators.quantiles import exact_medians, exact_quantiles
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.sources import driver_tables as D

LI = D.LINEITEM_FEATURES
EV = D.EVENT_FEATURES


def _profile_sql(frame_cte: str, frame: str, cols: list[str]) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, count(*) AS n_rows, count({c}) AS n_present, "
        f"var_samp({c}) AS variance FROM {frame}" for c in cols)
    return with_ctes(frame_cte, f"p AS ({parts})") + _FLAGS


_FLAGS = f"""
SELECT feature_name, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_present AS BIGINT) AS n_present,
       {R('(n_rows - n_present) / n_rows')} AS missing_ratio, {R('variance')} AS variance,
       (n_rows - n_present) / n_rows > {config.MODELING_MISSING_THRESHOLD} AS above_missing_threshold,
       (variance IS NULL OR variance < {config.LOW_VARIANCE_THRESHOLD}) AS low_variance
FROM p"""


def _profile_cte(frame_cte: str, frame: str, cols: list[str]) -> list[str]:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature_name, count(*) AS n_rows, count({c}) AS n_present, "
        f"var_samp({c}) AS variance FROM {frame}" for c in cols)
    return [frame_cte, f"p0 AS ({parts})",
            "p AS (SELECT feature_name, variance, (n_rows - n_present) / n_rows AS missing_ratio FROM p0)"]


@register("feature_profile", _profile_sql(S.LINEITEM_SENSORS, "li", LI))
def q_feature_profile(spark, sf_dir):
    """A01 + A02 + P03 + P04 on the lineitem sensor frame (wide aggregate path)."""
    return rounded(prof.flagged_profile(D.lineitem_sensors(spark, sf_dir), LI))


@register("document_feature_profile", _profile_sql(S.DOCUMENT_SENSORS, "docs", D.DOCUMENT_FEATURES))
def q_document_feature_profile(spark, sf_dir):
    """A01 + A02 on documents left join labels (label columns 60 % missing)."""
    return rounded(prof.flagged_profile(D.document_sensors(spark, sf_dir), D.DOCUMENT_FEATURES))


_EMBEDDING_PROFILE = ("p AS (SELECT f AS feature_name, count(*) AS n_rows, count(v) AS n_present, "
                      "var_samp(v) AS variance FROM long GROUP BY f)")


@register("embedding_feature_profile", with_ctes(S.EMBEDDING_LONG, _EMBEDDING_PROFILE) + _FLAGS)
def q_embedding_feature_profile(spark, sf_dir):
    """A01 + A02 on all embedding columns (long / unpivot path)."""
    df = D.embedding_sensors(spark, sf_dir)
    return rounded(prof.flagged_profile(df, feature_columns(df)))


@register("missing_ratio_summary", with_ctes(*_profile_cte(S.LINEITEM_SENSORS, "li", LI)) + f"""
SELECT CAST(count(missing_ratio) AS BIGINT) AS n_features, {R('avg(missing_ratio)')} AS mean,
       {R('stddev_samp(missing_ratio)')} AS std, {R('min(missing_ratio)')} AS min,
       {R('quantile_cont(missing_ratio, 0.25)')} AS q25, {R('quantile_cont(missing_ratio, 0.5)')} AS median,
       {R('quantile_cont(missing_ratio, 0.75)')} AS q75, {R('max(missing_ratio)')} AS max
FROM p""")
def q_missing_ratio_summary(spark, sf_dir):
    """A05."""
    return rounded(prof.missing_ratio_summary(prof.feature_profile(D.lineitem_sensors(spark, sf_dir), LI)))


@register("missing_threshold_comparison", with_ctes(*_profile_cte(S.LINEITEM_SENSORS, "li", LI)) + """
SELECT t.threshold,
       CAST(count(*) FILTER (WHERE p.missing_ratio > t.threshold) AS BIGINT) AS n_dropped,
       CAST(count(*) FILTER (WHERE NOT (p.missing_ratio > t.threshold)) AS BIGINT) AS n_kept
FROM p, (VALUES (0.4::DOUBLE), (0.5::DOUBLE), (0.7::DOUBLE)) t(threshold)
GROUP BY t.threshold""")
def q_missing_threshold_comparison(spark, sf_dir):
    """A06."""
    return rounded(prof.missing_threshold_comparison(prof.feature_profile(D.lineitem_sensors(spark, sf_dir), LI)))


@register("low_variance_counts", with_ctes(*_profile_cte(S.LINEITEM_SENSORS, "li", LI)) + f"""
SELECT CAST(count(*) FILTER (WHERE variance IS NULL OR variance < {config.LOW_VARIANCE_THRESHOLD}) AS BIGINT)
         AS n_low_variance,
       CAST(count(*) FILTER (WHERE NOT (variance IS NULL OR variance < {config.LOW_VARIANCE_THRESHOLD})) AS BIGINT)
         AS n_usable
FROM p""")
def q_low_variance_counts(spark, sf_dir):
    """A07."""
    return prof.low_variance_counts(prof.feature_profile(D.lineitem_sensors(spark, sf_dir), LI))


@register("top_variance_features", with_ctes(S.EMBEDDING_LONG, _EMBEDDING_PROFILE) + f"""
SELECT feature_name, {R('variance')} AS variance FROM p WHERE variance IS NOT NULL
ORDER BY variance DESC, feature_name LIMIT {config.TOP_N_FEATURES}""")
def q_top_variance_features(spark, sf_dir):
    """Top-30 variance features of the embedding frame."""
    df = D.embedding_sensors(spark, sf_dir)
    p = prof.feature_profile(df, feature_columns(df))
    return rounded(prof.top_features(p, "variance", config.TOP_N_FEATURES))


@register("top_missing_features", with_ctes(*_profile_cte(S.LINEITEM_SENSORS, "li", LI)) + f"""
SELECT feature_name, {R('missing_ratio')} AS missing_ratio FROM p WHERE missing_ratio IS NOT NULL
ORDER BY missing_ratio DESC, feature_name LIMIT {config.TOP_N_FEATURES}""")
def q_top_missing_features(spark, sf_dir):
    """L02."""
    p = prof.feature_profile(D.lineitem_sensors(spark, sf_dir), LI)
    return rounded(prof.top_features(p, "missing_ratio", config.TOP_N_FEATURES))


@register("class_counts", with_ctes(S.EVENT_SCORES) + f"""
SELECT CAST(count(*) AS BIGINT) AS n_rows,
       CAST(count(*) FILTER (WHERE Pass_Fail = 0) AS BIGINT) AS n_pass,
       CAST(count(*) FILTER (WHERE Pass_Fail = 1) AS BIGINT) AS n_fail,
       {R('avg(Pass_Fail)')} AS fail_rate
FROM ev""")
def q_class_counts(spark, sf_dir):
    """A03."""
    return rounded(prof.class_counts(D.event_scores(spark, sf_dir)))


@register("class_ratio", with_ctes(S.LINEITEM_SENSORS) + f"""
SELECT CAST(count(*) FILTER (WHERE Pass_Fail = 0) AS BIGINT) AS n_pass,
       CAST(count(*) FILTER (WHERE Pass_Fail = 1) AS BIGINT) AS n_fail,
       {R('count(*) FILTER (WHERE Pass_Fail = 0) / greatest(count(*) FILTER (WHERE Pass_Fail = 1), 1)')}
         AS scale_pos_weight
FROM li""")
def q_class_ratio(spark, sf_dir):
    """A11."""
    return rounded(prof.class_ratio(D.lineitem_sensors(spark, sf_dir)))


@register("duplicate_conversation_rows", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicate_rows, CAST(count(*) AS BIGINT) AS n_distinct_rows
FROM (SELECT role, text, count(*) AS c FROM conversations GROUP BY role, text)""")
def q_duplicate_conversation_rows(spark, sf_dir):
    """A04 on conversation (role, text) rows."""
    return prof.duplicate_rows(D.load_table(spark, sf_dir, "conversations"), ["role", "text"])


_COARSE = "CASE WHEN CAST(x AS DOUBLE) > 0.25 THEN NULL ELSE round(CAST(x AS DOUBLE) * 2) END"


@register("duplicate_embedding_rows", f"""
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicate_rows, CAST(count(*) AS BIGINT) AS n_distinct_rows
FROM (SELECT count(*) AS c FROM (SELECT list_transform(embedding, lambda x: {_COARSE}) AS v FROM embeddings) GROUP BY v)""")
def q_duplicate_embedding_rows(spark, sf_dir):
    """A04 over whole feature vectors: every embedding value coarsened to few values, the largest missing."""
    df = D.embedding_sensors(spark, sf_dir)
    cols = [c for c in df.columns if c.startswith(config.FEATURE_PREFIX)]
    coarse = df.select(*[F.expr(_COARSE.replace("x", c)).alias(c) for c in cols])
    return prof.duplicate_rows(coarse, cols)


@register("duplicate_event_rows", """
SELECT CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS n_duplicate_rows, CAST(count(*) AS BIGINT) AS n_distinct_rows
FROM (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY user_id, event_type)""")
def q_duplicate_event_rows(spark, sf_dir):
    """A04 with many identical groups (user, event type)."""
    return prof.duplicate_rows(D.load_table(spark, sf_dir, "events"), ["user_id", "event_type"])


@register("unexpected_raw_labels", """
SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END AS raw_label
FROM orders
WHERE CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN -1 ELSE 0 END NOT IN (-1, 1)""")
def q_unexpected_raw_labels(spark, sf_dir):
    """A18 + U02: raw labels (F -> 1, O -> -1, other -> 0) outside {-1, 1}."""
    o = D.load_table(spark, sf_dir, "orders")
    raw = (F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", -1).otherwise(0))
    return unexpected_raw_labels(o.select(raw.alias(config.LABEL_RAW_COL)))


def _pairs_sql(frame_cte: str, frame: str, cols: list[str], threshold: float | None) -> str:
    parts = []
    for a in range(len(cols)):
        for b in range(a + 1, len(cols)):
            parts.append(f"SELECT '{cols[a]}' AS feature_1, '{cols[b]}' AS feature_2, "
                         f"corr({cols[a]}, {cols[b]}) AS r FROM {frame}")
    cond = "" if threshold is None else f" AND abs(r) > {threshold}"
    return with_ctes(frame_cte, f"pairs AS ({' UNION ALL '.join(parts)})") + f"""
SELECT feature_1, feature_2, {R('r')} AS correlation FROM pairs
WHERE r IS NOT NULL AND NOT isnan(r){cond}"""


@register("high_correlation_pairs", _pairs_sql(S.LINEITEM_SENSORS, "li", LI, config.HIGH_CORR_THRESHOLD))
def q_high_correlation_pairs(spark, sf_dir):
    """A09 at 0.95 on the lineitem frame (pairwise-complete, constant column skipped)."""
    return rounded(corr.high_correlation_pairs(D.lineitem_sensors(spark, sf_dir), LI))


@register("correlation_pairs", _pairs_sql(S.LINEITEM_SENSORS, "li", LI, None))
def q_correlation_pairs(spark, sf_dir):
    """A09 / R02 without threshold: every defined upper-triangle pair."""
    return rounded(corr.pairwise_correlation(D.lineitem_sensors(spark, sf_dir), LI))


@register("top_correlation_pairs", f"""
WITH {S.EMBEDDING_LONG},
pairs AS (
  SELECT a.k AS ka, b.k AS kb, corr(a.v, b.v) AS r
  FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.k < b.k
  GROUP BY a.k, b.k)
SELECT 'feature_' || lpad(CAST(ka - 1 AS VARCHAR), 3, '0') AS feature_1,
       'feature_' || lpad(CAST(kb - 1 AS VARCHAR), 3, '0') AS feature_2,
       {R('r')} AS correlation
FROM pairs WHERE r IS NOT NULL AND NOT isnan(r)
ORDER BY abs(r) DESC, feature_1, feature_2 LIMIT 20""")
def q_top_correlation_pairs(spark, sf_dir):
    """The first 20 pairs of the abs-sorted correlation list (embeddings)."""
    df = D.embedding_sensors(spark, sf_dir)
    return rounded(corr.high_correlation_pairs(df, feature_columns(df), 0.0).limit(20))


@register("embedding_correlation_pairs", f"""
WITH {S.EMBEDDING_LONG},
pairs AS (
  SELECT a.k AS ka, b.k AS kb, corr(a.v, b.v) AS r
  FROM long a JOIN long b ON a.vec_id = b.vec_id AND a.k < b.k
  GROUP BY a.k, b.k)
SELECT 'feature_' || lpad(CAST(ka - 1 AS VARCHAR), 3, '0') AS feature_1,
       'feature_' || lpad(CAST(kb - 1 AS VARCHAR), 3, '0') AS feature_2,
       {R('r')} AS correlation
FROM pairs WHERE r IS NOT NULL AND NOT isnan(r)""")
def q_embedding_correlation_pairs(spark, sf_dir):
    """A09 Gram path over every pair of embedding columns."""
    df = D.embedding_sensors(spark, sf_dir)
    return rounded(corr.pairwise_correlation(df, feature_columns(df)))


@register("correlation_matrix_top_variance", f"""
WITH {S.EMBEDDING_LONG},
top AS (
  SELECT f FROM long GROUP BY f HAVING var_samp(v) IS NOT NULL
  ORDER BY var_samp(v) DESC, f LIMIT {config.TOP_N_FEATURES}),
tl AS (SELECT long.* FROM long JOIN top USING (f)),
cells AS (
  SELECT a.f AS feature_1, b.f AS feature_2, corr(a.v, b.v) AS r
  FROM tl a JOIN tl b ON a.vec_id = b.vec_id GROUP BY a.f, b.f)
SELECT feature_1, feature_2, {R('r')} AS correlation FROM cells WHERE r IS NOT NULL AND NOT isnan(r)""")
def q_correlation_matrix_top_variance(spark, sf_dir):
    """A10 + L01: full correlation matrix of the 30 highest-variance columns."""
    df = D.embedding_sensors(spark, sf_dir)
    top = [r["feature_name"] for r in
           prof.top_features(prof.feature_profile(df, feature_columns(df)), "variance", config.TOP_N_FEATURES).collect()]
    return rounded(corr.correlation_matrix(df, top))


_ORDERS_FRAME = """
o AS (SELECT o_orderkey, o_orderdate AS "Time", CAST(o_orderstatus = 'F' AS INTEGER) AS Pass_Fail FROM orders)"""


def _orders_frame(spark, sf_dir):
    o = D.load_table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.col("o_orderdate").alias(config.TIME_COL),
                    (F.col("o_orderstatus") == "F").cast("int").alias(config.LABEL_COL))


@register("monthly_fail_rate", with_ctes(_ORDERS_FRAME) + f"""
SELECT strftime("Time", '%Y-%m') AS year_month, {R('avg(Pass_Fail)')} AS fail_rate,
       CAST(count(*) AS BIGINT) AS n_rows
FROM o WHERE "Time" IS NOT NULL GROUP BY 1""")
def q_monthly_fail_rate(spark, sf_dir):
    """A08 + F02: orders fail (status F) rate per month."""
    return rounded(prof.monthly_fail_rate(_orders_frame(spark, sf_dir)))


def _time_structure_sql(frame_cte: str, frame: str, order_col: str) -> str:
    return with_ctes(frame_cte, f"""
b AS (SELECT min("Time") AS t0, max("Time") AS t1, count("Time") AS nt FROM {frame})""", f"""
m AS (SELECT avg(Pass_Fail) AS r FROM {frame} WHERE "Time" IS NOT NULL GROUP BY strftime("Time", '%Y-%m'))""", f"""
lagged AS (SELECT "Time" AS t, lag("Time") OVER (ORDER BY {order_col}) AS prev FROM {frame})""") + f"""
SELECT strftime(b.t0, '%Y-%m-%d %H:%M:%S') AS first_time, strftime(b.t1, '%Y-%m-%d %H:%M:%S') AS last_time,
       CASE WHEN b.nt > 1 THEN CAST(datediff('day', b.t0, b.t1) AS DOUBLE)
            - CASE WHEN b.t1 - INTERVAL (datediff('day', b.t0, b.t1)) DAY < b.t0 THEN 1 ELSE 0 END
            ELSE 0.0 END AS time_span_days,
       (SELECT CAST(count(*) AS BIGINT) FROM m) AS n_months,
       (SELECT {R('coalesce(stddev_pop(r), 0.0)')} FROM m) AS fail_rate_std_across_months,
       (SELECT coalesce(bool_and(t IS NOT NULL AND (prev IS NULL OR t >= prev))
                        AND NOT bool_or(t IS NULL), true) FROM lagged) AS is_monotonic_time
FROM b"""


def _time_structure_df(df, order_col):
    ts = prof.time_structure(df, order_col)
    fmt = "yyyy-MM-dd HH:mm:ss"
    return rounded(ts.select(F.date_format("first_time", fmt).alias("first_time"),
                             F.date_format("last_time", fmt).alias("last_time"),
                             "time_span_days", "n_months", "fail_rate_std_across_months", "is_monotonic_time"))


@register("order_time_structure", _time_structure_sql(_ORDERS_FRAME, "o", "o_orderkey"))
def q_order_time_structure(spark, sf_dir):
    """A08 + A17 + W02 on orders in order-key order."""
    return _time_structure_df(_orders_frame(spark, sf_dir), "o_orderkey")


@register("event_time_structure", _time_structure_sql(S.EVENT_SCORES, "ev", "row_id"))
def q_event_time_structure(spark, sf_dir):
    """A08 + A17 + W02 on events in id order (monotonic)."""
    return _time_structure_df(D.event_scores(spark, sf_dir), config.ROW_ID_COL)


@register("split_assignment", with_ctes(S.EMBEDDING_ROWS, S.split_cte("emb")) + """
SELECT row_id, Pass_Fail, dataset_split FROM split""")
def q_split_assignment(spark, sf_dir):
    """Exact stratified 80/20 split of the embedding rows."""
    df = D.embedding_sensors(spark, sf_dir).select(config.ROW_ID_COL, config.LABEL_COL)
    return splits.stratified_split(df, config.ROW_ID_COL).select(config.ROW_ID_COL, config.LABEL_COL,
                                                                 "dataset_split")


@register("split_allocation", with_ctes(S.LINEITEM_SENSORS.replace("FROM lineitem", "FROM lineitem"),
                                        "x AS (SELECT Pass_Fail FROM li)") + """
, c AS (SELECT Pass_Fail, count(*) AS n_class FROM x GROUP BY Pass_Fail),
a0 AS (SELECT Pass_Fail, n_class, sum(n_class) OVER () AS n,
              CAST(ceil(0.2 * sum(n_class) OVER ()) AS BIGINT) AS nt FROM c),
a1 AS (SELECT *, ((n - nt) * n_class) // n AS base, ((n - nt) * n_class) % n AS rem FROM a0)
SELECT Pass_Fail, CAST(n_class AS BIGINT) AS n_class,
       CAST(base + CASE WHEN row_number() OVER (ORDER BY rem DESC, Pass_Fail) <= (n - nt) - sum(base) OVER ()
                        THEN 1 ELSE 0 END AS BIGINT) AS n_train,
       CAST(n_class - (base + CASE WHEN row_number() OVER (ORDER BY rem DESC, Pass_Fail)
                        <= (n - nt) - sum(base) OVER () THEN 1 ELSE 0 END) AS BIGINT) AS n_test
FROM a1""")
def q_split_allocation(spark, sf_dir):
    """R03 allocation (largest remainder) on the 60k-row lineitem frame."""
    return splits.split_allocation(D.lineitem_sensors(spark, sf_dir), config.LABEL_COL)


@register("fold_assignment", with_ctes(S.EVENT_SCORES) + f"""
, r AS (SELECT row_id, Pass_Fail,
               row_number() OVER (PARTITION BY Pass_Fail ORDER BY {S.md5_key('row_id', salt='fold')}, row_id) AS ord
        FROM ev),
c AS (SELECT Pass_Fail, count(*) AS n FROM ev GROUP BY Pass_Fail),
off AS (SELECT Pass_Fail, coalesce(sum(n) OVER (ORDER BY Pass_Fail ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               AS o FROM c)
SELECT row_id, Pass_Fail, CAST((ord - 1 + o) % {config.CV_FOLDS} AS INTEGER) AS fold
FROM r JOIN off USING (Pass_Fail)""")
def q_fold_assignment(spark, sf_dir):
    """Stratified 5-fold ids for every event."""
    df = D.event_scores(spark, sf_dir).select(config.ROW_ID_COL, config.LABEL_COL)
    return splits.stratified_folds(df, config.ROW_ID_COL)


@register("stratified_sample", with_ctes(S.EVENT_SCORES) + f"""
, c AS (SELECT Pass_Fail, count(*) AS nc, sum(count(*)) OVER () AS n FROM ev GROUP BY Pass_Fail),
q AS (SELECT Pass_Fail, CASE WHEN n > {config.SCATTER_SAMPLE_ROWS}
                             THEN round_even({float(config.SCATTER_SAMPLE_ROWS)} / n * nc, 0) ELSE nc END AS keep
      FROM c),
r AS (SELECT row_id, Pass_Fail,
             row_number() OVER (PARTITION BY Pass_Fail ORDER BY {S.md5_key('row_id', salt='sample')}, row_id) AS ord
      FROM ev)
SELECT row_id, Pass_Fail FROM r JOIN q USING (Pass_Fail) WHERE ord <= keep""")
def q_stratified_sample(spark, sf_dir):
    """Class-proportional 500-row sample of the events."""
    df = D.event_scores(spark, sf_dir).select(config.ROW_ID_COL, config.LABEL_COL)
    return splits.stratified_sample(df, config.ROW_ID_COL, config.LABEL_COL)


@register("sample_rows", with_ctes(S.EVENT_SCORES) + f"""
SELECT row_id, Pass_Fail FROM ev ORDER BY {S.md5_key('row_id', salt='rows')}, row_id
LIMIT {config.ATTRIBUTION_SAMPLE_ROWS}""")
def q_sample_rows(spark, sf_dir):
    """200-row seeded sample (the limit is the operator)."""
    df = D.event_scores(spark, sf_dir).select(config.ROW_ID_COL, config.LABEL_COL)
    return splits.sample_rows(df, config.ROW_ID_COL)


@register("permuted_column", with_ctes(S.EMBEDDING_ROWS) + f"""
, nat AS (SELECT feature_000, row_number() OVER (ORDER BY row_id) AS pos FROM emb),
shf AS (SELECT row_id, row_number() OVER (ORDER BY {S.md5_key('row_id', salt='perm0')}, row_id) AS pos FROM emb)
SELECT shf.row_id, {R('nat.feature_000')} AS feature_000 FROM shf JOIN nat USING (pos)""")
def q_permuted_column(spark, sf_dir):
    """One column permuted across all rows."""
    df = D.embedding_sensors(spark, sf_dir).select(config.ROW_ID_COL, "feature_000")
    return rounded(splits.permute_column(df, config.ROW_ID_COL, "feature_000", salt="perm0"))


@register("median_by_feature", with_ctes(S.LINEITEM_SENSORS) + ", " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature_name, {R(f'median({c})')} AS median FROM li" for c in LI
).join(["m AS (", ")"]) + " SELECT * FROM m")
def q_median_by_feature(spark, sf_dir):
    """Exact per-feature median (even counts average the middle pair)."""
    return rounded(exact_medians(D.lineitem_sensors(spark, sf_dir), LI))


CLOSE_PROBS = (0.25, 0.5, 0.5001, 0.5002, 0.75)


@register("close_quantiles_by_hour", with_ctes(S.EVENT_SCORES) + f"""
SELECT CAST(feature_002 AS BIGINT) AS hour, count(*) AS n,
       {', '.join(f"{R(f'quantile_cont(floor(feature_000), {p})')} AS q{i}" for i, p in enumerate(CLOSE_PROBS))}
FROM ev WHERE feature_000 IS NOT NULL GROUP BY 1""")
def q_close_quantiles_by_hour(spark, sf_dir):
    """A15 + A19: quantiles that lie close together, over whole numbers with many ties."""
    ev = D.event_scores(spark, sf_dir).select(F.col("feature_002").cast("bigint").alias("hour"),
                                              F.floor("feature_000").cast("double").alias("v"))
    return rounded(exact_quantiles(ev, "v", ["hour"], CLOSE_PROBS))


@register("mean_std_by_feature", with_ctes(S.EMBEDDING_LONG) + f"""
SELECT f AS feature_name, {R('avg(v)')} AS mean, {R('stddev_pop(v)')} AS std FROM long GROUP BY f""")
def q_mean_std_by_feature(spark, sf_dir):
    """Mean and population std per feature (scaler fit statistics)."""
    df = D.embedding_sensors(spark, sf_dir)
    return rounded(prof.mean_std(df, feature_columns(df)))
