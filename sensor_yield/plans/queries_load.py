"""Load-path queries (S04-S06, J01, P02, F01, F04-F07, F11, T02): the raw-line parsers on text built from
the driver tables, with missing, malformed and blank entries planted by rule."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.columns import feature_columns
from sensor_yield.functions.labels import convert_labels
from sensor_yield.operators.transforms import VarianceFilter
from sensor_yield.plans import frames_sql as S
from sensor_yield.plans.catalog import R, register, rounded, with_ctes
from sensor_yield.sources import driver_tables as D
from sensor_yield.sources.raw_files import parse_feature_lines, parse_label_lines


def feature_lines(spark, sf_dir):
    """One line of text per vector: every 7th token (by id and position) is NaN, every 11th is no
    number; two blanks and a tab part the tokens."""
    e = D.load_table(spark, sf_dir, "embeddings")
    token = F.transform("embedding", lambda x, i: F.when((F.col("vec_id") + i) % 7 == 0, "NaN")
                        .when((F.col("vec_id") + i) % 11 == 0, "bad").otherwise(x.cast("double").cast("string")))
    return e.select(F.col("vec_id").alias(config.ROW_ID_COL), F.concat_ws("  \t", token).alias("value"))


@register("parsed_feature_lines", with_ctes(S.EMBEDDING_LONG) + f"""
SELECT vec_id AS row_id, f AS feature_name,
       CASE WHEN (vec_id + k - 1) % 7 = 0 OR (vec_id + k - 1) % 11 = 0 THEN NULL ELSE {R('v')} END AS value
FROM long""")
def q_parsed_feature_lines(spark, sf_dir):
    """S05 + F04 + F06 + F07: lines of numbers to columns; NaN and malformed tokens missing."""
    df = parse_feature_lines(feature_lines(spark, sf_dir))
    cols = feature_columns(df)
    return rounded(df.unpivot([config.ROW_ID_COL], cols, "feature_name", "value"))


def label_lines(spark, sf_dir, fmt: str):
    """One label line per event: label, blanks, time in ``fmt``; every 25th line has no time and
    every 31st one that is no time; a blank line per 10 events besides."""
    ev = D.load_table(spark, sf_dir, "events")
    time = (F.when(F.col("event_id") % 25 == 0, "").when(F.col("event_id") % 31 == 0, "no time")
            .otherwise(F.date_format("ts", fmt)))
    label = F.when(F.col("event_type") == "error", str(config.RAW_LABEL_FAIL)).otherwise(str(config.RAW_LABEL_PASS))
    lines = ev.select(F.col("event_id").alias(config.ROW_ID_COL), F.concat(F.lit(" "), label, F.lit("   "), time).alias("value"))
    return lines.unionByName(ev.where("event_id % 10 = 0").select(F.col("event_id").alias(config.ROW_ID_COL),
                                                                  F.lit("   ").alias("value")))


_LABEL_SQL = """
SELECT event_id AS row_id, CASE WHEN event_id % 25 = 0 OR event_id % 31 = 0 THEN NULL
                                ELSE date_trunc('second', ts) END AS "Time",
       CAST(CASE WHEN event_type = 'error' THEN 1 ELSE -1 END AS INTEGER) AS Pass_Fail_Raw,
       CAST(event_type = 'error' AS INTEGER) AS Pass_Fail,
       CASE WHEN event_type = 'error' THEN 'Fail' ELSE 'Pass' END AS Pass_Fail_Label
FROM events"""
_ORDER = [config.ROW_ID_COL, config.TIME_COL, config.LABEL_RAW_COL, config.LABEL_COL, config.LABEL_TEXT_COL]


@register("parsed_label_lines", _LABEL_SQL)
def q_parsed_label_lines(spark, sf_dir):
    """S06 + P02 + F01 + F05: label lines with day-first times; what is no time is missing."""
    return convert_labels(parse_label_lines(label_lines(spark, sf_dir, "dd/MM/yyyy HH:mm:ss"))).select(*_ORDER)


@register("parsed_label_lines_iso", _LABEL_SQL)
def q_parsed_label_lines_iso(spark, sf_dir):
    """the same with the second known format; the column's own format is found."""
    return convert_labels(parse_label_lines(label_lines(spark, sf_dir, "yyyy-MM-dd HH:mm:ss"))).select(*_ORDER)


#: Layouts besides the known ones; the first says only by its values that the month comes first.
LAYOUTS = {"month_first": "MM/dd/yyyy HH:mm:ss", "dotted": "d.M.yyyy H:mm:ss", "named": "dd MMM yyyy hh:mm:ss a"}


@register("inferred_time_layouts", " UNION ALL ".join(f"""
SELECT '{name}' AS layout, event_id AS row_id, CASE WHEN event_id % 25 = 0 OR event_id % 31 = 0 THEN NULL
       ELSE date_trunc('second', ts) END AS "Time" FROM events""" for name in LAYOUTS))
def q_inferred_time_layouts(spark, sf_dir):
    """times in three layouts that no known format reads; one format is learned for each column."""
    out = None
    for name, fmt in LAYOUTS.items():
        times = parse_label_lines(label_lines(spark, sf_dir, fmt)).select(F.lit(name).alias("layout"), config.ROW_ID_COL, config.TIME_COL)
        out = times if out is None else out.unionByName(times)
    return out


@register("joined_raw_layout", with_ctes(S.EMBEDDING_LONG) + f"""
SELECT vec_id AS row_id, CAST(CASE WHEN vec_id % 4 = 0 THEN 1 ELSE -1 END AS INTEGER) AS Pass_Fail_Raw,
       CASE WHEN vec_id % 4 = 0 THEN 'Fail' ELSE 'Pass' END AS Pass_Fail_Label, count(v) AS n_present, {R('sum(v)')} AS total
FROM (SELECT vec_id, CASE WHEN (vec_id + k - 1) % 7 = 0 OR (vec_id + k - 1) % 11 = 0 THEN NULL ELSE v END AS v FROM long)
GROUP BY vec_id""")
def q_joined_raw_layout(spark, sf_dir):
    """S04 + J01 + F11: the two line files of one layout matched by row id."""
    feats = parse_feature_lines(feature_lines(spark, sf_dir))
    e = D.load_table(spark, sf_dir, "embeddings")
    labs = parse_label_lines(e.select(F.col("vec_id").alias(config.ROW_ID_COL), F.concat(
        F.when(F.col("vec_id") % 4 == 0, "1").otherwise("-1"), F.lit(" 01/02/2008 03:04:05")).alias("value")))
    cols = feature_columns(feats)
    long = convert_labels(labs).join(feats, config.ROW_ID_COL).unpivot(
        [config.ROW_ID_COL, config.LABEL_RAW_COL, config.LABEL_TEXT_COL], cols, "f", "v")
    return rounded(long.groupBy(config.ROW_ID_COL, config.LABEL_RAW_COL, config.LABEL_TEXT_COL).agg(
        F.count("v").alias("n_present"), F.sum("v").alias("total")))


@register("inclusive_variance_filter", with_ctes(S.LINEITEM_SENSORS) + """
, s AS (""" + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, var_samp({c}) AS v FROM li" for c in D.LINEITEM_FEATURES) + """)
SELECT feature_name FROM s WHERE v >= 0.01""")
def q_inclusive_variance_filter(spark, sf_dir):
    """The sample-variance filter in its inclusive form, on the lineitem sensors."""
    df = D.lineitem_sensors(spark, sf_dir).select(*D.LINEITEM_FEATURES)
    model = Pipeline(stages=[VarianceFilter(threshold=0.01, ddof=1, inclusive=True)]).fit(df)
    return spark.createDataFrame([(c,) for c in model.stages[0].get_feature_names_out()], "feature_name string")
