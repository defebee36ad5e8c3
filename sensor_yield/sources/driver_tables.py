"""Driver parquet tables and the sensor-style frames derived from them.

Each derived frame has the shape the pipeline works on -- an id, an optional
time, a 0/1 ``Pass_Fail`` label and ``feature_XXX`` DOUBLE columns -- and is a
projection of a scan, so filters and column pruning reach the parquet reader.
The SQL in ``plans.catalog`` builds the same frames for the DuckDB oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.labels import label_text

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def load_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _with_label_text(df: DataFrame) -> DataFrame:
    return df.withColumn(config.LABEL_TEXT_COL, label_text(F.col(config.LABEL_COL)))


def lineitem_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a sensor table: four numerics (price in thousands), a constant, a near-copy
    (collinear), a column nulled for returned lines and a mostly-missing column.
    Fail = returned line (``l_returnflag = 'R'``); time = ship date."""
    li = load_table(spark, sf_dir, "lineitem")
    # extended price in thousands keeps every statistic of this frame O(1e3) or less
    q, p, d, t = (F.col("l_quantity"), F.col("l_extendedprice") / 1000.0, F.col("l_discount"), F.col("l_tax"))
    returned = F.col("l_returnflag") == "R"
    return _with_label_text(li.select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.col("l_shipdate").alias(config.TIME_COL),
        returned.cast("int").alias(config.LABEL_COL),
        q.alias("feature_000"), p.alias("feature_001"), d.alias("feature_002"), t.alias("feature_003"),
        F.lit(5.0).alias("feature_004"),
        (q * 2.0 + t).alias("feature_005"),
        F.when(returned, F.lit(None).cast("double")).otherwise(p).alias("feature_006"),
        F.when(F.col("l_linenumber") > 1, F.lit(None).cast("double")).otherwise(d).alias("feature_007"),
    ))


LINEITEM_FEATURES = [f"feature_{i:03d}" for i in range(8)]


def document_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` left join ``labels``: length plus the two label columns, which
    are missing for unlabelled documents, and so is the class. Fail = toxic."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    labels = load_table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    j = docs.join(labels, "doc_id", "left")
    return _with_label_text(j.select(
        F.col("doc_id").alias(config.ROW_ID_COL),
        F.col("toxic").cast("int").alias(config.LABEL_COL),
        F.col("n_chars").cast("double").alias("feature_000"),
        F.col("quality").cast("double").alias("feature_001"),
        F.col("toxic").cast("double").alias("feature_002"),
    ))


DOCUMENT_FEATURES = ["feature_000", "feature_001", "feature_002"]


def embedding_dim(spark: SparkSession, sf_dir: str) -> int:
    """Vector width over the whole table; vectors of several widths are an error."""
    widths = load_table(spark, sf_dir, "embeddings").agg(
        F.min(F.size("embedding")).alias("least"), F.max(F.size("embedding")).alias("most")).first()
    if widths["least"] != widths["most"]:
        raise ValueError(f"embeddings have between {widths['least']} and {widths['most']} values")
    return int(widths["most"] or 0)


def embedding_sensors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``embeddings`` unpacked into ``feature_000..`` columns, all values of each; Fail = class 0."""
    dim = embedding_dim(spark, sf_dir)
    e = load_table(spark, sf_dir, "embeddings")
    width = max(config.FEATURE_NAME_DIGITS, len(str(max(dim - 1, 0))))
    feats = [F.col("embedding").getItem(i).cast("double").alias(f"{config.FEATURE_PREFIX}{i:0{width}d}")
             for i in range(dim)]
    return _with_label_text(e.select(
        F.col("vec_id").alias(config.ROW_ID_COL),
        (F.col("label") == 0).cast("int").alias(config.LABEL_COL),
        *feats,
    ))


def event_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a scored sensor set: Fail = ``event_type = 'error'``; the
    stand-in model probability ``floor(value) / (floor(value) + 50)`` has many ties.

    Features: value, user id, hour, value missing for views, user id missing for
    views / clicks / signups (about 60 % missing) and a constant."""
    ev = load_table(spark, sf_dir, "events")
    fv = F.floor(F.col("value")).cast("double")
    et = F.col("event_type")
    return _with_label_text(ev.select(
        F.col("event_id").alias(config.ROW_ID_COL),
        F.col("ts").alias(config.TIME_COL),
        (et == "error").cast("int").alias(config.LABEL_COL),
        (fv / (fv + 50.0)).alias("fail_probability"),
        F.col("value").alias("feature_000"),
        F.col("user_id").cast("double").alias("feature_001"),
        F.hour(F.col("ts")).cast("double").alias("feature_002"),
        F.when(et == "view", F.lit(None).cast("double")).otherwise(F.col("value")).alias("feature_003"),
        F.when(et.isin("view", "click", "signup"), F.lit(None).cast("double"))
        .otherwise(F.col("user_id").cast("double")).alias("feature_004"),
        F.lit(1.0).alias("feature_005"),
    ))


EVENT_FEATURES = [f"feature_{i:03d}" for i in range(6)]
EVENT_MODEL_NAME = "ValueRatioScore"
