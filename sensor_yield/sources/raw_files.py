"""Raw sensor file layouts.

Two layouts normalise to one table ``row_id, Time, Pass_Fail_Raw, Pass_Fail,
Pass_Fail_Label, feature_000..``:

* combined CSV: header row, ``Time``, one column per sensor, a Pass/Fail label;
* two files: a headerless whitespace-separated matrix (``NaN`` = missing) and a
  label file of ``<label><ws><timestamp>`` lines, aligned by position.

Directory listing and header peeks run on the driver through Hadoop's
``FileSystem`` (works for any cluster file system); every row-level step is a
Spark scan. File order becomes ``row_id`` through one count per split, in order of
(file name, split start), and the place inside the split; no row is sorted or moved.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.columns import generate_feature_names, normalise_name
from sensor_yield.functions.labels import convert_labels
from sensor_yield.functions.timestamps import parse_time_column
from sensor_yield.session import settled

NORMALISED_ORDER = [config.ROW_ID_COL, config.TIME_COL, config.LABEL_RAW_COL, config.LABEL_COL,
                    config.LABEL_TEXT_COL]


# ---------------------------------------------------------------------------
# listing (driver, Hadoop FileSystem)
# ---------------------------------------------------------------------------
def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs_and_path(spark, path)
    return bool(fs.exists(p))


def list_files(spark: SparkSession, directory: str) -> list[str]:
    """File names (not paths) directly under ``directory``, sorted."""
    fs, p = _fs_and_path(spark, directory)
    if not fs.exists(p):
        return []
    return sorted(str(s.getPath().getName()) for s in fs.listStatus(p) if s.isFile())


def _join(directory: str, name: str) -> str:
    return directory.rstrip("/") + "/" + name


# ---------------------------------------------------------------------------
# discovery
# ---------------------------------------------------------------------------
def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV file (reads the first line only)."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path).columns


class Header(NamedTuple):
    """The roles of a CSV's columns: time and label (None if absent), sensors in file order."""

    time: str | None
    label: str | None
    sensors: list[str]


def classify_header(columns: Sequence[str]) -> Header:
    """Roles by normalised name; index columns without a name of their own have no role."""
    role: dict[str, list[str]] = {"time": [], "label": [], "sensor": []}
    for column in columns:
        name = normalise_name(column)
        if re.match(r"unnamed|_c\d+$", name):
            continue
        kind = "time" if name == "time" else "label" if name in config.LABEL_NAME_CANDIDATES else "sensor"
        # only the first column of a role has it; a second one is a sensor
        role[kind if kind == "sensor" or not role[kind] else "sensor"].append(column)
    return Header(next(iter(role["time"]), None), next(iter(role["label"]), None), role["sensor"])


def find_combined_csv(spark: SparkSession, raw_dir: str) -> str | None:
    """A known file name if there is one; else the first CSV by name whose header has a label."""
    present = list_files(spark, raw_dir) if path_exists(spark, raw_dir) else []
    known = [n for n in config.COMBINED_CSV_CANDIDATES if n in present]
    if known:
        return _join(raw_dir, known[0])

    def has_label(name: str) -> bool:
        try:
            return classify_header(csv_header(spark, _join(raw_dir, name))).label is not None
        except Exception:  # noqa: BLE001 - a file that cannot be read as CSV is no candidate
            return False

    return next((_join(raw_dir, n) for n in present if n.lower().endswith(".csv") and has_label(n)), None)


def find_raw_files(spark: SparkSession, raw_dir: str) -> dict[str, str]:
    """The two files of the two-file layout: by known name, else the first data file (by name)
    that has, or has not, 'label' in its name."""
    if not path_exists(spark, raw_dir):
        raise FileNotFoundError(f"no such folder of raw data: {raw_dir}")
    present = list_files(spark, raw_dir)
    data = [n for n in present if n.lower().rpartition(".")[2] in ("data", "csv", "txt")]
    choices = {
        "features": [*(n for n in config.FEATURES_FILE_CANDIDATES if n in present),
                     *(n for n in data if "label" not in n.lower())],
        "labels": [*(n for n in config.LABELS_FILE_CANDIDATES if n in present),
                   *(n for n in data if "label" in n.lower())],
    }
    lacking = [kind for kind, names in choices.items() if not names]
    if lacking:
        raise FileNotFoundError(f"{raw_dir} has no file of {' and '.join(lacking)}; usual names are "
                                f"{config.FEATURES_FILE_CANDIDATES[0]} and {config.LABELS_FILE_CANDIDATES[0]}")
    return {kind: _join(raw_dir, names[0]) for kind, names in choices.items()}


# ---------------------------------------------------------------------------
# file-order row ids
# ---------------------------------------------------------------------------
def with_file_order(df: DataFrame, out_col: str = config.ROW_ID_COL) -> DataFrame:
    """0-based ``row_id`` in file order: rows of all earlier splits, by (file name, split start),
    plus the place inside the split. One count per split; rows are neither sorted nor moved."""
    keyed = df.select("*", F.input_file_name().alias("__file"), F.input_file_block_start().alias("__blk"),
                      F.monotonically_increasing_id().alias("__mono"))
    splits = keyed.groupBy("__file", "__blk").agg(F.count(F.lit(1)).alias("__n"), F.min("__mono").alias("__first"))
    order = Window.orderBy("__file", "__blk").rowsBetween(Window.unboundedPreceding, -1)  # one row per split
    offsets = splits.withColumn("__off", F.coalesce(F.sum("__n").over(order), F.lit(0))).drop("__n")
    return (keyed.join(settled(offsets), ["__file", "__blk"])
            .withColumn(out_col, F.col("__off") + F.col("__mono") - F.col("__first"))
            .drop("__file", "__blk", "__mono", "__first", "__off"))


def _num(c: Column) -> Column:
    """numeric coercion; invalid text and NaN become NULL."""
    d = F.trim(c.cast("string")).try_cast("double")
    return F.nanvl(d, F.lit(None).cast("double"))


def _strict_int(c: Column, what: str) -> Column:
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(v.isNotNull() & (v == F.floor(v)), v.cast("int")).otherwise(
        F.raise_error(F.concat(F.lit(f"Invalid {what}: "), F.coalesce(c.cast("string"), F.lit("NULL")))))


# ---------------------------------------------------------------------------
# scans (S03-S06)
# ---------------------------------------------------------------------------
def load_combined_csv(spark: SparkSession, path: str) -> DataFrame:
    """Combined CSV -> normalised table."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    time_col, label_col, sensor_cols = classify_header(raw.columns)
    if label_col is None:
        raise ValueError(f"{path}: none of its columns is a label (names looked for: "
                         f"{', '.join(config.LABEL_NAME_CANDIDATES)})")
    names = generate_feature_names(len(sensor_cols))
    df = raw.select(
        (F.col(f"`{time_col}`").cast("string") if time_col else F.lit(None).cast("string")).alias(config.TIME_COL),
        _strict_int(F.col(f"`{label_col}`"), "label").alias(config.LABEL_RAW_COL),
        *[_num(F.col(f"`{c}`")).alias(n) for c, n in zip(sensor_cols, names)],
    )
    df = with_file_order(df)
    df = parse_time_column(df, config.TIME_COL) if time_col else \
        df.withColumn(config.TIME_COL, F.lit(None).cast("timestamp_ntz"))
    df = convert_labels(df)
    return df.select(*NORMALISED_ORDER, *names)


def parse_feature_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """S05 on a DataFrame of lines (other columns stay): blank lines skipped; ``NaN`` / ``nan``
    and non-numeric tokens are missing; the width is the widest row."""
    kept = [c for c in lines.columns if c != value_col]
    tokens = lines.where(F.trim(F.col(value_col)) != "").select(
        *kept, F.split(F.trim(F.col(value_col)), r"\s+").alias("__t"))
    width = tokens.agg(F.max(F.size("__t")).alias("w")).first()["w"] or 0
    names = generate_feature_names(width)
    return tokens.select(*kept, *[_num(F.get(F.col("__t"), i)).alias(n) for i, n in enumerate(names)])


def parse_label_lines(lines: DataFrame, value_col: str = "value") -> DataFrame:
    """S06 on a DataFrame of lines (other columns stay): label and the rest of the line, split
    on the first white space; blank lines skipped; a missing timestamp is NULL; the time
    column is parsed with the whole-column format rule (F01)."""
    kept = [c for c in lines.columns if c != value_col]
    pat = r"^\s*(\S+)\s*(.*?)\s*$"
    df = lines.where(F.trim(F.col(value_col)) != "").select(
        *kept, _strict_int(F.regexp_extract(value_col, pat, 1), "label").alias(config.LABEL_RAW_COL),
        F.nullif(F.regexp_extract(value_col, pat, 2), F.lit("")).alias(config.TIME_COL))
    return parse_time_column(df, config.TIME_COL)


def load_features(spark: SparkSession, path: str) -> DataFrame:
    """Headerless whitespace matrix: the sensors, then ``row_id`` in file order."""
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "")
    rows = parse_feature_lines(with_file_order(lines))
    return rows.select(*[c for c in rows.columns if c != config.ROW_ID_COL], config.ROW_ID_COL)


def load_labels(spark: SparkSession, path: str) -> DataFrame:
    """``<label><ws><timestamp>`` lines, in file order."""
    lines = spark.read.text(path).where(F.trim(F.col("value")) != "")
    return parse_label_lines(with_file_order(lines))


def load_two_file_layout(spark: SparkSession, features_path: str, labels_path: str) -> DataFrame:
    """S04 + J01: both files scanned, row counts checked, joined by position."""
    feats = load_features(spark, features_path)
    labs = load_labels(spark, labels_path)
    n_f, n_l = feats.count(), labs.count()
    if n_f != n_l:
        raise ValueError(f"files are matched by place and must be equally long. Row count mismatch: {n_f} in {features_path}, "
                         f"{n_l} in {labels_path}")
    merged = labs.join(feats, config.ROW_ID_COL, "inner")
    merged = convert_labels(merged)
    names = [c for c in feats.columns if c.startswith(config.FEATURE_PREFIX)]
    return merged.select(*NORMALISED_ORDER, *names)


def load_raw(spark: SparkSession, raw_dir: str) -> DataFrame:
    """Combined CSV when one is found, else the two-file layout."""
    combined = find_combined_csv(spark, raw_dir)
    if combined is not None:
        return load_combined_csv(spark, combined)
    paths = find_raw_files(spark, raw_dir)
    return load_two_file_layout(spark, paths["features"], paths["labels"])
