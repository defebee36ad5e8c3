"""Label recode and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensor_yield import config


def label_text(binary: Column) -> Column:
    """0/1 to Pass/Fail text."""
    return F.when(binary == 1, F.lit(config.FAIL_TEXT)).when(binary == 0, F.lit(config.PASS_TEXT))


def unexpected_raw_labels(df: DataFrame, raw_col: str = config.LABEL_RAW_COL) -> DataFrame:
    """Distinct observed raw labels minus the allowed set (A18 + U02).

    A distinct aggregate: each task pre-aggregates, so the shuffle carries at most
    (#tasks x #distinct labels) rows however large the table is.
    """
    allowed = [config.RAW_LABEL_PASS, config.RAW_LABEL_FAIL]
    return (df.select(F.col(raw_col).alias("raw_label")).distinct()
            .where(F.col("raw_label").isNull() | ~F.col("raw_label").isin(allowed)))


def convert_labels(df: DataFrame, raw_col: str = config.LABEL_RAW_COL, validate: bool = True) -> DataFrame:
    """Add ``Pass_Fail`` (1 = Fail) and ``Pass_Fail_Label``; input is not mutated.

    With ``validate`` an eager distinct check raises ``ValueError`` on values other
    than -1/1 (one small job); the in-plan ``raise_error`` guards any later action too.
    """
    if validate:
        bad = [r["raw_label"] for r in unexpected_raw_labels(df, raw_col).limit(20).collect()]
        if bad:
            raise ValueError(f"column {raw_col} holds {sorted(bad, key=str)}; a raw label is "
                             f"{config.RAW_LABEL_PASS} for a pass or {config.RAW_LABEL_FAIL} for a fail")
    raw = F.col(raw_col)
    checked = F.when(raw.isin(config.RAW_LABEL_PASS, config.RAW_LABEL_FAIL), raw).otherwise(
        F.raise_error(F.concat(F.lit("not a raw label: "), raw.cast("string"))))
    binary = (checked == F.lit(config.RAW_LABEL_FAIL)).cast("int")
    return df.withColumn(config.LABEL_COL, binary).withColumn(
        config.LABEL_TEXT_COL, label_text(F.col(config.LABEL_COL)))
