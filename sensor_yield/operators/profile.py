"""Column profiling: missing ratio, variance, summaries, counts, time structure.

Everything here is a grouped aggregate whose shuffle is bounded by the number of
features (never by the number of rows): Spark's partial aggregation collapses each
task's rows into one state per feature before the exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensor_yield import config
from sensor_yield.functions.timestamps import days_between_cols, year_month
from sensor_yield.session import cut_lineage

# Above this width one wide aggregate would exceed codegen's field budget; the
# long (unpivoted) form is used instead. Both produce the same table.
WIDE_AGG_LIMIT = 48

PROFILE_SCHEMA = "feature_name string, n_rows bigint, n_present bigint, missing_ratio double, variance double"


def _stack_expr(names: Sequence[str], value_cols: Sequence[Sequence[str]], out: Sequence[str]) -> str:
    parts = []
    for i, name in enumerate(names):
        lit = name.replace("'", "\\'")
        parts.append(", ".join([f"'{lit}'"] + [f"`{v[i]}`" for v in value_cols]))
    return f"stack({len(names)}, {', '.join(parts)}) as ({', '.join(out)})"


def feature_profile(df: DataFrame, cols: Sequence[str], ddof: int = 1) -> DataFrame:
    """Per-feature ``n_rows, n_present, missing_ratio, variance`` (A01 + A02).

    ``variance`` ignores missing values; ``ddof=1`` is the sample variance (NULL
    below two values), ``ddof=0`` the population variance.
    """
    cols = list(cols)
    var_fn = F.var_samp if ddof == 1 else F.var_pop
    if len(cols) <= WIDE_AGG_LIMIT:
        aggs = [F.count(F.lit(1)).alias("__n")]
        for i, c in enumerate(cols):
            aggs.append(F.count(F.col(c)).alias(f"__c{i}"))
            aggs.append(var_fn(F.col(c).cast("double")).alias(f"__v{i}"))
        wide = df.select(*cols).agg(*aggs)
        long = wide.selectExpr(
            "__n as n_rows",
            _stack_expr(cols, [[f"__c{i}" for i in range(len(cols))],
                               [f"__v{i}" for i in range(len(cols))]],
                        ["feature_name", "n_present", "variance"]),
        )
    else:
        melted = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
            [], cols, "feature_name", "value")
        long = melted.groupBy("feature_name").agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.count("value").alias("n_present"),
            var_fn("value").alias("variance"),
        )
    return long.select(
        "feature_name",
        F.col("n_rows").cast("bigint").alias("n_rows"),
        F.col("n_present").cast("bigint").alias("n_present"),
        F.try_divide(F.col("n_rows") - F.col("n_present"), F.col("n_rows").cast("double")).alias("missing_ratio"),
        F.col("variance"),
    )


def missing_ratio(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature_name, missing_ratio`` sorted by ratio descending."""
    return (feature_profile(df, cols).select("feature_name", "missing_ratio")
            .orderBy(F.desc("missing_ratio"), "feature_name"))


def variance(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature_name, variance`` (sample, NaN-skipping) sorted ascending."""
    return (feature_profile(df, cols).select("feature_name", "variance")
            .orderBy(F.asc_nulls_last("variance"), "feature_name"))


def above_missing_threshold(c: Column, threshold: float) -> Column:
    """Strictly above."""
    return c > F.lit(threshold)


def is_low_variance(c: Column, threshold: float = config.LOW_VARIANCE_THRESHOLD) -> Column:
    """Undefined variance counts as low."""
    return c.isNull() | (c < F.lit(threshold))


def flagged_profile(df: DataFrame, cols: Sequence[str],
                    missing_threshold: float = config.MODELING_MISSING_THRESHOLD,
                    var_threshold: float = config.LOW_VARIANCE_THRESHOLD) -> DataFrame:
    """Profile with the P03 / P04 flags."""
    p = feature_profile(df, cols)
    return p.withColumn("above_missing_threshold",
                        above_missing_threshold(F.col("missing_ratio"), missing_threshold)) \
            .withColumn("low_variance", is_low_variance(F.col("variance"), var_threshold))


def low_variance_features(profile: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD) -> DataFrame:
    """P04 as a filter on a profile."""
    return profile.where(is_low_variance(F.col("variance"), threshold))


def missing_ratio_summary(profile: DataFrame) -> DataFrame:
    """describe() of the missing ratios (exact, linearly interpolated quartiles)."""
    r = F.col("missing_ratio")
    return profile.agg(
        F.count(r).cast("bigint").alias("n_features"),
        F.avg(r).alias("mean"),
        F.stddev_samp(r).alias("std"),
        F.min(r).alias("min"),
        F.percentile(r, 0.25).alias("q25"),
        F.percentile(r, 0.5).alias("median"),
        F.percentile(r, 0.75).alias("q75"),
        F.max(r).alias("max"),
    )


def missing_threshold_comparison(profile: DataFrame,
                                 thresholds: Sequence[float] = config.MISSING_RATIO_THRESHOLDS) -> DataFrame:
    """Features dropped / kept at each threshold (strict ``>``); one pass."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for i, t in enumerate(thresholds):
        aggs.append(F.count_if(F.col("missing_ratio") > F.lit(t)).alias(f"__d{i}"))
    wide = profile.agg(*aggs)
    parts = ", ".join(f"cast({t} as double), __d{i}" for i, t in enumerate(thresholds))
    return wide.selectExpr("__n", f"stack({len(thresholds)}, {parts}) as (threshold, n_dropped)") \
        .select("threshold", F.col("n_dropped").cast("bigint").alias("n_dropped"),
                (F.col("__n") - F.col("n_dropped")).cast("bigint").alias("n_kept"))


def low_variance_counts(profile: DataFrame, threshold: float = config.LOW_VARIANCE_THRESHOLD) -> DataFrame:
    """Number of low-variance vs usable features."""
    low = is_low_variance(F.col("variance"), threshold)
    return profile.agg(F.count_if(low).cast("bigint").alias("n_low_variance"),
                       F.count_if(~low).cast("bigint").alias("n_usable"))


def top_features(profile: DataFrame, metric: str, n: int = config.TOP_N_FEATURES) -> DataFrame:
    """The ``n`` features with the largest ``metric`` (TakeOrdered)."""
    return (profile.where(F.col(metric).isNotNull())
            .orderBy(F.desc(metric), F.asc("feature_name")).limit(n)
            .select("feature_name", metric))


def class_counts(df: DataFrame, label_col: str = config.LABEL_COL) -> DataFrame:
    """Total rows, pass / fail counts and fail rate in one aggregate."""
    y = F.col(label_col)
    return df.agg(
        F.count(F.lit(1)).cast("bigint").alias("n_rows"),
        F.count_if(y == 0).cast("bigint").alias("n_pass"),
        F.count_if(y == 1).cast("bigint").alias("n_fail"),
        F.avg(y.cast("double")).alias("fail_rate"),
    )


def class_ratio(df: DataFrame, label_col: str = config.LABEL_COL) -> DataFrame:
    """``n_pass / max(n_fail, 1)`` (boosting's positive-class weight)."""
    y = F.col(label_col)
    c = df.agg(F.count_if(y == 0).alias("n_pass"), F.count_if(y == 1).alias("n_fail"))
    return c.select(F.col("n_pass").cast("bigint"), F.col("n_fail").cast("bigint"),
                    (F.col("n_pass") / F.greatest(F.col("n_fail"), F.lit(1))).cast("double")
                    .alias("scale_pos_weight"))


def row_fingerprint(cols: Sequence[str]) -> list[Column]:
    """128 bits of a row as two columns: equal rows have equal ones; which values are missing counts too, as
    hashes pass over NULL."""
    missing = F.concat(F.lit(""), *[F.when(F.col(c).isNull(), F.lit("1")).otherwise(F.lit("0")) for c in cols])
    return [F.xxhash64(F.lit(i), missing, *[F.col(c) for c in cols]).alias(f"__f{i}") for i in (1, 2)]


def duplicate_rows(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first in each identical group; NULLs compare equal.

    Rows are counted by fingerprint first, so a table without duplicates shuffles 16 bytes a row. Only rows
    whose fingerprint repeats are grouped by their values, which keeps the result exact; that grouping is
    partially aggregated per task, so a group holding a third of the table travels as one row per task.
    """
    cols = list(cols)
    rows = df.select(*cols, *row_fingerprint(cols))
    keys = ["__f1", "__f2"]
    repeated = cut_lineage(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__c")).where(F.col("__c") > 1))
    n_single = df.count() - (repeated.agg(F.sum("__c")).first()[0] or 0)
    groups = rows.join(repeated.select(*keys), keys, "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.coalesce(F.sum(F.col("__c") - 1), F.lit(0)).cast("bigint").alias("n_duplicate_rows"),
                      (F.count(F.lit(1)) + F.lit(n_single)).cast("bigint").alias("n_distinct_rows"))


def monthly_fail_rate(df: DataFrame, time_col: str = config.TIME_COL,
                      label_col: str = config.LABEL_COL) -> DataFrame:
    """A08 (first half): fail rate per ``YYYY-MM`` over rows with a time."""
    return (df.where(F.col(time_col).isNotNull())
            .groupBy(year_month(F.col(time_col)).alias("year_month"))
            .agg(F.avg(F.col(label_col).cast("double")).alias("fail_rate"),
                 F.count(F.lit(1)).cast("bigint").alias("n_rows")))


def time_structure(df: DataFrame, order_col: str, time_col: str = config.TIME_COL,
                   label_col: str = config.LABEL_COL) -> DataFrame:
    """A08 + A17 + W02 as one row: first/last time, whole-day span (0 when <= 1 row
    has a time), monotonic flag in ``order_col`` order, months, population std of
    the monthly fail rate (0 when there is no month)."""
    t = F.col(time_col)
    bounds = df.agg(F.min(t).alias("first_time"), F.max(t).alias("last_time"),
                    F.count(t).alias("__nt"))
    bounds = bounds.select(
        "first_time", "last_time",
        F.when(F.col("__nt") > 1, days_between_cols("first_time", "last_time").cast("double"))
        .otherwise(F.lit(0.0)).alias("time_span_days"))
    months = monthly_fail_rate(df, time_col, label_col).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_months"),
        F.coalesce(F.stddev_pop("fail_rate"), F.lit(0.0)).alias("fail_rate_std_across_months"))
    mono = is_monotonic(df, order_col, time_col)
    # one row each: stacked, every column is set in one of them
    rows = (bounds.unionByName(months, allowMissingColumns=True).unionByName(mono, allowMissingColumns=True))
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def is_monotonic(df: DataFrame, order_col: str, value_col: str) -> DataFrame:
    """Non-decreasing ``value_col`` in ``order_col`` order; any NULL gives false.

    Rows that share a key are taken together (least and greatest value), so ties have one
    answer; keys may be of any ordered type, NULL first. Distributed form of a lag check:
    range-partition by key, let every partition report (first value, last value, internal ok)
    in one vectorised pass, then compare neighbouring partitions on that tiny table.
    """
    ordered = df.select(F.col(order_col).alias("k"), F.col(value_col).alias("v"))
    # Timestamps go through as epoch microseconds so the pandas side stays numeric.
    vt = df.schema[value_col].dataType
    if isinstance(vt, T.TimestampNTZType):
        # wall-clock microseconds, independent of the session time zone
        ordered = ordered.withColumn("v", F.expr(
            "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', v)").cast("double"))
    elif isinstance(vt, T.TimestampType):
        ordered = ordered.withColumn("v", F.unix_micros(F.col("v")).cast("double"))
    elif isinstance(vt, T.DateType):
        ordered = ordered.withColumn("v", F.unix_date(F.col("v")).cast("double"))
    else:
        ordered = ordered.withColumn("v", F.col("v").cast("double"))

    keyed = ordered.groupBy("k").agg(F.min("v").alias("lo"), F.max("v").alias("hi"),
                                     F.count_if(F.col("v").isNull()).alias("nulls"))
    keyed = keyed.repartitionByRange("k").sortWithinPartitions("k").select(
        F.spark_partition_id().alias("part"), "lo", "hi", "nulls")

    def summarise(batches):
        # Streams the partition batch by batch; only the running edge values are kept.
        part = first = last = None
        ok = True
        for b in batches:
            if b.empty:
                continue
            lo, hi = b["lo"].to_numpy(float), b["hi"].to_numpy(float)
            if part is None:
                part, first = int(b["part"].iloc[0]), lo[0]
            elif lo[0] < last:
                ok = False
            ok = ok and not (b["nulls"] > 0).any() and bool((lo[1:] >= hi[:-1]).all())
            last = hi[-1]
        if part is not None:
            yield pd.DataFrame({"part": [part], "first_v": [first], "last_v": [last], "ok": [bool(ok)]})

    parts = keyed.mapInPandas(summarise, "part int, first_v double, last_v double, ok boolean")
    before = F.lag("last_v").over(Window.orderBy("part"))  # one row per partition
    checked = parts.withColumn("edge_ok", before.isNull() | F.isnan(before) | (F.col("first_v") >= before))
    return checked.agg(F.coalesce(F.bool_and(F.col("ok") & F.col("edge_ok")), F.lit(True)).alias("is_monotonic_time"))


def mean_std(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``feature_name, mean, std`` (population) of each column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "feature_name", "v")
    return long.groupBy("feature_name").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def column_stats(df: DataFrame, cols: Sequence[str], stats: dict[str, str]) -> dict[str, dict[str, float | None]]:
    """Per-column statistics collected to the driver (bounded by columns x stats).

    ``stats`` maps an output name to an aggregate function name of
    ``pyspark.sql.functions`` (``avg``, ``stddev_pop``, ``min``, ``var_samp``...).
    Narrow tables use one wide aggregate; wide ones go long (``unpivot`` +
    ``groupBy(feature)``) so the aggregate stays within codegen's field budget.
    """
    cols = list(cols)
    if not cols:
        return {}
    if len(cols) <= WIDE_AGG_LIMIT:
        aggs = [getattr(F, fn)(F.col(c).cast("double")).alias(f"{k}__{i}")
                for i, c in enumerate(cols) for k, fn in stats.items()]
        row = df.agg(*aggs).first()
        return {c: {k: row[f"{k}__{i}"] for k in stats} for i, c in enumerate(cols)}
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "feature_name", "v")
    rows = long.groupBy("feature_name").agg(*[getattr(F, fn)("v").alias(k) for k, fn in stats.items()]).collect()
    out = {r["feature_name"]: {k: r[k] for k in stats} for r in rows}
    return {c: out.get(c, {k: None for k in stats}) for c in cols}
