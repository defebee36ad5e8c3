"""Exact stratified split, stratified folds, samples and permutations.

All randomness comes from md5 keys of ``seed:id`` (see ``functions.keys``), so the
assignments are independent of partitioning and reproducible in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.functions.keys import random_key
from sensor_yield.operators.ordering import key_rank, ordinal_within_group
from sensor_yield.session import settled


def split_allocation(df: DataFrame, label_col: str, test_size: float = config.TEST_SIZE) -> DataFrame:
    """Per-class ``n_class, n_train, n_test`` for an exact stratified split.

    Total test rows = ceil(test_size * n). The train share of each class is
    ``floor(n_train * n_c / n)`` plus one for the classes with the largest integer
    remainders until ``n_train`` is reached (ties: smaller class value first); test
    takes the rest of each class. Works on the class-count table only (one row
    per class), so the windows below are tiny.
    """
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_class"))
    w_all = Window.partitionBy()
    # n_train * n_class can pass 2^63 on very large tables: exact DECIMAL(38, 0)
    # arithmetic, remainder first, then an exact division.
    dec = "decimal(38,0)"
    prod = F.col("__n_train").cast(dec) * F.col("n_class").cast(dec)
    alloc = (counts
             .withColumn("__n", F.sum("n_class").over(w_all))
             .withColumn("__n_test", F.ceil(F.lit(test_size) * F.col("__n")).cast("bigint"))
             .withColumn("__n_train", F.col("__n") - F.col("__n_test"))
             .withColumn("__rem", F.pmod(prod, F.col("__n").cast(dec)))
             .withColumn("__base", ((prod - F.col("__rem")) / F.col("__n").cast(dec)).cast("bigint"))
             .withColumn("__short", F.col("__n_train") - F.sum("__base").over(w_all))
             .withColumn("__rk", F.row_number().over(Window.orderBy(F.desc("__rem"), F.asc(label_col)))))
    return alloc.select(
        label_col, F.col("n_class").cast("bigint"),
        (F.col("__base") + (F.col("__rk") <= F.col("__short")).cast("bigint")).alias("n_train"),
    ).withColumn("n_test", F.col("n_class") - F.col("n_train"))


def _labelled(df: DataFrame, label_col: str) -> DataFrame:
    """The rows, with a NULL label raising when met: no class, no stratum."""
    kind = df.schema[label_col].dataType
    missing = F.raise_error(F.lit(f"NULL in {label_col}: rows need a class to be stratified")).cast(kind)
    return df.withColumn(label_col, F.coalesce(F.col(label_col), missing))


def key_cuts(keyed: DataFrame, quota: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """Per class the (key, id) of its ``quota``-th row in key order; classes without quota are
    absent. ``keyed`` has the label, ``__key`` (md5 hex) and the id; ``quota`` the label and
    ``__quota``. Counts per key prefix find the bucket that holds the row; only that bucket, a
    65,536th of a class, is ordered. No other column is read."""
    narrow = keyed.select(F.col(label_col).alias("__l"), F.substring("__key", 1, 4).alias("__p"), "__key",
                          F.col(id_col).alias("__id"))
    before = Window.partitionBy("__l").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    hist = narrow.groupBy("__l", "__p").agg(F.count(F.lit(1)).alias("__n")).withColumn(
        "__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    edge = (hist.join(quota.select(F.col(label_col).alias("__l"), "__quota"), "__l")
            .where("__before < __quota AND __quota <= __before + __n")
            .select("__l", "__p", (F.col("__quota") - F.col("__before")).alias("__need")))
    order = Window.partitionBy("__l").orderBy("__key", "__id")
    cuts = (narrow.join(edge, ["__l", "__p"]).withColumn("__rn", F.row_number().over(order))
            .where("__rn = __need").select(F.col("__l").alias(label_col), F.col("__key").alias("__cut_key"),
                                           F.col("__id").alias("__cut_id")))
    return settled(cuts)


def _up_to_cut(df: DataFrame, salt: str | None, quota: DataFrame, id_col: str, label_col: str, seed: int) -> DataFrame:
    """Adds ``__in``: the row is among its class's first ``__quota`` rows in key order. A filter
    on each row by its own key: rows do not move."""
    keyed = _labelled(df, label_col).withColumn("__key", random_key(id_col, seed, salt=salt))
    cuts = key_cuts(keyed, quota, label_col, id_col)
    inside = (F.col("__key") < F.col("__cut_key")) | (
        (F.col("__key") == F.col("__cut_key")) & (F.col(id_col) <= F.col("__cut_id")))
    return (keyed.join(cuts, label_col, "left").withColumn("__in", F.coalesce(inside, F.lit(False)))
            .select(*df.columns, "__in"))


def stratified_split(df: DataFrame, id_col: str, label_col: str = config.LABEL_COL,
                     test_size: float = config.TEST_SIZE, seed: int = config.SEED,
                     out_col: str = "dataset_split") -> DataFrame:
    """Add ``dataset_split`` ('train'/'test'): inside each class the rows with the
    smallest md5 keys go to test, exactly ``n_test`` of them (R03). A NULL label raises."""
    quota = split_allocation(df, label_col, test_size).select(label_col, F.col("n_test").alias("__quota"))
    out = _up_to_cut(df, None, quota, id_col, label_col, seed)
    return out.withColumn(out_col, F.when(F.col("__in"), F.lit("test")).otherwise(F.lit("train"))).drop("__in")


def stratified_folds(df: DataFrame, id_col: str, label_col: str = config.LABEL_COL,
                     k: int = config.CV_FOLDS, seed: int = config.SEED, out_col: str = "fold") -> DataFrame:
    """Add an integer ``fold`` in ``[0, k)`` (R04). A NULL label raises.

    Rows of each class are dealt round-robin in md5-key order; each class starts
    where the previous class (by label value) stopped, so fold sizes differ by at
    most one overall and per class.
    """
    keyed = _labelled(df, label_col).withColumn("__key", random_key(id_col, seed, salt="fold"))
    ranked = key_rank(keyed, [label_col], "__key", id_col, "__ord")
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__c"))
    offsets = counts.withColumn(
        "__off", F.coalesce(F.sum("__c").over(Window.orderBy(label_col).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))).select(label_col, "__off")
    out = ranked.join(settled(offsets), label_col, "inner")
    return out.withColumn(out_col, F.pmod(F.col("__ord") - 1 + F.col("__off"), F.lit(k)).cast("int")) \
        .select(*df.columns, out_col)


def stratified_sample(df: DataFrame, id_col: str, label_col: str, max_rows: int = config.SCATTER_SAMPLE_ROWS,
                      seed: int = config.SEED) -> DataFrame:
    """When there are more than ``max_rows`` rows keep, per class, the
    ``round_half_even(max_rows / n * n_class)`` rows with the smallest md5 keys;
    otherwise keep everything. Class column is kept; a NULL label raises."""
    counts = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("__nc"))
    quota = counts.withColumn("__n", F.sum("__nc").over(Window.partitionBy())).withColumn(  # per-class rows
        "__quota", F.when(F.col("__n") > max_rows,
                          F.bround(F.lit(float(max_rows)) / F.col("__n") * F.col("__nc"), 0))
        .otherwise(F.col("__nc")).cast("bigint")).select(label_col, "__quota")
    return _up_to_cut(df, "sample", quota, id_col, label_col, seed).where("__in").drop("__in")


def sample_rows(df: DataFrame, id_col: str, n: int = config.ATTRIBUTION_SAMPLE_ROWS,
                seed: int = config.SEED) -> DataFrame:
    """``min(n, rows)`` rows with the smallest md5 keys (a sampling operator:
    the limit is the feature; TakeOrdered keeps n rows per task)."""
    return (df.withColumn("__key", random_key(id_col, seed, salt="rows"))
            .orderBy("__key", id_col).limit(n).drop("__key"))


def permute_column(df: DataFrame, id_col: str, col: str, salt: str, seed: int = config.SEED) -> DataFrame:
    """``col`` shuffled across rows: the value at natural position i (by id)
    moves to the row whose md5 rank is i. Ids, keys and the one column are ranked; whole rows
    only meet their new value, by id."""
    narrow = df.select(id_col, F.col(col).alias("__value"))
    natural = ordinal_within_group(narrow, [], [id_col], out_col="__rank").select("__rank", "__value")
    keyed = df.select(id_col, random_key(id_col, seed, salt=salt).alias("__key"))
    shuffled = ordinal_within_group(keyed, [], ["__key", id_col], out_col="__rank").select(id_col, "__rank")
    moved = shuffled.join(natural, "__rank").select(id_col, F.col("__value").alias(col))
    return df.drop(col).join(moved, id_col)
