"""Distributed ordinals and prefix sums.

A window with an ``ORDER BY`` but a small or missing ``PARTITION BY`` (row number
inside a class, running totals over a score order) makes Spark move a whole class
into one task. These helpers compute the same results with the classic two-level
scheme instead:

1. range-partition on ``(group, order)`` and sort inside partitions (one shuffle,
   balanced by sampled range bounds, partition count left to AQE);
2. number the rows inside each partition (``monotonically_increasing_id`` keeps
   the in-partition position) and persist that staged table with a reliable
   checkpoint, so positions are stable even if an executor is lost and the
   stage recomputes;
3. aggregate one row per ``(partition, group)`` -- a table bounded by
   partitions x groups -- and turn it into offsets with a tiny window;
4. join the offsets back (AQE broadcasts them at runtime when small).

Ordering keys must make rows unique (add the id column as the last key); then
the result equals ``row_number() OVER (PARTITION BY group ORDER BY order)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield.session import cut_lineage


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def _stage(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
           n_parts: int | None) -> DataFrame:
    keys = _as_cols(group_cols) + _as_cols(order_cols)
    # without a count AQE sizes the range partitions, so they follow the data
    parted = df.repartitionByRange(n_parts, *keys) if n_parts else df.repartitionByRange(*keys)
    staged = (parted
              .sortWithinPartitions(*keys)
              .withColumn("__sy_pid", F.spark_partition_id())
              .withColumn("__sy_pos", F.monotonically_increasing_id()))
    return cut_lineage(staged)


def _with_blocks(rows: DataFrame, blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Null-safe join with the per-block table: a NULL group is a group."""
    on = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    extra = [F.col(f"b.{c}") for c in blocks.columns if c not in keys]
    return rows.alias("r").join(blocks.alias("b"), on, "inner").select("r.*", *extra)


def key_rank(df: DataFrame, group_cols: Sequence[str], key_col: str, id_col: str, out_col: str) -> DataFrame:
    """1-based row number of every row inside its group by an md5 hex key (ties: id).

    The first four digits of an evenly spread key cut a group into 65,536 buckets; a count
    per bucket gives the offsets, a window inside buckets the rest. One hash shuffle, nothing
    sampled or checkpointed, and no group in one task. Groups must not be NULL."""
    cut = df.withColumn("__sy_cut", F.substring(key_col, 1, 4))
    keys = [*group_cols, "__sy_cut"]
    counts = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("__sy_n"))
    before = Window.partitionBy(*group_cols).orderBy("__sy_cut")
    offsets = counts.withColumn("__sy_off", F.sum("__sy_n").over(before) - F.col("__sy_n")).drop("__sy_n")
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy(key_col, id_col))
    return (cut.withColumn("__sy_in", inside).join(offsets, keys)
            .withColumn(out_col, F.col("__sy_off") + F.col("__sy_in")).drop("__sy_cut", "__sy_in", "__sy_off"))


def ordinal_within_group(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                         out_col: str = "ordinal", n_parts: int | None = None) -> DataFrame:
    """1-based row number of every row inside its group, in ``order_cols`` order."""
    group_cols = list(group_cols)
    staged = _stage(df, group_cols, order_cols, n_parts)
    blocks = staged.groupBy("__sy_pid", *group_cols).agg(
        F.min("__sy_pos").alias("__sy_start"), F.count(F.lit(1)).alias("__sy_cnt"))
    w = Window.partitionBy(*group_cols).orderBy("__sy_pid") if group_cols else Window.orderBy("__sy_pid")
    blocks = blocks.withColumn("__sy_offset", F.sum("__sy_cnt").over(w) - F.col("__sy_cnt")).drop("__sy_cnt")
    joined = _with_blocks(staged, blocks, ["__sy_pid", *group_cols])
    return joined.withColumn(
        out_col, (F.col("__sy_offset") + F.col("__sy_pos") - F.col("__sy_start") + 1).cast("bigint")
    ).drop("__sy_pid", "__sy_pos", "__sy_start", "__sy_offset")


def cumulative_sums(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str | Column],
                    sum_cols: Sequence[str], prefix: str = "cum_", n_parts: int | None = None) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` inside each group in ``order_cols`` order, and
    the group's totals as ``total_<col>`` (both from the table of block sums).

    Rows must be unique on ``group + order`` (aggregate ties first). The local
    running sum is a window over (partition, group), i.e. bounded by one range
    partition, never by a whole group.
    """
    group_cols = list(group_cols)
    staged = _stage(df, group_cols, order_cols, n_parts)
    local_w = (Window.partitionBy("__sy_pid", *group_cols).orderBy("__sy_pos")
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = staged
    for c in sum_cols:
        local = local.withColumn(f"__l_{c}", F.sum(c).over(local_w))
    blocks = staged.groupBy("__sy_pid", *group_cols).agg(*[F.sum(c).alias(f"__t_{c}") for c in sum_cols])
    w = Window.partitionBy(*group_cols).orderBy("__sy_pid") if group_cols else Window.orderBy("__sy_pid")
    whole = Window.partitionBy(*group_cols)
    for c in sum_cols:
        blocks = (blocks.withColumn(f"__o_{c}", F.sum(f"__t_{c}").over(w) - F.col(f"__t_{c}"))
                  .withColumn(f"total_{c}", F.sum(f"__t_{c}").over(whole)))
    blocks = blocks.drop(*[f"__t_{c}" for c in sum_cols])
    joined = _with_blocks(local, blocks, ["__sy_pid", *group_cols])
    for c in sum_cols:
        joined = joined.withColumn(f"{prefix}{c}", F.col(f"__o_{c}") + F.col(f"__l_{c}"))
    return joined.drop("__sy_pid", "__sy_pos", *[f"__l_{c}" for c in sum_cols], *[f"__o_{c}" for c in sum_cols])
