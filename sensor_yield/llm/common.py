"""Shared helpers of the training-data operators: intermediate tables and binary files in
the folder all executors share, and distributed running sums."""

from __future__ import annotations

import sys
import types
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.session import ensure_checkpoint_dir

#: Bytes up to which a lookup table may be sent to every executor.
BROADCAST_LIMIT = 32 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}-{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage with files that
    outlive any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and then with those it had."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def shuffles_freed(spark: SparkSession):
    """Inside, a step's shuffle files are deleted when it ends, not when its plan is collected as
    garbage: a ``stored`` table does not need them again."""
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def broadcast_limit(spark: SparkSession) -> int:
    """Spark's own limit for broadcast sides, in bytes."""
    said = spark.conf.get("spark.sql.autoBroadcastJoinThreshold").strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(said[-1:], 1)
    return int(said.rstrip("kmg")) * unit


def arrow_rows(spark: SparkSession, most: int = 500) -> None:
    """Hold batches that go to Python to ``most`` rows: whole texts can be long."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, str(most))


def process_cache() -> dict:
    """A dictionary that lives as long as the Python process: Spark runs many tasks in one."""
    return sys.modules.setdefault("sensor_yield_process_cache", types.ModuleType("sensor_yield_process_cache")).__dict__


def task_count(wanted: int, most: int = 20_000) -> int:
    """A number of tasks: more than ``most`` only make scheduling dearer, so they share."""
    return max(1, min(wanted, most))


def running_sum(df: DataFrame, group: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of the same group that come earlier in
    ``order`` (whose first column is a BIGINT spread evenly over its range).

    No group meets in one task: rows are windowed inside buckets of the first order column
    and a table of bucket totals gives the offsets. There are about sqrt(rows) buckets, so that
    both grow with the square root of a group."""
    bits = (max(1, df.count()).bit_length() + 1) // 2
    df = df.withColumn("__bucket", F.shiftright(F.col(order[0]), 63 - bits))
    inside = Window.partitionBy(*group, "__bucket").orderBy(*order)
    before = Window.partitionBy(*group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (df.groupBy(*group, "__bucket").agg(F.sum(value).alias("__total"))
              .withColumn("__offset", F.coalesce(F.sum("__total").over(before), F.lit(0).cast("bigint")))
              .drop("__total"))
    ranked = df.withColumn("__inner", F.coalesce(
        F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("bigint")))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in [*group, "__bucket"]]
    return (ranked.alias("r").join(totals.alias("t"), on)
            .select("r.*", (F.col("r.__inner") + F.col("t.__offset")).alias(out))
            .drop("__inner", "__bucket"))
