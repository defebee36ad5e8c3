"""Exact deduplication as a stateful stream [native].

A streaming aggregation keyed by the SHA-256 of the text keeps, per digest, the number of
rows seen and the stable identifier (largest doc_id) with its content locator (file, row).
The state lives in RocksDB on disk, is committed to the shared folder and never expires, so
documents that arrive later meet everything seen before. Digest hits are then checked on
their full bytes: the texts of repeated digests are grouped by the text itself, and a digest
that covers two texts is resolved by text.

Copies are pre-aggregated before each shuffle by key, so a text that makes up a third of the
rows costs one row per task.

Defined cases: a null text counts as empty; a null doc_id is smaller than any other; of rows
that repeat text and doc_id, the one with the largest (file, row) stays; an empty table gives
no rows; columns other than the two named are never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sensor_yield.llm.common import broadcast_limit, scratch, settings, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Without preallocation: RocksDB sets aside 4 MB for the manifest of every store that is opened,
#: and there is one store per shuffle partition.
STORE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
         "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: A row of repeated digests in memory, in bytes (a hex digest and its overhead).
DIGEST_ROW_BYTES = 160


def _rows(df: DataFrame, id_col: str, text_col: str, keep_text: bool = False) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    locator = F.struct(F.col(id_col).cast("bigint").alias("doc_id"), F.col("_metadata.file_path").alias("file"),
                       F.col("_metadata.row_index").alias("row"))
    return df.select(F.sha2(text.cast("binary"), 256).alias("digest"), locator.alias("at"),
                     *([text.alias("text")] if keep_text else []))


def start_dedup(stream: DataFrame, state_dir: str, id_col: str = "doc_id", text_col: str = "text",
                output: str = "noop", **trigger) -> StreamingQuery:
    """Start the stateful query over a stream of files. ``state_dir`` keeps the state between
    runs; ``trigger`` defaults to "everything there is, then stop"."""
    spark = stream.sparkSession
    seen = (_rows(stream, id_col, text_col).groupBy("digest")
            .agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("keeper")))
    with settings(spark, STORE):
        return (seen.writeStream.format(output).outputMode("update").option("checkpointLocation", state_dir)
                .trigger(**(trigger or {"availableNow": True})).start())


def read_state(spark: SparkSession, state_dir: str) -> DataFrame:
    """The keyed state as a table: digest, n, keeper (doc_id, file, row)."""
    return (spark.read.format("statestore").load(state_dir)
            .select(F.col("key.digest").alias("digest"), F.col("value.count").alias("n"),
                    F.col("value.max").alias("keeper")))


def _same_place(a: Column, b: Column) -> Column:
    return (a["file"] == b["file"]) & (a["row"] == b["row"])


def byte_classes(docs: DataFrame, state: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Full-byte check of the digest hits: one row per (digest, text) among repeated digests,
    with its own count and keeper. The list of repeated digests goes to all executors only if
    its counted size fits Spark's own broadcast limit; else every text is grouped."""
    repeated = state.where("n > 1").select("digest")
    rows = _rows(docs, id_col, text_col, keep_text=True)
    if repeated.count() * DIGEST_ROW_BYTES <= broadcast_limit(docs.sparkSession):
        rows = rows.join(F.broadcast(repeated), "digest", "left_semi")
    return rows.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("keeper"))


def resolve(docs: DataFrame, state: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    classes = stored(byte_classes(docs, state, id_col, text_col)
                     .groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
                     .select("digest"), "collisions")
    rows = _rows(docs, id_col, text_col)
    found = rows.join(state, "digest")
    if not classes.isEmpty():  # two texts under one digest: decide by the text
        whole = _rows(docs, id_col, text_col, keep_text=True).join(classes, "digest", "left_semi")
        by_text = whole.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("n"), F.max("at").alias("keeper"))
        found = found.join(classes, "digest", "left_anti").unionByName(
            whole.join(by_text, ["digest", "text"]).select(*found.columns))
    return found.select(F.col("at.doc_id").alias("doc_id"), F.col("keeper.doc_id").alias("keep_id"),
                        F.col("n").alias("group_size"), _same_place(F.col("at"), F.col("keeper")).alias("kept"),
                        F.col("digest").alias("text_sha256"))


def dedup_files(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text",
                state_dir: str | None = None, max_files_per_batch: int | None = None) -> DataFrame:
    """Stream the parquet files under ``path`` (a folder or one file) through the keyed state
    and return the decision for every row. A given ``state_dir`` continues an earlier run."""
    docs = spark.read.parquet(path)
    state_dir = state_dir or scratch(spark, "dedup-state")
    reader = spark.readStream.schema(docs.schema)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)
    # a file source wants a folder; as a pattern, one file will do as well
    start_dedup(reader.parquet(f"{path[:-1]}[{path[-1]}]"), state_dir, id_col, text_col).awaitTermination()
    with settings(spark, STORE):
        seen = stored(read_state(spark, state_dir), "dedup-seen")
    return resolve(docs, seen, id_col, text_col)
