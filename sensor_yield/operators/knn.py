"""Exact k nearest neighbours with pruned blocks.

One path at every size:

1. of rows with equal vectors only the k + 1 smallest ids can be anybody's neighbours, so only these are
   searched, and every distinct vector asks once (a group of copies costs no more than its first rows);
2. vectors belong to the nearest of a few pivots and are cut, by distance to it, into blocks of
   ``block_rows``; a block is a ring [least, greatest] around its pivot;
3. neighbours within the own block give every vector a bound; by the triangle inequality a block whose ring
   lies further than that from the vector's own distance to the pivot holds no neighbour and is skipped;
4. the remaining (vector, block) pairs are scored block by block in chunks of queries, and the best of all
   blocks are merged by distance, then id.

Order and ties are decided by sums of squared differences, which do not depend on the blocks. The driver
sees the pivots (at most ``PIVOTS`` vectors) and one ring per block (at most ``MOST_BLOCKS``).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensor_yield.operators.ordering import ordinal_within_group
from sensor_yield.session import cut_lineage

PIVOTS = 32
MOST_BLOCKS = 1 << 18
QUERIES = 4096
FOUND = "qid bigint, dist double, nb_id bigint"


def nearest(q_ids, q, r_ids, r, k, bound=None):
    """(qid, distance squared, rid) of the k rows of ``r`` nearest to each row of ``q``, nearest first, ties by id;
    with ``bound`` none further than that (squared).

    The expanded form of the distance only preselects, with room for its rounding."""
    out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
    rn = (r * r).sum(axis=1)
    for s in range(0, len(q), 512):
        qb = q[s:s + 512]
        qn = (qb * qb).sum(axis=1)
        d = np.maximum(qn[:, None] + rn[None, :] - 2.0 * qb @ r.T, 0.0)
        edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
        if bound is not None:
            edge = np.minimum(edge, bound[s:s + 512])
        row, col = np.nonzero(d <= (edge + 1e-9 * (1.0 + edge + qn + rn.max()))[:, None])
        dist = ((qb[row] - r[col]) ** 2).sum(axis=1)
        order = np.lexsort((r_ids[col], dist, row))
        row, col, dist = row[order], col[order], dist[order]
        kept = np.arange(len(row)) - np.searchsorted(row, row, "left") < k
        out.append((q_ids[s:s + 512][row[kept]], dist[kept], r_ids[col[kept]]))
    return tuple(np.concatenate(c) for c in zip(*out))


def _matrix(column) -> np.ndarray:
    return np.vstack(column.to_numpy())


def _frame(found) -> pd.DataFrame:
    return pd.DataFrame(dict(zip(("qid", "dist", "nb_id"), found)))


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(((x[:, None, :] - pivots[None]) ** 2).sum(axis=2), 0.0))


def _placed(pivots: np.ndarray):
    """Nearest pivot and the distance to it."""
    def place(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            for s in range(0, len(batch), 1024):
                d = _distances(x[s:s + 1024], pivots)
                cell = d.argmin(axis=1)
                part = batch.slice(s, 1024)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(d.min(axis=1))],
                                                 names=[*batch.schema.names, "cell", "r"])

    return place


def _within(k: int):
    def search(block: pd.DataFrame) -> pd.DataFrame:
        own = block["asks"].to_numpy()
        ids, x = block["id"].to_numpy(), _matrix(block["x"])
        return _frame(nearest(ids[own], x[own], ids, x, k)) if own.any() else _frame(nearest(ids[:0], x[:0], ids, x, k))

    return search


def _reached(pivots: np.ndarray, rings: np.ndarray):
    """The blocks other than its own that a vector's bound reaches. ``rings``: cell, least, greatest per block."""
    cell, least, greatest = rings[:, 0].astype(int), rings[:, 1], rings[:, 2]

    def reach(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(len(batch), -1)
            ids, own, tau = (batch.column(c).to_numpy() for c in ("id", "block", "tau"))
            for s in range(0, len(batch), 256):
                d = _distances(x[s:s + 256], pivots)[:, cell]
                gap = np.maximum(d - greatest, least - d)
                far = np.sqrt(tau[s:s + 256])[:, None]
                near = gap <= far + 1e-9 * (1.0 + np.where(np.isfinite(far), far, 0.0) + d)
                near[np.arange(len(near)), own[s:s + 256]] = False
                row, block = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(ids[s:s + 256][row]), pa.array(tau[s:s + 256][row]),
                                                  pa.array(block.astype(np.int32))], names=["qid", "tau", "block"])

    return reach


def _across(k: int):
    def search(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or block.empty:
            return _frame((np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)))
        return _frame(nearest(queries["qid"].to_numpy(), _matrix(queries["x"]), block["id"].to_numpy(), _matrix(block["x"]), k,
                              queries["tau"].to_numpy()))

    return search


def neighbours(points: DataFrame, id_col: str, vec_col: str, k: int, block_rows: int = 2048, pivots: int = PIVOTS) -> DataFrame:
    """``qid, nb_rank, nb_id`` for the k nearest other rows of every row of ``points`` (unique ids, vectors without NaN)."""
    pts = points.select(F.col(id_col).cast("long").alias("id"), vector_to_array(F.col(vec_col)).alias("x"))
    at = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    refs = cut_lineage(pts.withColumn("copy", at).where(F.col("copy") <= k + 1)
                       .select("id", "x", (F.col("copy") == 1).alias("asks")))
    n = refs.count()
    if n == 0 or k < 1:
        return pts.sparkSession.createDataFrame([], "qid bigint, nb_rank int, nb_id bigint")
    sample = refs.where("asks").orderBy(F.xxhash64("id"), "id").limit(pivots).select("x").collect()
    centres = np.array([r.x for r in sample], float).reshape(len(sample), -1)
    placed = refs.mapInArrow(_placed(centres), "id bigint, x array<double>, asks boolean, cell int, r double")
    size = max(block_rows, -(-n // (MOST_BLOCKS - PIVOTS)))
    ranked = ordinal_within_group(placed, ["cell"], ["r", "id"], "at").withColumn(
        "part", F.expr(f"(at - 1) div {size}").cast("int")).drop("at")
    rings = (ranked.groupBy("cell", "part").agg(F.min("r").alias("least"), F.max("r").alias("greatest"))
             .orderBy("cell", "part").collect())
    number = {}
    for i, r in enumerate(rings):
        number.setdefault(r.cell, i)
    first = F.element_at(F.create_map(*[F.lit(v) for c, i in number.items() for v in (c, i)]), F.col("cell"))
    blocks = cut_lineage(ranked.select("id", "x", "asks", (first + F.col("part")).alias("block")))
    within = cut_lineage(blocks.groupBy("block").applyInPandas(_within(k + 1), FOUND))
    tau = within.groupBy(F.col("qid").alias("id")).agg(
        F.when(F.count(F.lit(1)) > k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("tau"))
    asking = cut_lineage(blocks.where("asks").drop("asks").join(tau, "id"))
    pairs = cut_lineage(asking.mapInArrow(_reached(centres, np.array([[r.cell, r.least, r.greatest] for r in rings])),
                                          "qid bigint, tau double, block int"))
    chunks = pairs.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERIES)).cast("int").alias("chunks"))
    # both sides get columns of their own: they share tables
    queries = (pairs.join(asking.select(F.col("id").alias("qid"), "x"), "qid").join(chunks, "block")
               .select(F.col("qid").alias("qid"), F.col("x").alias("x"), F.col("tau").alias("tau"), F.col("block").alias("block"),
                       F.pmod(F.xxhash64("qid"), F.col("chunks")).cast("int").alias("chunk")))
    targets = (blocks.join(chunks, "block")
               .select(F.col("id").alias("id"), F.col("x").alias("x"), F.col("block").alias("block"),
                       F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")))
    across = (queries.groupBy("block", "chunk").cogroup(targets.groupBy("block", "chunk")).applyInPandas(_across(k + 1), FOUND))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("dist", "nb_id"))
    best = within.unionByName(across).withColumn("rank", rank).where(F.col("rank") <= k + 1)
    lists = best.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "nb_id"))).alias("l"))
    by_vector = asking.select(F.col("id").alias("qid"), "x").join(lists, "qid").select("x", F.col("l.nb_id").alias("l"))
    others = F.slice(F.filter("l", lambda i: i != F.col("id")), 1, k)
    return pts.join(by_vector, "x").select(F.col("id").alias("qid"), F.posexplode(others).alias("nb_rank", "nb_id"))
