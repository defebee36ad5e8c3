"""Hard negatives by anchor-clustered shared lists (MAXIMUS-style exact inner-product search).

Anchors are clustered by angle around ``CLUSTERS`` centroids (k-means on ``SAMPLE`` anchors of the
smallest hashes; it only steers how early a walk ends). A row r at angle t from a centroid has an inner
product of at most |u| |r| cos(max(0, t - radius)) with any member u of the cluster. The factor without
|u| orders one list per cluster, computed once per row and kept as blocks of falling bound.

All members of a cluster walk its blocks together, one job per block. A block meets the members in chunks
of at most some ``MEMBERS`` x ``ROWS``, dealt by hash, so no list, label or vector gathers in a task; in a
chunk rows stand by falling bound and a member goes no further than its goal's worst accepted score. After
each block a goal is closed when its worst accepted score lies above the next block's bound, or when that
bound lies below the goal's range: then nothing further on can count. Members without open goals leave.

There are two walks: for the positives (same label), then for each positive's negatives (other labels,
scores between ``low`` and ``high`` percent of the positive's).

Components are floor(256 x), held within +-2^24, so that scores of up to 2^14 components fit a long.
Products are float64 where all sums stay below 2^53, else int64: exact either way.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; shorter
vectors count as padded with zeros; a null id is no anchor, keeps its label and comes last among ties;
rows with one id are rows of their own (each an anchor if the id says so, ties between them in stored
order); an anchor without positives or negatives has no rows; a table without anchors gives none; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sensor_yield.llm.common import stored

CLUSTERS = 8
SAMPLE = 4096
MEMBERS, ROWS = 2048, 8192
#: Shares of a list up to the ends of its blocks.
BLOCKS = (1 / 32, 1 / 4)
LIMIT = 1 << 24
#: Radians added to each radius, far above the rounding of an angle.
SLACK = 1e-6
LAST = (1 << 63) - 1
FOUND = "anchor bigint, goal int, score bigint, key bigint, uid bigint"


def prepared(rows: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """uid, vec_id, key (the id, nulls last), label, q (whole components), norm."""
    x = F.col(vector_col)
    usable = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    whole = lambda v: F.floor(F.greatest(F.lit(float(-LIMIT)), F.least(F.lit(float(LIMIT)), v.cast("double") * 256)))
    vec_id = F.col(id_col).cast("bigint")
    kept = (rows.select(vec_id.alias("vec_id"), label.cast("bigint").alias("label"), x.alias("x"), usable.alias("usable"))
            .where(F.col("usable") & F.col("label").isNotNull())
            .select("vec_id", F.coalesce("vec_id", F.lit(LAST)).alias("key"), "label",
                    F.transform("x", lambda v: whole(v).cast("int")).alias("q")))
    norm = F.sqrt(F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return stored(kept.select(F.monotonically_increasing_id().alias("uid"), "*", norm.alias("norm")), "vectors")


def matrix(vectors, width: int | None = None) -> np.ndarray:
    """Whole vectors as rows of int64, padded with zeros."""
    vectors = [np.asarray(v, np.int64) for v in vectors]
    width = max([width or 0, *map(len, vectors)])
    if all(len(v) == width for v in vectors) and vectors:
        return np.stack(vectors)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[:len(v)] = v
    return out


def angles(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Radians between rows and centroids; 0 for rows of zeros."""
    width = max(q.shape[1], centroids.shape[1])
    grow = lambda m: np.pad(m.astype(float), ((0, 0), (0, width - m.shape[1])))
    q, c = grow(q), grow(centroids)
    norm = np.sqrt((q * q).sum(1, keepdims=True))
    return np.where(norm > 0, np.arccos(np.clip(q @ c.T / np.where(norm > 0, norm, 1), -1, 1)), 0.0)


def fit_centroids(q: np.ndarray, k: int, rounds: int = 8, seed: int = 13) -> np.ndarray:
    """Unit centroids of spherical k-means."""
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    unit = q[norm > 0] / norm[norm > 0, None]
    if not len(unit):
        return np.eye(1, max(1, q.shape[1]))
    centroids = unit[np.random.default_rng(seed).choice(len(unit), min(k, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(1)
        sums = np.stack([unit[nearest == c].sum(0) for c in range(len(centroids))])
        size = np.sqrt((sums ** 2).sum(1, keepdims=True))
        centroids = np.where(size > 0, sums / np.where(size > 0, size, 1), centroids)
    return centroids


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _clustered(centroids: np.ndarray):
    def assign(batches):
        for batch in batches:
            t = angles(matrix(batch.column("q").to_pylist()), centroids) if len(batch) else np.zeros((0, len(centroids)))
            yield pa.RecordBatch.from_arrays([batch.column("uid"), pa.array(t.argmin(1), pa.int32()), pa.array(t.min(1))],
                                             names=["uid", "cluster", "angle"])

    return assign


def _bounded(centroids: np.ndarray, radius: np.ndarray):
    def bound(batches):
        for batch in batches:
            t = angles(matrix(batch.column("q").to_pylist()), centroids) if len(batch) else np.zeros((0, len(centroids)))
            bounds = batch.column("norm").to_numpy()[:, None] * np.cos(np.maximum(0, t - radius - SLACK))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(bounds), pa.list_(pa.float64()))],
                                             names=[*batch.schema.names, "bounds"])

    return bound


class Lists:
    """The shared lists: every row with its bound for each cluster, and the blocks' borders and sizes."""

    def __init__(self, rows: DataFrame, anchors: DataFrame):
        sample = anchors.orderBy(F.xxhash64("key", "uid"), "uid").limit(SAMPLE).select("q").collect()
        self.centroids = fit_centroids(matrix([r.q for r in sample]), CLUSTERS)
        k = len(self.centroids)
        places = stored(anchors.select("uid", "q").mapInArrow(_clustered(self.centroids), "uid bigint, cluster int, angle double"),
                        "clusters")
        self.members = stored(anchors.join(places.drop("angle"), "uid"), "members")
        radius = np.zeros(k)
        for r in places.groupBy("cluster").agg(F.max("angle").alias("radius")).collect():  # one row per cluster
            radius[r.cluster] = r.radius
        self.rows = stored(rows.mapInArrow(_bounded(self.centroids, radius),
                                           "uid bigint, vec_id bigint, key bigint, label bigint, q array<int>, norm double, bounds array<double>"), "lists")
        cuts = self.rows.agg(*[F.percentile_approx(F.col("bounds")[c], [1 - b for b in BLOCKS], 1000).alias(f"c{c}")
                               for c in range(k)]).first()
        #: borders[t][c]: the least bound in block t; the last block has no border
        self.borders = [[(cuts[c] or [float("inf")] * len(BLOCKS))[t] for c in range(k)] for t in range(len(BLOCKS))] + [[None] * k]
        counts = self.rows.agg(*[F.count_if(self._inside(t, c)).alias(f"n{t}_{c}")
                                 for t in range(len(self.borders)) for c in range(k)]).first()
        self.counts = [[counts[f"n{t}_{c}"] for c in range(k)] for t in range(len(self.borders))]

    def _inside(self, t: int, c: int) -> Column:
        bound = F.col("bounds")[c]
        above = F.lit(True) if self.borders[t][c] is None else bound >= self.borders[t][c]
        return above & (bound < self.borders[t - 1][c]) if t else above

    def block(self, t: int, clusters: dict[int, int]) -> DataFrame:
        """The rows of block ``t`` of each cluster, once per chunk of its members."""
        entry = lambda c, n: F.when(self._inside(t, c), F.struct(
            F.lit(c).alias("cluster"), F.col("bounds")[c].alias("bound"), F.lit(-(-n // MEMBERS)).alias("chunks"),
            F.lit(self.parts(t, c)).alias("parts")))
        entries = F.array(*[entry(c, n) for c, n in clusters.items()])
        return (self.rows.select("uid", "key", "label", "q", F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
                .select("uid", "key", "label", "q", "e.cluster", "e.bound", F.pmod(F.xxhash64("uid"), "e.parts").alias("part"),
                        F.explode(F.sequence(F.lit(0), F.col("e.chunks") - 1)).alias("chunk")))

    def parts(self, t: int, c: int) -> int:
        return max(1, -(-self.counts[t][c] // ROWS))

    def beyond(self, t: int) -> Column:
        """The bound of everything after block ``t`` for a member, with room for rounding."""
        factor = F.element_at(F.array(*[F.lit(b) for b in self.borders[t]]), F.col("cluster") + 1)
        bound = factor * F.col("norm")
        return bound + F.abs(bound) * 1e-9 + 1e-6


def _scan(same: bool, want: int):
    """Members of a chunk against rows of a block: each goal's first ``want`` rows."""
    def scan(members: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros((0, 5), np.int64)]
        rows = rows.sort_values("bound", ascending=False, kind="stable")
        q = matrix(rows["q"]) if len(rows) else np.zeros((0, 0), np.int64)
        own = matrix(members["q"], q.shape[1]) if len(members) else q
        q = matrix(rows["q"], own.shape[1]) if own.shape[1] > q.shape[1] else q
        uid, key, label, bound = (rows[c].to_numpy() for c in ("uid", "key", "label", "bound"))
        for s in range(0, len(members), 256):
            some = members.iloc[s:s + 256]
            need = np.array([float(low.min()) for low in some["low"]])
            top = some["norm"].to_numpy()[:, None] * bound[None, :]
            reach = (top + np.abs(top) * 1e-9 + 1e-6 >= need[:, None]).sum(1)
            scores = product(own[s:s + 256], q[:reach.max(initial=0)])
            for i, m in enumerate(some.itertuples(index=False)):
                row = scores[i, :reach[i]]
                able = ((label[:reach[i]] == m.label) == same) & (uid[:reach[i]] != m.uid)
                for goal, low, high in zip(m.goal, m.low, m.high):
                    at = np.flatnonzero(able & (row >= low) & (row <= high))
                    if len(at) > want:
                        at = at[row[at] >= np.partition(row[at], len(at) - want)[len(at) - want]]
                    at = at[np.lexsort((uid[at], key[at], -row[at]))][:want]
                    out.append(np.column_stack([np.full(len(at), m.uid), np.full(len(at), goal), row[at], key[at], uid[at]]))
        return pd.DataFrame(np.concatenate(out), columns=["anchor", "goal", "score", "key", "uid"])

    return scan


def walk(lists: Lists, goals: DataFrame, same: bool, want: int) -> DataFrame:
    """The first ``want`` rows by (score descending, key, uid) of every goal (uid, goal, low, high): rows of the
    member's label, or of others, with scores from low to high. Adds ``rank``."""
    rank = F.row_number().over(Window.partitionBy("anchor", "goal").orderBy(F.desc("score"), "key", "uid"))
    keys = ["cluster", "chunk", "part"]
    best, open_goals, rounds = None, goals, len(lists.borders)
    for t in range(rounds):
        entry = F.sort_array(F.collect_list(F.struct("goal", "low", "high")))
        active = stored(lists.members.join(open_goals.groupBy("uid").agg(entry.alias("g")), "uid")
                        .select("uid", "cluster", "label", "norm", "q", "g.goal", "g.low", "g.high"), "walkers")
        clusters = {r["cluster"]: r["count"] for r in active.groupBy("cluster").count().collect()}  # one row per cluster
        if not clusters:
            break
        table = lambda of: F.element_at(F.create_map(*[
            F.lit(v) for c, n in clusters.items() for v in (c, of(c, n))]), F.col("cluster"))
        walkers = active.select(
            "*", F.pmod(F.xxhash64("uid"), table(lambda c, n: -(-n // MEMBERS))).alias("chunk"),
            F.explode(F.sequence(F.lit(0), table(lambda c, n: lists.parts(t, c)) - 1)).alias("part"))
        block = lists.block(t, clusters)
        typed = lambda d: d.withColumns({c: F.col(c).cast("int") for c in keys})
        found = (typed(walkers).groupBy(*keys).cogroup(typed(block).groupBy(*keys))
                 .applyInPandas(_scan(same, want), FOUND))
        merged = found if best is None else found.unionByName(best.drop("rank"))
        best = stored(merged.withColumn("rank", rank).where(F.col("rank") <= want), "walked")
        if t < rounds - 1:
            worst = (best.where(F.col("rank") == want)
                     .select(F.col("anchor").alias("uid"), "goal", F.col("score").alias("worst")))
            beyond = lists.members.select("uid", lists.beyond(t).alias("beyond"))
            open_goals = (open_goals.join(beyond, "uid").join(worst, ["uid", "goal"], "left")
                          .withColumn("low", F.greatest("low", F.coalesce("worst", "low")))
                          .where(F.col("low").cast("double") <= F.col("beyond")).select("uid", "goal", "low", "high"))
    if best is None:
        best = goals.sparkSession.createDataFrame([], f"{FOUND}, rank int")
    return best


def mine(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None,
         every: int = 100, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Anchors are the rows whose id
    is divisible by ``every``; ``low`` and ``high`` are percentages of the positive's score."""
    vectors = prepared(rows, id_col, vector_col, F.col("label") if label is None else label)
    anchors = stored(vectors.where(F.col("vec_id") % every == 0), "anchors")
    lists = Lists(vectors, anchors)
    everything = anchors.select("uid", F.lit(0).alias("goal"), F.lit(-LAST).alias("low"), F.lit(LAST).alias("high"))
    near = walk(lists, everything, True, positives)
    # p x share / 100 without overflow, from p = 100 d + m
    m = F.pmod(F.col("score"), F.lit(100).cast("bigint"))
    d = F.call_function("div", F.col("score") - m, F.lit(100).cast("bigint"))
    goals = near.select(F.col("anchor").alias("uid"), F.col("rank").alias("goal"),
                        (d * low + F.call_function("div", m * low + 99, F.lit(100).cast("bigint"))).alias("low"),
                        (d * high + F.call_function("div", m * high, F.lit(100).cast("bigint"))).alias("high"))
    hard = walk(lists, stored(goals.where("low <= high"), "goals"), False, negatives)
    named = lambda c: F.when(F.col(c) != LAST, F.col(c))
    pairs = near.select("anchor", F.col("rank").alias("goal"), F.col("score").alias("positive_score"),
                        named("key").alias("positive_id"))
    return (hard.select("anchor", "goal", "rank", F.col("score").alias("negative_score"), named("key").alias("negative_id"))
            .join(pairs, ["anchor", "goal"]).join(anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id")),
                                                  "anchor")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
