"""Pairwise-complete Pearson correlation over many columns.

A generated ``corr`` per pair would need d(d-1)/2 aggregate expressions (173,755
at 590 columns). Instead columns are cut into tiles of ``TILE``; a task adds its rows,
mean-shifted, into the masked Gram sums of pairs of tiles with numpy (X'X, X'M, (X^2)'M,
M'M; M = present mask) and emits one binary row per pair of tiles. Those are merged as a
tree of ``FAN`` rows a step, keyed by the pair of tiles, and only the last step writes
one row per pair of columns. A task holds at most ``HELD_BYTES`` of sums: wider tables take
several scans, each reading the columns of its tiles only. Neither memory nor any group
depends on d x d or on the number of tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensor_yield import config
from sensor_yield.operators.profile import column_stats

TILE = 128
HELD_BYTES = 64 << 20
FAN = 64
STATS = 6
GRAM_SCHEMA = "i int, j int, n double, sx double, sy double, sxx double, syy double, sxy double"
TILE_SCHEMA = "a int, b int, part int, sums binary"


def tile_groups(n_tiles: int, tile: int, held_bytes: int) -> list[list[tuple[int, int]]]:
    """Pairs of tiles (a <= b) in groups whose sums fit into ``held_bytes``; a group stays within few tiles."""
    per_group = max(1, held_bytes // (tile * tile * STATS * 8))
    side = max(1, int(per_group ** 0.5))
    squares: dict[tuple[int, int], list] = {}
    for a in range(n_tiles):
        for b in range(a, n_tiles):
            squares.setdefault((a // side, b // side), []).append((a, b))
    groups: list[list] = []
    for square in squares.values():
        if groups and len(groups[-1]) + len(square) <= per_group:
            groups[-1] += square
        else:
            groups.append(list(square))
    return groups


def _tile_sums(pairs: list[tuple[int, int]], tiles: dict[int, slice], means: np.ndarray):
    """Masked Gram sums of the pairs of tiles over the rows of a task."""
    def fold(batches):
        held = {p: np.zeros((STATS, tiles[p[0]].stop - tiles[p[0]].start, tiles[p[1]].stop - tiles[p[1]].start)) for p in pairs}
        seen = False
        for pdf in batches:
            if pdf.empty:
                continue
            seen = True
            x = pdf.to_numpy(dtype=np.float64, na_value=np.nan) - means
            present = ~np.isnan(x)
            x = np.where(present, x, 0.0)
            m, xx = present.astype(np.float64), x * x
            for (a, b), sums in held.items():
                p, q = tiles[a], tiles[b]
                for k, (left, right) in enumerate(((m, m), (x, m), (m, x), (xx, m), (m, xx), (x, x))):
                    sums[k] += left[:, p].T @ right[:, q]
        if seen:
            part = TaskContext.get().partitionId()
            yield pd.DataFrame([(a, b, part, sums.tobytes()) for (a, b), sums in held.items()],
                               columns=["a", "b", "part", "sums"])

    return fold


def _added(pdf: pd.DataFrame) -> np.ndarray:
    """The sums of the tasks, added in the order of their numbers."""
    total = None
    for raw in pdf.sort_values("part")["sums"]:
        each = np.frombuffer(raw)
        total = each.copy() if total is None else total + each
    return total


def _merge(fan: int):
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, part = (int(pdf[c].iloc[0]) for c in ("a", "b", "part"))
        return pd.DataFrame([(a, b, part // fan, _added(pdf).tobytes())], columns=["a", "b", "part", "sums"])

    return merge


def _unrolled(widths: dict[int, int], tile: int):
    """One row per pair of columns i < j."""
    def unroll(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        sums = _added(pdf).reshape(STATS, widths[a], widths[b])
        i, j = np.triu_indices(widths[a], 1) if a == b else (x.ravel() for x in np.indices((widths[a], widths[b])))
        return pd.DataFrame(dict(zip(("i", "j", "n", "sx", "sy", "sxx", "syy", "sxy"), (
            (a * tile + i).astype(np.int32), (b * tile + j).astype(np.int32), *(s[i, j] for s in sums)))))

    return unroll


def gram_sums(data: DataFrame, means: np.ndarray, tile: int = TILE, held_bytes: int = HELD_BYTES, fan: int = FAN) -> DataFrame:
    """One row per pair of columns of ``data`` with the six sums over rows where both are present."""
    cols = data.columns
    n_tiles = -(-len(cols) // tile)
    widths = {t: min(tile, len(cols) - t * tile) for t in range(n_tiles)}
    out = None
    for pairs in tile_groups(n_tiles, tile, held_bytes):
        used = sorted({t for p in pairs for t in p})
        begin = np.cumsum([0, *(widths[t] for t in used)])
        tiles = {t: slice(int(begin[k]), int(begin[k + 1])) for k, t in enumerate(used)}
        index = [c for t in used for c in range(t * tile, t * tile + widths[t])]
        part_data = data.select(*[F.col(cols[c]) for c in index])
        sums = part_data.mapInPandas(_tile_sums(pairs, tiles, means[index]), TILE_SCHEMA)
        parts = part_data.rdd.getNumPartitions()
        while parts > fan:
            sums = sums.groupBy("a", "b", F.expr(f"part div {fan}")).applyInPandas(_merge(fan), TILE_SCHEMA)
            parts = -(-parts // fan)
        rows = sums.groupBy("a", "b").applyInPandas(_unrolled(widths, tile), GRAM_SCHEMA)
        out = rows if out is None else out.unionByName(rows)
    return out


def pairwise_correlation(df: DataFrame, cols: Sequence[str], threshold: float | None = None, tile: int = TILE,
                         held_bytes: int = HELD_BYTES, fan: int = FAN) -> DataFrame:
    """Upper-triangle pairs ``feature_1, feature_2, correlation`` (file order of
    ``cols``), pairwise-complete like pandas ``DataFrame.corr``. Undefined pairs
    (constant column, fewer than two common rows) are dropped. With ``threshold``
    only pairs with ``abs(correlation) > threshold`` are kept."""
    cols = list(cols)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], "feature_1 string, feature_2 string, correlation double")
    data = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    # Column means (one aggregate, d values) make the sums numerically stable.
    mst = column_stats(data, cols, {"mean": "avg"})
    means = np.array([0.0 if mst[c]["mean"] is None else float(mst[c]["mean"]) for c in cols])
    sums = gram_sums(data, means, tile, held_bytes, fan)
    n, sx, sy, sxx, syy, sxy = (F.col(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy"))
    vx = n * sxx - sx * sx
    vy = n * syy - sy * sy
    cov = n * sxy - sx * sy
    # defined pairs only; tiny rounding overshoots are clipped so |r| <= 1
    r = F.when((n >= 2) & (vx > 0) & (vy > 0),
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(cols)], "k int, name string")
    out = (sums.select("i", "j", r.alias("correlation")).where(F.col("correlation").isNotNull())
           .join(F.broadcast(names.withColumnRenamed("k", "i").withColumnRenamed("name", "feature_1")), "i")
           .join(F.broadcast(names.withColumnRenamed("k", "j").withColumnRenamed("name", "feature_2")), "j"))
    if threshold is not None:
        out = out.where(F.abs(F.col("correlation")) > F.lit(threshold))
    return out.select("feature_1", "feature_2", "correlation")


def high_correlation_pairs(df: DataFrame, cols: Sequence[str],
                           threshold: float = config.HIGH_CORR_THRESHOLD) -> DataFrame:
    """Pairs with ``abs(r) > threshold`` sorted by ``abs(r)`` descending."""
    return pairwise_correlation(df, cols, threshold).orderBy(
        F.desc(F.abs(F.col("correlation"))), "feature_1", "feature_2")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A10: every cell of the correlation matrix in long form (diagonal 1 for
    non-constant columns), e.g. for the heat map of the top-variance features."""
    upper = pairwise_correlation(df, cols)
    lower = upper.select(F.col("feature_2").alias("feature_1"), F.col("feature_1").alias("feature_2"),
                         "correlation")
    var = column_stats(df, cols, {"var": "var_samp"})
    diag_rows = [(c, c, 1.0) for c in cols if var[c]["var"] is not None and var[c]["var"] > 0]
    diag = df.sparkSession.createDataFrame(diag_rows, "feature_1 string, feature_2 string, correlation double")
    return upper.unionByName(lower).unionByName(diag)
