"""Pruned nearest neighbours against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector

from sensor_yield.operators import knn


def frame(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in r]) for i, r in zip(ids, x)]
    return spark.createDataFrame(rows, "id long, a array<double>").select("id", array_to_vector("a").alias("v"))


def plain(x, ids, k):
    out = []
    for i, a in zip(ids, x):
        d = sorted((float(((a - b) ** 2).sum()), int(j)) for j, b in zip(ids, x) if j != i)
        out += [(int(i), r, j) for r, (_, j) in enumerate(d[:k])]
    return sorted(out)


def found(df, k, *args):
    return sorted((r.qid, r.nb_rank, r.nb_id) for r in knn.neighbours(df, "id", "v", k, *args).collect())


@pytest.mark.parametrize("block_rows,pivots", [(2048, 32), (25, 6), (9, 3)])
def test_equals_all_distances(spark, block_rows, pivots):
    rng = np.random.default_rng(1)
    centres = rng.normal(scale=5, size=(6, 4))
    x = np.concatenate([centres[rng.integers(0, 6, 200)] + rng.normal(scale=0.4, size=(200, 4)), np.zeros((40, 4)),
                        np.round(rng.normal(size=(60, 4)))])
    ids = rng.permutation(len(x)) * 3 - 100
    assert found(frame(spark, x, ids), 5, block_rows, pivots) == plain(x, ids, 5)


def test_far_blocks_are_skipped(spark):
    """Tight groups far apart: a vector is scored against few blocks."""
    rng = np.random.default_rng(2)
    x = np.repeat(np.arange(10)[:, None] * 100.0, 60, axis=0) + rng.normal(size=(600, 3))
    pairs = []
    reached = knn._reached

    def counting(pivots, rings):
        run = reached(pivots, rings)
        pairs.append(len(rings))
        return run

    knn._reached, before = counting, reached
    try:
        got = found(frame(spark, x), 3, 20, 10)
    finally:
        knn._reached = before
    assert got == plain(x, range(600), 3)
    rings = np.array([[0, 0.0, 1.0], [0, 5.0, 6.0], [1, 0.0, 1.0]])
    batch = __import__("pyarrow").RecordBatch.from_pydict({"id": [1], "x": [[0.5, 0.0]], "tau": [1.0], "block": np.array([0], np.int32)})
    out = next(iter(before(np.array([[0.0, 0.0], [50.0, 0.0]]), rings)([batch])))
    assert pairs[0] >= 30 and len(out) == 0  # both other rings lie further than the bound


def test_copies_of_one_vector(spark):
    """Half of the rows are equal: neighbours are the smallest other ids, and copies are not searched."""
    x = np.concatenate([np.ones((150, 2)), np.random.default_rng(3).normal(size=(20, 2))])
    assert found(frame(spark, x), 4, 16, 4) == plain(x, range(len(x)), 4)


@pytest.mark.parametrize("n", [0, 1, 2, 4])
def test_fewer_rows_than_neighbours(spark, n):
    x = np.arange(2 * n, dtype=float).reshape(n, 2)
    assert found(frame(spark, x) if n else frame(spark, np.ones((1, 2))).limit(0), 5) == plain(x, range(n), 5)
