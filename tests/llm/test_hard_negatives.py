"""Hard negatives against scoring everything, with ties, odd rows and walks of many blocks and chunks."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sensor_yield.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, q string, norm int"


def brute(rows, every=100, low=30, high=90, positives=5, negatives=10):
    kept = []
    for vec_id, x, label, *_ in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        kept.append((vec_id, [math.floor(256 * v) for v in x], label))
    out = []
    for i, (anchor, q, label) in enumerate(kept):
        if anchor is None or anchor % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, r)), float("inf") if n is None else n, j, n, lab)
                  for j, (n, r, lab) in enumerate(kept) if j != i]
        scored.sort(key=lambda s: s[:3])
        for ps, _, _, pid, _ in [s for s in scored if s[4] == label][:positives]:
            fit = [s for s in scored if s[4] != label and low * -ps <= 100 * -s[0] <= high * -ps][:negatives]
            out += [(anchor, pid, k, s[3], -ps, -s[0]) for k, s in enumerate(fit, 1)]
    return sorted(out, key=repr)


def mined(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).coalesce(parts)
    got = hn.mine(df, **kw).collect()
    return sorted([(r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got], key=repr)


def vectors(n, dim=6, spread=0.3, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(4, dim))
    return [(i, (centres[i % 4] + spread * rng.normal(size=dim)).tolist(), int(rng.integers(0, 3))) for i in range(n)]


def test_small_chunks_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(hn, "MEMBERS", 2)
    monkeypatch.setattr(hn, "ROWS", 40)
    rows = vectors(420)
    assert mined(spark, rows, every=20) == brute(rows, every=20)


def test_walks_end_before_the_lists(spark, monkeypatch):
    """Tight clusters: certified after the first blocks, with the same rows as a full scan."""
    rows = vectors(600, dim=8, spread=0.02, seed=3)
    scanned = []
    block = hn.Lists.block
    monkeypatch.setattr(hn.Lists, "block", lambda self, t, c: (scanned.append(t), block(self, t, c))[1])
    assert mined(spark, rows, every=50, low=95, high=100) == brute(rows, every=50, low=95, high=100)
    assert len(scanned) < 2 * (len(hn.BLOCKS) + 1)


def test_ties_and_hot_vector(spark):
    rows = [(i, [0.5, 0.25, -0.125], i % 2) for i in range(150)] + [(200 + i, [0.25, 0.125, 0.0], i % 3) for i in range(120)]
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part_and_odd_vectors(spark):
    rows = vectors(130) + [(300, None, 1), (400, [1.0, None], 1), (500, [float("nan")] * 6, 1), (600, [float("inf")] * 6, 1),
                           (700, [1.0] * 6, None), (800, [], 1), (900, [0.0] * 6, 1), (1000, [0.9], 1), (1100, [0.5] * 9, 2),
                           (None, [0.9, 0.9, 0.9, 0.9, 0.9, 0.9], 1), (0, [0.7] * 6, 2), (0, [0.7] * 6, 2), (-100, [-0.3] * 6, 0)]
    assert mined(spark, rows, parts=1) == brute(rows)


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.integers(-65000, 65000, 6) + 0.5).tolist(), int(i % 2)) for i in range(90)]
    assert mined(spark, rows, every=30) == brute(rows, every=30)


@pytest.mark.parametrize("rows", [[], [(7, [1.0], 1)], [(100, [1.0], 1)], [(100, [1.0], 1), (1, [1.0], 2)]])
def test_nothing_to_mine(spark, rows):
    assert mined(spark, rows) == []


def test_bounds_hold():
    rng = np.random.default_rng(7)
    q = rng.integers(-300, 300, (400, 5))
    centroids = hn.fit_centroids(q[:50], 4)
    t = hn.angles(q[:50], centroids)
    nearest = t.argmin(1)
    norm = np.sqrt((q.astype(float) ** 2).sum(1))
    for c in range(len(centroids)):
        members = np.flatnonzero(nearest == c)
        radius = t[members, c].max(initial=0)
        bound = norm * np.cos(np.maximum(0, hn.angles(q, centroids)[:, c] - radius - hn.SLACK))
        for u in members:
            assert (hn.product(q[u:u + 1], q)[0] <= norm[u] * bound + 1e-6 * norm[u]).all()
