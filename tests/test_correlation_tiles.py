"""Correlation by tiles: any tile size, memory bound and fan-in give the same pairs as pandas."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from sensor_yield.operators import correlation as co


def sensors(n, d, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[:, 1] = 3 * x[:, 0] + rng.normal(scale=0.01, size=n)
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 2] = 5.0
    return pd.DataFrame(x, columns=[f"feature_{i:03d}" for i in range(d)])


def as_spark(spark, pdf, parts):
    rows = [tuple(None if np.isnan(v) else float(v) for v in r) for r in pdf.to_numpy()]
    return spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns)).repartition(parts)


@pytest.mark.parametrize("tile,held,fan,parts", [(128, 64 << 20, 64, 3), (4, 64 << 20, 2, 7), (4, 4 * 4 * 48 * 3, 3, 5), (5, 1, 2, 2)])
def test_equals_pandas(spark, tile, held, fan, parts):
    pdf = sensors(80, 13)
    got = {(r.feature_1, r.feature_2): r.correlation
           for r in co.pairwise_correlation(as_spark(spark, pdf, parts), list(pdf.columns), None, tile, held, fan).collect()}
    corr = pdf.corr()
    want = {(a, b): corr.loc[a, b] for i, a in enumerate(pdf.columns) for b in pdf.columns[i + 1:] if not np.isnan(corr.loc[a, b])}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_groups_cover_every_pair_once_within_the_bound():
    for n_tiles in (1, 2, 5, 16, 40):
        for held in (1, 128 * 128 * 48 * 7, 64 << 20):
            groups = co.tile_groups(n_tiles, 128, held)
            pairs = [p for g in groups for p in g]
            assert sorted(pairs) == [(a, b) for a in range(n_tiles) for b in range(a, n_tiles)]
            assert max(map(len, groups)) <= max(1, held // (128 * 128 * 48))


def test_wide_table(spark):
    """2,000 columns: several scans, pairs above the threshold only."""
    pdf = sensors(40, 2000, 3)
    df = spark.createDataFrame(pdf.where(pdf.notna(), None).astype(object).astype(float))
    df = df.selectExpr(*[f"nanvl({c}, NULL) AS {c}" for c in pdf.columns])
    assert len(co.tile_groups(16, co.TILE, co.HELD_BYTES)) > 1
    got = {(r.feature_1, r.feature_2) for r in co.pairwise_correlation(df, list(pdf.columns), 0.8).collect()}
    corr = np.abs(pdf.corr().to_numpy())
    i, j = np.nonzero(np.triu(corr > 0.8, 1))
    assert got == {(pdf.columns[a], pdf.columns[b]) for a, b in zip(i, j)}
