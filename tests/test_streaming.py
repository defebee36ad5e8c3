"""A fitted model scores a streaming DataFrame unchanged (stateless stages)."""

from __future__ import annotations

import os
import tempfile

import numpy as np
import pandas as pd

from sensor_yield.operators.models import build_candidates
from sensor_yield.streaming import score_stream


def test_score_stream_matches_batch(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = rng.normal(size=(n, 4))
    pdf = pd.DataFrame(x, columns=[f"feature_{i:03d}" for i in range(4)])
    pdf.insert(0, "Pass_Fail", (x[:, 0] > 1.0).astype(int))
    pdf.insert(0, "row_id", np.arange(n))
    df = spark.createDataFrame(pdf)
    model = {c.name: c for c in build_candidates()}["Baseline_LogisticRegression"].build({"C": 1.0}).fit(df)
    src = tempfile.mkdtemp(prefix="sensor-yield-stream-")
    df.write.mode("overwrite").parquet(os.path.join(src, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(src, "in"))
    q = (score_stream(model, stream).writeStream.format("memory").queryName("scored_stream")
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT * FROM scored_stream").toPandas().sort_values("row_id")
    exp = score_stream(model, df).toPandas().sort_values("row_id")
    assert len(got) == n
    assert np.allclose(got["fail_probability"].to_numpy(), exp["fail_probability"].to_numpy())
