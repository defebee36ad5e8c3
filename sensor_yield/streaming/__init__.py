"""Streaming.

The reference pipeline is batch only: no stream source, watermark, window or
state exists in it, so there is no streaming operator to rebuild here. The one
stream-ready piece is scoring: every fitted stage of this package is a stateless
column expression after ``fit``, so a fitted ``PipelineModel`` applies unchanged
to a streaming DataFrame (see ``score_stream``).
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from sensor_yield.operators.models import positive_probability


def score_stream(model: PipelineModel, stream: DataFrame, id_col: str = "row_id") -> DataFrame:
    """Stateless scoring of a streaming (or batch) DataFrame with a fitted model."""
    return model.transform(stream).select(id_col, positive_probability().alias("fail_probability"))
