"""Scoring of arriving samples with a stored model (stateless)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from studyframe.operators.cv import score_batch
from studyframe.operators.labels import threshold_class


def stream_score(stream: DataFrame, model: PipelineModel, features: Sequence[str], keep: Sequence[str] = (), boundaries: tuple[float, float] | None = None) -> DataFrame:
    """Predictions, and the class of the prediction when boundaries are given."""
    out = score_batch(model, stream, features, keep)
    if boundaries:
        out = out.withColumn("predicted_class", threshold_class(F.col("prediction"), F.lit(boundaries[0]), F.lit(boundaries[1])))
    return out
