"""Constraint violations per event-time window; late rows are dropped by the watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F, types as T


def stream_quality(stream: DataFrame, rules: Mapping[str, str], ts: str, window: str = "1 hour", delay: str = "10 minutes", by: str | None = None) -> DataFrame:
    """Rows and violations of each rule (name -> SQL condition that marks an offence) per window."""
    counts = [F.count_if(F.coalesce(F.expr(cond), F.lit(False))).alias(name) for name, cond in rules.items()]
    keys = [F.window(ts, window)] + ([F.col(by)] if by else [])
    if isinstance(stream.schema[ts].dataType, T.TimestampNTZType):
        # Watermarks need instants; wall-clock times are read in the session's time zone.
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    out = stream.withWatermark(ts, delay).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *counts)
    return out.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *([by] if by else []), "n", *rules)
