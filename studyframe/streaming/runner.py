"""Bounded runs of a stream: everything available now, to files."""

from __future__ import annotations

from pyspark.sql import DataFrame


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Process what has arrived, wait, and read the written rows back."""
    query = (
        stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
