"""Parquet tables of a study folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table; filters and column selections reach the files."""
    return spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
