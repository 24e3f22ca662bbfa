"""Delimited text with tolerant headers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

SEPARATORS = (",", "\t", ";")


def clean_header(name: str) -> str:
    return name.replace("\ufeff", "").strip().strip('"').strip()


def sniff_separator(spark: SparkSession, path: str) -> str:
    """By extension; otherwise the most frequent separator of the first line."""
    lowered = path.lower()
    if lowered.endswith(".csv"):
        return ","
    if lowered.endswith((".tsv", ".tab")):
        return "\t"
    first = spark.read.text(path).limit(1).collect()
    line = first[0]["value"] if first else ""
    return max(SEPARATORS, key=line.count)


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Table with a header line; columns are text unless a schema is given (nothing is inferred by a scan)."""
    reader = spark.read.option("header", True).option("sep", sniff_separator(spark, path)).option("multiLine", False)
    frame = reader.schema(schema).csv(path) if schema else reader.csv(path)
    return frame.toDF(*[clean_header(c) for c in frame.columns])
