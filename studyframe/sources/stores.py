"""Splits, models, reports and fingerprints on shared storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F

from studyframe.functions.columns import safe_name


def write_split(df: DataFrame, path: str, target: str, feature_set: str, features: Sequence[str], y: str, key: str = "row_id", group: str | None = None) -> None:
    """Rows of one study pair below ``data/target=/feature_set=/split=`` and its line in the manifest.

    The folder of this pair is replaced as a whole, so a part that the new run lacks is gone too; other pairs stay.
    """
    rows = df.select(
        F.col(key).alias("source_row_index"), *[F.col(f"`{f}`") for f in features], F.col(y).cast("double").alias("y"), *([F.col(group).alias("group_key")] if group else []),
        F.lit(target).alias("target"), F.lit(feature_set).alias("feature_set"), F.col("split"),
    )
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "static")
    writer.partitionBy("target", "feature_set", "split").parquet(f"{path}/data/{safe_name(target)}__{safe_name(feature_set)}")
    sizes = rows.groupBy("target", "feature_set").agg(
        F.count_if(F.col("split") == "train").alias("n_train"), F.count_if(F.col("split") == "test").alias("n_test"), F.lit("|".join(features)).alias("features"),
        F.current_timestamp().alias("written_at"),
    )
    manifest = sizes.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    manifest.partitionBy("target", "feature_set").parquet(f"{path}/manifest")


def read_split(spark: SparkSession, path: str, target: str, feature_set: str, split: str | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/data/{safe_name(target)}__{safe_name(feature_set)}").where((F.col("target") == target) & (F.col("feature_set") == feature_set))
    return rows.where(F.col("split") == split) if split else rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/manifest")


def save_model(model: PipelineModel, meta: Mapping[str, object], path: str, spark: SparkSession) -> None:
    """Fitted pipeline and its description (features, target, boundaries, parameters, policy)."""
    for needed in ("features", "target"):
        if needed not in meta:
            raise ValueError(f"model description lacks {needed}")
    model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame([(json.dumps(meta, default=str),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_model(path: str, spark: SparkSession) -> tuple[PipelineModel, dict]:
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return PipelineModel.load(f"{path}/model"), meta


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """csv (with header), json (records) or parquet."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown report format {fmt}")


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count, xor and sum of row hashes: equal for equal content in any order."""
    names = sorted(df.columns)
    row = F.md5(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in names]))
    part = lambda start: F.conv(F.substring(row, start, 15), 16, 10).cast("bigint")
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.bit_xor(part(1)), F.lit(0)).alias("xor_hash"),
        F.coalesce(F.sum(F.pmod(part(16), F.lit(2**31)).cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").alias("sum_hash"), F.lit(",".join(names)).alias("columns"),
    )


def file_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
