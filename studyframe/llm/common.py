"""Shared pieces: the shared folder, small tables kept between jobs, joins that stand hot keys."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What counts as white space between words, as a character class of Java and DuckDB patterns.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot if it holds more than one in HOT_SHARE of all rows. So at most HOT_SHARE keys are hot.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; one of our own only where that is unset and Spark runs in one process."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not folder and not context.getCheckpointDir():
        if not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="studyframe-shared-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return (folder or context.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on; Spark removes the files with the last use."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """df as a Parquet table in the shared folder; options are those of the writer. For loops: what the planner infers about a checkpoint grows with
    every round, and a file's size is known when the next join is planned."""
    folder = new_folder(df.sparkSession, name)
    df.write.options(**options).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside hand long rows to Python so many at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. In texts without other letters, which are most, that is lower()."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, spread: str) -> DataFrame:
    """rows left-joined to groups, which has one line per key and in `size` the number of rows with that key.

    A key may hold a third of all rows. The lines of hot keys, HOT_SHARE at most by their definition, are
    broadcast; rows that found theirs are dealt out by `spread` for the second join, where they match nothing.
    Rows whose key is null find nothing and are dealt out too.
    """
    more = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) * HOT_SHARE > F.lit(total)).select(F.col(key).alias("_hot_key"), F.struct(*more).alias("_hot"))
    cold = groups.where(F.col(size) * HOT_SHARE <= F.lit(total)).select(F.col(key).alias("_cold_key"), F.lit(0).alias("_cold_salt"), F.struct(*more).alias("_cold"))
    first = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot_key"), "left")
    away = F.col("_hot_key").isNotNull() | F.col(key).isNull()
    first = first.withColumn("_salt", F.when(away, F.lit(1) + F.pmod(F.xxhash64(spread), F.lit(100_000)).cast("int")).otherwise(F.lit(0)))
    both = first.join(cold, (F.col(key) == F.col("_cold_key")) & (F.col("_salt") == F.col("_cold_salt")), "left")
    found = F.coalesce(F.col("_hot"), F.col("_cold"))
    return both.select(*(F.col(c) for c in rows.columns), *(found[c].alias(c) for c in more))


def packed(docs: DataFrame) -> DataFrame:
    """_row, _key: whole rows in one column, and their doc_id, so that no column's name is in the way of a join."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("doc_id").cast("long").alias("_key"))


def unpacked(rows: DataFrame, columns: list[str], **instead: Column) -> DataFrame:
    """The columns of packed rows, some of them replaced."""
    return rows.select(*(instead[c].alias(c) if c in instead else F.col("_row")[c].alias(c) for c in columns))
