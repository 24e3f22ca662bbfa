"""Report files of earlier runs, gathered from folders, and an inventory of what is there."""

from __future__ import annotations

import csv
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from studyframe.functions.columns import join_small
from studyframe.operators.schema import normalize_importances
from studyframe.sources.delimited import clean_header

#: Different header lines of one collection; each is a layout that the driver has to know, however many files share it.
MAX_LAYOUTS = 1_000


def _names(head: str) -> list[str]:
    """Clean column names of a header line; unnamed and repeated ones get their place."""
    found = [clean_header(c) or f"_c{i}" for i, c in enumerate(next(csv.reader([head]), []))]
    seen = [c.lower() for c in found]
    return [f"{c}{i}" if seen.count(c.lower()) > 1 else c for i, c in enumerate(found)]


def _read_all(spark: SparkSession, path: str, pattern: str) -> DataFrame | None:
    """Rows of all files, with ``_path``; a column that a file lacks is null there.

    Files are read line by line, in splits, and the list of files stays on the executors. A file's header is its
    first line that is not blank; lines equal to it are no rows. Lines are parsed once, into as many fields as the
    widest header has, and a field is named by the header of its file.
    """
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_no"), F.regexp_replace("value", "^\ufeff", "").alias("value"))
    lines = lines.where(F.trim("value") != "")
    heads = lines.groupBy("_path").agg(F.min_by("value", F.struct("_start", "_no")).alias("_head"))
    known = heads.select("_head").distinct().limit(MAX_LAYOUTS + 1).collect()
    if not known:
        return None
    if len(known) > MAX_LAYOUTS:
        raise ValueError(f"more than {MAX_LAYOUTS} different headers under {path}")
    layouts = {r["_head"]: _names(r["_head"]) for r in known}
    width = max(len(names) for names in layouts.values())
    table = spark.createDataFrame([(head, [c.lower() for c in names]) for head, names in layouts.items()], "_head string, _names array<string>")
    rows = join_small(lines, heads, ["_path"]).where(F.col("value") != F.col("_head")).join(F.broadcast(table), "_head")
    fields = F.from_csv("value", ", ".join(f"_{i} string" for i in range(width)))
    rows = rows.select("_path", "_names", F.array(*[fields[f"_{i}"] for i in range(width)]).alias("_fields"))
    columns: dict[str, str] = {}
    for head in sorted(layouts):
        for name in layouts[head]:
            columns.setdefault(name.lower(), name)
    # get() beyond the header, at place -1, is null
    return rows.select("_path", *[F.get("_fields", F.array_position("_names", low) - 1).alias(name) for low, name in columns.items()])


def _part(path: Column, back: int) -> Column:
    return F.element_at(F.split(path, "/"), -back)


def collect_reports(spark: SparkSession, path: str, pattern: str = "*_nested_cv_folds.csv") -> DataFrame:
    """All matching files below ``path`` as one table with ``Model`` and ``Feature_Set``."""
    rows = _read_all(spark, path, pattern)
    if rows is None:
        raise FileNotFoundError(f"no file {pattern} below {path}")
    suffix = pattern.lstrip("*").replace(".", r"\.")
    model = F.regexp_replace(_part(F.col("_path"), 1), f"{suffix}$", "")
    return rows.select(model.alias("Model"), _part(F.col("_path"), 2).alias("Feature_Set"), *[F.col(f"`{c}`") for c in rows.columns if c != "_path"])


def collect_importances(spark: SparkSession, path: str, task: str, family: str, pattern: str = "*_permutation_sensitivity.csv") -> DataFrame:
    """Importance files with keys from their path: nearest folder ``fs<number>`` and the folder above it."""
    rows = _read_all(spark, path, pattern)
    if rows is None:
        raise FileNotFoundError(f"no file {pattern} below {path}")
    suffix = pattern.lstrip("*").replace(".", r"\.")
    at = F.col("_path")
    near = r"(?i).*/([^/]+)/(fs[0-9]+)/(?!.*/fs[0-9]+/).*"
    keyed = rows.withColumns(
        {
            "task": F.lit(task), "family": F.lit(family),
            "model": F.upper(F.regexp_replace(_part(at, 1), f"{suffix}$", "")),
            "feature_set": F.when(at.rlike(near), F.upper(F.regexp_extract(at, near, 2))).otherwise("UNKNOWN"),
            "target": F.when(at.rlike(near), F.regexp_extract(at, near, 1)).otherwise("UNKNOWN"),
            "file": at,
        }
    ).drop("_path")
    return normalize_importances(keyed, ["file"])


# Analyses of a study and the files each leaves behind.
ANALYSES = (
    ("Data quality", "data_quality", "*.csv"),
    ("Multicollinearity", "multicollinearity", "*.csv"),
    ("Regression nested CV", "regression/nested_cv", "*_nested_cv_folds.csv"),
    ("Regression learning curves", "regression/learning_curves", "*_learning_curve.csv"),
    ("Regression permutation", "regression/permutation_sensitivity", "*_permutation_sensitivity.csv"),
    ("Classification nested CV", "classification/nested_cv", "*_nested_cv_folds.csv"),
    ("Classification learning curves", "classification/learning_curves", "*_learning_curve.csv"),
    ("Classification permutation", "classification/permutation_sensitivity", "*_permutation_sensitivity.csv"),
)


def analysis_inventory(spark: SparkSession, root: str, analyses: Sequence[tuple[str, str, str]] = ANALYSES) -> DataFrame:
    """Number of result files per analysis below ``root``; the listing is read once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("path")
    hit = lambda folder, pattern: F.col("path").rlike(f"/{folder}/.*{pattern.replace('.', chr(92) + '.').replace('*', '[^/]*')}$")
    row = files.agg(*[F.count_if(hit(folder, pattern)).alias(f"_{i}") for i, (_, folder, pattern) in enumerate(analyses)])
    lines = [F.struct(F.lit(name).alias("analysis"), F.lit(folder).alias("location"), F.col(f"_{i}").alias("files_found")) for i, (name, folder, _) in enumerate(analyses)]
    out = row.select(F.inline(F.array(*lines)))
    return out.withColumn("status", F.when(F.col("files_found") > 0, "Available").otherwise("Not performed / not available"))
