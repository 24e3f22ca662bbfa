"""Column expressions shared by the operators. Everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

# Largest frame, in rows, that may be offered to every executor.
SMALL_ROWS = 200_000
# Copies of one row that a single task expands in ``with_row_id``.
COPIES_PER_TASK = 100_000

NUMERIC_TEXT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


# Moves exact decimal ties (means of prices, say) off the rounding edge, where the order of a sum decides.
NUDGE = 3.1415927e-9


def rounded(column: Column | str, digits: int = 6, nudge: float = 0.0) -> Column:
    """Round and turn -0.0 into 0.0, so that values compare equal across engines."""
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column + F.lit(nudge) if nudge else column, digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    return df.select(
        *[
            rounded(F.col(f"`{f.name}`"), digits, nudge).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def steady(df: DataFrame, digits: int = 6) -> DataFrame:
    """Rounding for columns that may hold exact decimal ties."""
    return round_doubles(df, digits, NUDGE)


def finite(column: Column) -> Column:
    """NULL for NaN and both infinities."""
    return F.when(F.isnan(column) | (F.abs(column) == F.lit(float("inf"))), None).otherwise(column)


def as_double(column: Column, dtype: T.DataType) -> Column:
    """Lenient numeric cast: unreadable text becomes NULL, and so do NaN and the infinities."""
    if isinstance(dtype, T.StringType):
        text = F.trim(column)
        return finite(F.when(text.rlike(NUMERIC_TEXT), text.try_cast("double")))
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return finite(column.cast("double"))
    if isinstance(dtype, (T.NumericType, T.BooleanType)):
        return column.cast("double")
    return F.lit(None).cast("double")


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def text_key(*parts: Column | str) -> Column:
    """The parts as text joined by ``|``; parts must be integers or strings."""
    return F.concat_ws("|", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])


def draw32(*parts: Column | str) -> Column:
    """Repeatable draw in [0, 2**32) from the leading 32 bits of an md5."""
    return F.conv(F.substring(F.md5(text_key(*parts)), 1, 8), 16, 10).cast("bigint")


def draw_unit(*parts: Column | str) -> Column:
    """Repeatable draw in (0, 1)."""
    return (draw32(*parts).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark ``df`` for broadcasting if counting shows at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows. Beyond the bound the frame is returned as it is, so
    the caller's join becomes a shuffled one (adaptive execution splits its skewed partitions).
    The frame is kept so that the check and the join compute it once; lost parts are recomputed.
    """
    held = kept(df)
    return F.broadcast(held) if held.limit(max_rows + 1).count() <= max_rows else held


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan that has fewer parts than the cluster has cores over all cores.

    Large tables arrive in many parts and are returned as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def kept(df: DataFrame) -> DataFrame:
    """Keep a frame that several jobs read, in memory and else on disk; lost parts are recomputed."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def join_small(rows: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", width: int = 1) -> DataFrame:
    """Join rows to a (usually small) frame on null-safe equal keys.

    ``width`` tells how many values an array column of ``small`` holds; the row bound shrinks with it.
    """
    names = list(on)
    if not names:
        # ``small`` holds one row of totals: its values become constants, so no join is planned.
        found = small.limit(1).collect()
        if not found and how == "inner":
            return rows.where(F.lit(False)).withColumns({f.name: F.lit(None).cast(f.dataType) for f in small.schema.fields})
        value = lambda f: F.lit(found[0][f.name]) if found else F.lit(None)
        return rows.withColumns({f.name: value(f).cast(f.dataType) for f in small.schema.fields})
    side = small_side(small, max(1, SMALL_ROWS // width))
    renamed = side
    for name in names:
        renamed = renamed.withColumnRenamed(name, f"_k_{name}")
    condition = None
    for name in names:
        term = F.col(name).eqNullSafe(F.col(f"_k_{name}"))
        condition = term if condition is None else condition & term
    return rows.join(renamed, condition, how).drop(*[f"_k_{name}" for name in names])


def with_row_id(df: DataFrame, out: str = "row_id", hash_cols: Sequence[Column] | None = None) -> DataFrame:
    """Give each row an identity: md5 of its columns plus an occurrence number among identical rows.

    Identical rows are interchangeable, so they are counted (partial aggregation collapses even a row
    with billions of copies) and expanded again, where they were counted. Only a row with more than COPIES_PER_TASK
    copies moves once more: in chunks of that size, so no task has to emit all copies of a hot row.
    """
    columns = df.columns
    parts = list(hash_cols) if hash_cols is not None else [F.col(f"`{c}`") for c in columns]
    counted = df.groupBy(*[F.col(f"`{c}`") for c in columns]).agg(F.count(F.lit(1)).alias("_copies"))
    keyed = counted.withColumn("_hash", F.md5(text_key(*parts)))
    few = keyed.where(F.col("_copies") <= COPIES_PER_TASK).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))))
    chunks = keyed.where(F.col("_copies") > COPIES_PER_TASK).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_copies") - 1) / COPIES_PER_TASK)))
    ).repartition(F.col("_hash"), F.col("_chunk"))
    first = F.col("_chunk") * COPIES_PER_TASK + 1
    last = F.least(F.col("_copies"), first + (COPIES_PER_TASK - 1))
    numbered = few.unionByName(chunks.withColumn("_copy", F.explode(F.sequence(first, last))).drop("_chunk"))
    identity = F.concat_ws("#", F.col("_hash"), F.col("_copy").cast("string"))
    return numbered.select(identity.alias(out), *[F.col(f"`{c}`") for c in columns])


def safe_name(name: str) -> str:
    """Column or file name with only letters, digits, dot, underscore and hyphen."""
    import re

    return re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_") or "column"


def safe_file_name(column: Column) -> Column:
    return F.regexp_replace(column, r"[^A-Za-z0-9._-]+", "_")


def name_key(name: str) -> str:
    """Form of a column name used for tolerant matching."""
    return "".join(ch for ch in unicodedata.normalize("NFKC", str(name)).casefold() if ch.isalnum())


def model_name_parts(file: Column) -> tuple[Column, Column, Column]:
    """``model_fs_target.ext`` -> the three parts; NULLs when the name does not have three parts."""
    stem = F.regexp_replace(F.element_at(F.split(file, "/"), -1), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    ok = F.size(parts) >= 3
    best = stem.startswith("best")
    model = F.when(best, F.lit("best")).when(ok, F.get(parts, F.lit(0)))
    fs = F.when(~best & ok, F.get(parts, F.lit(1)))
    target = F.when(~best & ok, F.array_join(F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(1))), "_"))
    return model, fs, target


def mean_sd_cell(mean: Column, sd: Column, digits: int = 3) -> Column:
    """``mean ± sd`` as text; ``NA`` where the mean is missing."""
    number = f"%.{digits}f"
    return (
        F.when(mean.isNull(), F.lit("NA"))
        .when(sd.isNull(), F.format_string(number, mean))
        .otherwise(F.format_string(f"{number} ± {number}", mean, sd))
    )


def joined_sorted(column: Column, separator: str = " | ") -> Column:
    """Distinct texts of a group, sorted and joined (aggregate)."""
    return F.array_join(F.array_sort(F.collect_set(column)), separator)


def cols(names: Iterable[str]) -> list[Column]:
    return [F.col(f"`{n}`") for n in names]
