"""Order of rows by hash: exact-size random choices that never sort or move all rows.

A row's md5 is uniform, so its leading hex digits cut any stratum into even buckets, however skewed
the strata are. To choose the k smallest hashes of a stratum only the bucket that holds the k-th hash
has to be ordered; all other rows are decided by comparing their own hash with the cut. While that bucket
is too large for a task, it is cut again by its next digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import join_small, kept

# Hex digits by which a bucket is cut, and the rows of a bucket that one task may order.
PREFIX_DIGITS = 3
EDGE_ROWS = 200_000


def hash_cuts(
    df: DataFrame, part: Sequence[str], hash_col: str, positions: Column, digits: int = PREFIX_DIGITS, extra: DataFrame | None = None, bound: int | None = None
) -> DataFrame:
    """Hashes at given ranks, per part.

    ``positions`` is an array expression over the column ``n`` (rows in the part), the columns of
    ``part`` and those of ``extra`` (one line per part): the wanted 1-based ranks in hash order; ranks
    < 1 yield no cut. Returns
    ``part, n, cuts`` with ``cuts`` the sorted array of hashes; hashes must be unique within a part.
    No task orders more than ``bound`` rows.
    """
    part, bound = list(part), EDGE_ROWS if bound is None else bound
    rows = df.select(*part, F.col(hash_col).alias("_h"))
    within = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    upto = lambda window, order: F.sum("_c").over(window.orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    counts = rows.groupBy(*part, F.substring("_h", 1, digits).alias("_prefix")).agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumns({"_upto": upto(within, "_prefix"), "n": F.sum("_c").over(within)})
    if extra is not None:
        counts = join_small(counts, extra, part)
    before = F.col("_upto") - F.col("_c")
    lines = counts.withColumn("_rank", F.explode(positions)).where((F.col("_rank") > before) & (F.col("_rank") <= F.col("_upto")))
    lines = kept(lines.select(*part, "n", "_prefix", "_c", (F.col("_rank") - before).alias("_nth")))
    length = digits
    while (lines.agg(F.max("_c")).first()[0] or 0) > bound:
        inside = join_small(rows.withColumn("_prefix", F.substring("_h", 1, length)), lines.select(*part, "_prefix").distinct(), [*part, "_prefix"])
        length += digits
        cut = inside.groupBy(*part, "_prefix", F.substring("_h", 1, length).alias("_next")).agg(F.count(F.lit(1)).alias("_c"))
        cut = cut.withColumn("_upto", upto(W.partitionBy(*part, "_prefix"), "_next"))
        cut = cut.select(*(F.col(c).alias(f"_k_{c}") for c in (*part, "_prefix")), "_next", "_c", "_upto")
        holds = (F.col("_nth") > before) & (F.col("_nth") <= F.col("_upto"))
        for c in (*part, "_prefix"):
            holds = holds & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        lines = kept(lines.drop("_c").join(cut, holds).select(*part, "n", F.col("_next").alias("_prefix"), "_c", (F.col("_nth") - before).alias("_nth")))
    wanted = lines.groupBy(*part, "_prefix", "n").agg(F.array_sort(F.collect_set("_nth")).alias("_nths"))
    edge = join_small(rows.withColumn("_prefix", F.substring("_h", 1, length)), wanted, [*part, "_prefix"])
    nth = F.row_number().over(W.partitionBy(*part, "_prefix").orderBy("_h"))
    cuts = edge.withColumn("_nth", nth.cast("bigint")).where(F.array_contains("_nths", F.col("_nth")))
    return cuts.groupBy(*part, "n").agg(F.array_sort(F.collect_set("_h")).alias("cuts"))


def pieces_by_hash(
    df: DataFrame, part: Sequence[str], hash_col: str, positions: Column, out: str, extra: DataFrame | None = None
) -> DataFrame:
    """Add ``out`` = number of cuts below the row's hash (0 for the first piece)."""
    cuts = hash_cuts(df, part, hash_col, positions, extra=extra)
    joined = join_small(df, cuts.select(*part, "cuts"), list(part), "left")
    piece = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col(hash_col))), F.lit(0))
    return joined.withColumn(out, piece.cast("int")).drop("cuts")
