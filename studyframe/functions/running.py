"""Ordered totals and exact quantiles without a single-partition sort.

``running_totals`` is the base of every rank statistic in the package. It sees only distinct values
(ties collapse in the map-side aggregation), cuts the value axis of each key into buckets of bounded
size, orders each bucket on its own and adds the totals of the lower buckets. Buckets depend on values
only, never on partition numbers, so recomputed or coalesced partitions give the same answer.

``exact_quantiles`` counts cells of the value axis and descends into the one that holds the wanted row.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import join_small, kept

# Distinct values of one key up to which one ordered window is used; also the aimed size of a bucket.
ROWS_PER_BUCKET = 2_000_000
# Lines of a bucket, about, that are looked at for cut points.
DRAWN_PER_BUCKET = 2_000
# Cut points are looked up in two steps of at most this many comparisons.
CUT_STEP = 64
# Rows of a value range that one task may order when quantiles are picked, and the cells into which a larger one is cut.
RANGE_ROWS = 1_000_000
CELLS = 4096


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Row count of the largest key (map-side counts; nothing is collected but one number)."""
    if not keys:
        return df.count()
    row = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return int(row["n"] or 0)


def _with_bucket(lines: DataFrame, keys: Sequence[str], value: str, buckets: int, per_bucket: int) -> DataFrame:
    """Lines of distinct (keys, value) with ``_bucket``, which rises with the value.

    The cut points come from lines drawn by a hash of key and value, so that they cost next to nothing however many
    keys there are; they decide how evenly the buckets are filled, never a result. A key without a drawn line is one bucket.
    """
    steps = max(2, math.ceil(math.sqrt(buckets)))
    steps = min(steps, CUT_STEP)
    total = steps * steps
    probs = [i / total for i in range(1, total)]
    drawn = lines.where(F.pmod(F.xxhash64(*keys, value), F.lit(max(1, per_bucket // DRAWN_PER_BUCKET))) == 0)
    cuts = drawn.groupBy(*keys).agg(F.percentile_approx(value, probs, 4 * total).alias("_cuts"))
    coarse = F.transform(F.sequence(F.lit(1), F.lit(steps - 1)), lambda i: F.element_at("_cuts", i * steps))
    cuts = cuts.select(*keys, "_cuts", coarse.alias("_coarse"))
    placed = join_small(lines, cuts, keys, "left", width=2 * total)
    v = F.col(value)
    outer = F.size(F.filter("_coarse", lambda c: c < v))
    placed = placed.withColumn("_outer", outer)
    inner = F.size(F.filter(F.slice("_cuts", F.col("_outer") * steps + 1, F.lit(steps - 1)), lambda c: c < v))
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(F.col("_outer") * steps + inner)
    return placed.withColumn("_bucket", bucket).drop("_cuts", "_coarse", "_outer")


def distinct_totals(df: DataFrame, keys: Sequence[str], value: str, sums: Mapping[str, Column] | None = None) -> DataFrame:
    """One line per distinct (keys, value) with the sums of ``running_totals``, kept; rows whose value is NULL are left out."""
    amounts = dict(sums) if sums else {"cnt": F.lit(1).cast("bigint")}
    rows = df.where(F.col(value).isNotNull()).select(*keys, value, *[amount.alias(name) for name, amount in amounts.items()])
    return kept(rows.groupBy(*keys, value).agg(*[F.sum(name).alias(name) for name in amounts]))


def running_totals(
    df: DataFrame | None,
    keys: Sequence[str],
    value: str,
    sums: Mapping[str, Column] | None = None,
    ascending: bool = True,
    rows_per_bucket: int | None = None,
    largest: int | None = None,
    distinct: DataFrame | None = None,
) -> DataFrame:
    """One row per distinct (keys, value) with totals at the value and before it.

    ``sums`` maps names to per-row amounts (default: ``cnt`` = 1). The result has ``<name>`` and
    ``before_<name>``; rows whose value is NULL are left out. ``largest`` may give a known upper bound
    of the rows per key. Beyond ``rows_per_bucket``, or if it is not known, the rows are read once and
    their distinct values kept: those are counted, cut and ordered. A caller that has them already, from
    ``distinct_totals``, gives them as ``distinct`` with the names of the sums; ``df`` is not read then.
    """
    rows_per_bucket = rows_per_bucket or ROWS_PER_BUCKET
    amounts = dict(sums) if sums else {"cnt": F.lit(1).cast("bigint")}
    keys = list(keys)
    order = F.col(value).asc() if ascending else F.col(value).desc()
    if distinct is not None:
        distinct = distinct.select(*keys, value, *amounts)
        largest = largest_group(distinct, keys) if largest is None else largest
    elif largest is None or largest > rows_per_bucket:
        distinct = distinct_totals(df, keys, value, amounts)
        largest = largest_group(distinct, keys)
    else:
        rows = df.where(F.col(value).isNotNull()).select(*keys, value, *[amount.alias(name) for name, amount in amounts.items()])
        distinct = rows.groupBy(*keys, value).agg(*[F.sum(name).alias(name) for name in amounts])
    if largest <= rows_per_bucket:
        before = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
        before = before.orderBy(order).rowsBetween(W.unboundedPreceding, -1)
        return distinct.select(
            "*", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"before_{n}") for n in amounts]
        )
    placed = _with_bucket(distinct, keys, value, math.ceil(largest / rows_per_bucket), rows_per_bucket)
    per_bucket = placed.groupBy(*keys, "_bucket").agg(*[F.sum(n).alias(f"_t_{n}") for n in amounts])
    bucket_order = F.col("_bucket").asc() if ascending else F.col("_bucket").desc()
    lower = (W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))).orderBy(bucket_order)
    lower = lower.rowsBetween(W.unboundedPreceding, -1)
    offsets = per_bucket.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{n}").over(lower), F.lit(0)).alias(f"_o_{n}") for n in amounts]
    )
    inside = W.partitionBy(*keys, "_bucket").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    ordered = placed.select(
        "*", *[F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(f"_i_{n}") for n in amounts]
    )
    joined = join_small(ordered, offsets, [*keys, "_bucket"])
    return joined.select(
        *keys,
        value,
        *amounts,
        *[(F.col(f"_o_{n}") + F.col(f"_i_{n}")).alias(f"before_{n}") for n in amounts],
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, ascending: bool = True, **kw) -> DataFrame:
    """Distinct (keys, value) with ``cnt`` and the average rank of the tied rows."""
    totals = running_totals(df, keys, value, ascending=ascending, **kw)
    return totals.withColumn("avg_rank", F.col("before_cnt") + (F.col("cnt") + 1) / F.lit(2.0))


def _exponent(v: Column) -> Column:
    """A number that rises with v: sign and binary exponent, at most some 4,200 of them; infinities and NaN at the ends."""
    plain = F.signum(v) * (F.floor(F.log2(F.abs(v))) + 1100)
    ends = F.when(F.isnan(v), 6000).when(F.abs(v) == float("inf"), F.signum(v) * 5000).when(v == 0, 0)
    return ends.otherwise(plain).cast("int")


def _in_ranges(rows: DataFrame, ranges: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Rows whose value lies in one of their key's ranges (disjoint, from _lo to _hi), with that range's _lo, _hi and _start."""
    ordered = F.array_sort(F.collect_list(F.struct("_start", "_lo", "_hi")))
    lists = ranges.groupBy(*keys).agg(ordered.alias("_all")).select(*keys, *(F.col(f"_all.{c}").alias(f"{c}s") for c in ("_start", "_lo", "_hi")))
    placed = join_small(rows, lists, keys, width=3 * width)
    inside = lambda i: (F.col("_v") >= F.get("_los", i)) & (F.col("_v") <= F.get("_his", i))
    at = F.get(F.filter(F.sequence(F.lit(0), F.size("_starts") - 1), inside), F.lit(0))
    placed = placed.withColumn("_at", at).where("_at is not null")
    return placed.select(*keys, "_v", *(F.get(f"{c}s", F.col("_at")).alias(c) for c in ("_start", "_lo", "_hi")))


def _picked(lines: DataFrame, counted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, _start and _r of lines, with the one of counted (keys, _start, order, _c, ...) that holds row _r of its range.

    Wanted rows are ordered among the counted ones by place and take what stands last before them: the work grows with
    the sum of both, not with their product."""
    before = W.partitionBy(*keys, "_start").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    counted = counted.withColumn("_first", F.col("_start") + F.coalesce(F.sum("_c").over(before), F.lit(0)))
    facts = [c for c in counted.columns if c not in (*keys, "_start")]
    held = counted.select(*keys, "_start", F.col("_first").alias("_at"), F.lit(0).alias("_wanted"), F.struct(*facts).alias("_facts"))
    asked = lines.select(*keys, "_start", F.col("_r").alias("_at"), F.lit(1).alias("_wanted"), F.lit(None).cast(held.schema["_facts"].dataType).alias("_facts"))
    upto = W.partitionBy(*keys, "_start").orderBy("_at", "_wanted").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = held.unionByName(asked).withColumn("_facts", F.last("_facts", ignorenulls=True).over(upto)).where("_wanted = 1")
    return found.select(*keys, "_start", F.col("_at").alias("_r"), *(F.col("_facts")[c].alias(c) for c in facts))


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], out: str = "quantiles", limit: int | None = None
) -> DataFrame:
    """Linearly interpolated quantiles per key as an array column, plus ``n``.

    The rows that answer are found by repeated narrowing. A range of values, at first all of a key's, is cut by
    binary exponent and from then on into CELLS equal cells; counts per cell tell which cell holds a wanted row, and
    its smallest and largest value are the next range. That ends, after six counts at most, where a range holds one
    value, however often, or at most ``limit`` rows, which one task orders as distinct values. A key whose distinct values
    are that few, by an estimate, is not narrowed but ordered at once, however many rows it has. NaN counts as the
    largest value; rows whose value is NULL are left out.
    """
    limit = RANGE_ROWS if limit is None else limit
    keys, probs = list(keys), [float(p) for p in probs]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sizes = kept(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.approx_count_distinct("_v").alias("_d")))
    wanted = F.transform(F.lit(probs), lambda p: p * (F.col("n") - 1))
    ranks = F.array_distinct(F.concat(F.transform(wanted, lambda p: F.floor(p).cast("bigint")), F.transform(wanted, lambda p: F.ceil(p).cast("bigint"))))
    lines = sizes.where("n > 0").select(*keys, F.explode(ranks).alias("_r"), F.lit(0).cast("bigint").alias("_start"), F.col("n").alias("_c"), "_lo", "_hi", "_d")
    wide = (F.col("_c") > limit) & (F.col("_lo") < F.col("_hi"))
    single = F.col("_lo") == F.col("_hi")
    # The estimate is off by 5 %; a quarter more leaves room for that.
    whole = ~single & (~wide | (F.col("_d") * 1.25 <= limit))
    at_once = lines.where(whole).drop("_d")
    lines = lines.where(~whole).drop("_d")
    cell = _exponent(F.col("_v"))
    while lines.where(wide).limit(1).count():
        ranges = lines.where(wide).select(*keys, "_start", "_lo", "_hi").distinct()
        inside = _in_ranges(rows, ranges, keys, 2 * len(probs))
        counted = inside.groupBy(*keys, "_start", cell.alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
        found = _picked(lines.where(wide).drop("_c"), counted.withColumnRenamed("_n", "_c"), keys, "_cell")
        found = found.select(*keys, "_r", F.col("_first").alias("_start"), "_c", F.col("_least").alias("_lo"), F.col("_most").alias("_hi"))
        lines = kept(lines.where(~wide).unionByName(found))
        share = (F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        cell = F.least(F.floor(share * CELLS), F.lit(CELLS - 1)).cast("int")
    several = lines.where(~single)
    inside = _in_ranges(rows, several.select(*keys, "_start", "_lo", "_hi").distinct(), keys, 2 * len(probs))
    inside = inside.select(*keys, "_start", "_v").unionByName(join_small(rows, at_once.select(*keys, "_start").distinct(), keys).select(*keys, "_start", "_v"))
    distinct = inside.groupBy(*keys, "_start", "_v").agg(F.count(F.lit(1)).alias("_n")).withColumnRenamed("_n", "_c")
    values = _picked(several.unionByName(at_once).drop("_c"), distinct, keys, "_v").select(*keys, "_r", F.col("_v").alias("_x"))
    values = lines.where(single).select(*keys, "_r", F.col("_lo").alias("_x")).unionByName(values)
    values = values.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_r", "_x"))).alias("_all"))
    values = values.select(*keys, F.col("_all._r").alias("_rs"), F.col("_all._x").alias("_xs"))
    full = join_small(sizes.select(*keys, "n"), values, keys, "left", width=4 * len(probs))

    def answer(p: Column) -> Column:
        at = lambda rank: F.get("_xs", (F.array_position("_rs", rank.cast("bigint")) - 1).cast("int"))
        low, high = at(F.floor(p)), at(F.ceil(p))
        return F.when(low == high, low).otherwise(low + (high - low) * (p - F.floor(p)))

    return full.select(*keys, F.when(F.col("n") > 0, F.transform(wanted, answer)).alias(out), "n")
