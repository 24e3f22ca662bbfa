"""Holdouts, folds and learning subsets. All choices come from hashes, so they repeat anywhere."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import draw32, join_small, kept, text_key
from studyframe.functions.hashing import hash_cuts, pieces_by_hash
from studyframe.functions.running import running_totals

# (group, class) lines up to which class-balanced group folds are decided on the driver.
GREEDY_GROUPS = 100_000


def order_hash(seed: int, purpose: str, *parts: Column | str) -> Column:
    return F.md5(text_key(F.lit(seed), F.lit(purpose), *parts))


def _test_or_train(column: Column) -> Column:
    return F.when(column == 0, "test").otherwise("train")


def split_random(df: DataFrame, key: str, test: float, seed: int = 42, out: str = "split") -> DataFrame:
    """ceil(test * n) rows to the test part. Rows are compared with one cut; none is moved."""
    rows = df.withColumn("_h", order_hash(seed, "holdout", key))
    done = pieces_by_hash(rows, [], "_h", F.array(F.ceil(F.lit(test) * F.col("n"))), "_piece")
    return done.withColumn(out, _test_or_train(F.col("_piece"))).drop("_h", "_piece")


def _allocation(df: DataFrame, label: str, test: float) -> DataFrame:
    """Test rows per stratum: proportional, the largest remainders get the rows left over."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_size"))
    everything = W.partitionBy(F.lit(0))
    total = F.sum("_size").over(everything)
    want = F.ceil(F.lit(test) * total)
    sizes = sizes.withColumns({"_want": want, "_share": want * F.col("_size") / total})
    sizes = sizes.withColumns({"_base": F.floor("_share"), "_rest": F.round(F.col("_share") - F.floor("_share"), 9)})
    left = F.col("_want") - F.sum("_base").over(everything)
    place = F.row_number().over(everything.orderBy(F.col("_rest").desc(), F.col(label)))
    return sizes.select(label, (F.col("_base") + (place <= left).cast("int")).cast("bigint").alias("_take"))


def split_stratified(df: DataFrame, key: str, label: str, test: float, seed: int = 42, out: str = "split") -> DataFrame:
    """Test part with the class mix of the table; a hot class is decided by its cut like any other."""
    rows = df.withColumn("_h", order_hash(seed, "holdout", key))
    take = _allocation(df, label, test)
    done = pieces_by_hash(rows, [label], "_h", F.array(F.col("_take")), "_piece", extra=take)
    # A stratum from which nothing is taken has no cut.
    done = join_small(done, take, [label])
    return done.withColumn(out, F.when(F.col("_take") > 0, _test_or_train(F.col("_piece"))).otherwise("train")).drop("_h", "_piece", "_take")


def split_grouped(df: DataFrame, group: str, test: float, seed: int = 42, out: str = "split") -> DataFrame:
    """ceil(test * groups) whole groups to the test part; a row needs only its own group's hash."""
    hashed = order_hash(seed, "holdout", group)
    groups = df.select(group).distinct().withColumn("_h", hashed)
    cut = hash_cuts(groups, [], "_h", F.array(F.ceil(F.lit(test) * F.col("n")))).select(F.get("cuts", F.lit(0)).alias("_cut"))
    done = join_small(df.withColumn("_h", hashed), cut, [])
    return done.withColumn(out, F.when(F.col("_h") <= F.col("_cut"), "test").otherwise("train")).drop("_h", "_cut")


def validate_split(
    split: DataFrame, ratios: Sequence[float] = (0.8, 0.2), label: str | None = None, min_rows: int = 20, min_side: int = 10, min_class: int = 5,
    split_col: str = "split", strict: bool = True,
) -> DataFrame:
    """Checks on ratios, sizes and class counts: ``check, value, limit, ok``; error on a failed one."""
    if any(r <= 0 for r in ratios) or abs(sum(ratios) - 1.0) > 1e-9:
        raise ValueError(f"split ratios must be positive and sum to 1: {ratios}")
    sides = split.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    total = sides.agg(F.sum("n").alias("value")).select(F.lit("rows").alias("check"), "value", F.lit(min_rows).alias("limit"))
    parts = sides.select(F.concat(F.lit("rows in "), F.col(split_col)).alias("check"), F.col("n").alias("value"), F.lit(min_side).alias("limit"))
    checks = total.unionByName(parts)
    if label:
        classes = split.groupBy(F.col(label).cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("value"))
        checks = checks.unionByName(classes.select(F.concat(F.lit("rows of class "), F.col("_l")).alias("check"), "value", F.lit(min_class).alias("limit")))
    checks = checks.withColumn("ok", F.col("value") >= F.col("limit"))
    if strict:
        failed = checks.where(~F.col("ok")).limit(5).collect()
        if failed:
            raise ValueError(f"the split is not usable: {[tuple(r) for r in failed]}")
    return checks


def split_report(split: DataFrame, y: str, label: str | None = None, group: str | None = None, split_col: str = "split") -> DataFrame:
    """Sizes, shares, target statistics, groups and classes of each part: ``section, split, key, value``."""
    v = F.col(y)
    aggs = {"n": F.count(F.lit(1)).cast("double"), "mean": F.avg(v), "std": F.stddev_samp(v), "min": F.min(v), "max": F.max(v)}
    if group:
        aggs["groups"] = F.count_distinct(group).cast("double")
    parts = split.groupBy(F.col(split_col).alias("split")).agg(*[e.alias(k) for k, e in aggs.items()])
    total = F.sum("n").over(W.partitionBy(F.lit(0)))
    parts = parts.withColumn("share", F.col("n") / total)
    lines = F.array(*[F.struct(F.lit("part").alias("section"), F.lit(k).alias("key"), F.col(k).alias("value")) for k in [*aggs, "share"]])
    out = parts.select("split", F.inline(lines)).select("section", "split", "key", "value")
    if label:
        classes = split.groupBy(F.col(split_col).alias("split"), F.col(label).cast("string").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("value"))
        out = out.unionByName(classes.select(F.lit("class").alias("section"), "split", "key", "value"))
    return out


# ------------------------------------------------------------------ folds


def _cut_ranks(k: int) -> Column:
    """Ranks that end each of the first k - 1 of k equal pieces."""
    return F.array(*[F.ceil(F.col("n") * F.lit(i) / F.lit(k)) for i in range(1, k)])


def kfold(df: DataFrame, key: str, k: int, seed: int = 42, exact: bool = False, repeat: int = 0, n_rows: int | None = None) -> DataFrame:
    """Fold 0..k-1 per row. By default from the row's hash alone; ``exact`` makes sizes differ by at most 1."""
    if n_rows is not None:
        k = max(2, min(k, n_rows))
    if not exact:
        return df.withColumn("fold", F.pmod(draw32(F.lit(seed), F.lit("fold"), F.lit(repeat), key), F.lit(k)).cast("int"))
    rows = df.withColumn("_h", order_hash(seed, f"fold{repeat}", key))
    return pieces_by_hash(rows, [], "_h", _cut_ranks(k), "fold").drop("_h")


def repeated_kfold(df: DataFrame, key: str, k: int, repeats: int, seed: int = 42) -> DataFrame:
    """k folds for each of ``repeats`` shuffles: a line per row and repeat, without moving rows."""
    numbers = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))
    rows = df.withColumn("repeat", numbers)
    return rows.withColumn("fold", F.pmod(draw32(F.lit(seed), F.lit("fold"), F.col("repeat"), key), F.lit(k)).cast("int"))


def _snake(place: Column, k: int) -> Column:
    lap, at = F.floor(place / k), F.pmod(place, F.lit(k))
    return F.when(lap % 2 == 0, at).otherwise(k - 1 - at).cast("int")


def _size_order(size: Column, seed: int, group: str) -> Column:
    """Number that sorts groups by size (largest first), then by hash."""
    return (F.lit(2**31 - 1).cast("bigint") - F.least(size, F.lit(2**31 - 1).cast("bigint"))) * F.lit(2**32).cast("bigint") + draw32(F.lit(seed), group)


def _row_fallback(df: DataFrame, key: str | None, k: int, seed: int) -> DataFrame:
    if key is None:
        raise ValueError("fewer groups than folds, and no row key to fall back to")
    return kfold(df, key, k, seed)


def _fill(load: list[int], size: int, groups: int) -> list[int]:
    """How many of ``groups`` groups of one size each fold gets when every group goes to the lightest fold (ties: the first).

    A fold offers places at its load, one size more, and so on; the lowest places of all folds are taken. Found by halving
    the load up to which places are taken, so the number of groups does not matter.
    """
    upto = lambda top: [max(0, (top - own) // size + 1) for own in load]
    low, high = min(load) - 1, min(load) + size * groups
    while low < high:
        middle = (low + high + 1) // 2
        low, high = (middle, high) if sum(upto(middle)) <= groups else (low, middle - 1)
    taken = upto(low)
    over = groups - sum(taken)
    for fold, more in enumerate(upto(low + 1)):
        if over and more > taken[fold]:
            taken[fold], over = more, over - 1
    return taken


def _folds_by_size(sizes: DataFrame, group: str, k: int, seed: int) -> DataFrame:
    """Fold of each group: sizes from the largest down, each group to the lightest fold.

    Groups of equal size are interchangeable, so the driver needs one line per distinct size (at most the root of twice the
    rows) and decides how many of them each fold gets; a hash of the group decides which.
    """
    runs = sizes.groupBy("_size").agg(F.count(F.lit(1)).alias("groups")).collect()
    load, ends = [0] * k, []
    for run in sorted(runs, key=lambda r: -r["_size"]):
        taken = _fill(load, run["_size"], run["groups"])
        load = [own + run["_size"] * got for own, got in zip(load, taken)]
        ends.append((run["_size"], np.cumsum(taken)[:-1].tolist()))
    table = sizes.sparkSession.createDataFrame(ends, "_size bigint, _ends array<bigint>")
    hashed = sizes.withColumn("_h", order_hash(seed, "groups", F.col(group)))
    cuts = hash_cuts(hashed, ["_size"], "_h", F.array_distinct("_ends"), extra=table)
    placed = join_small(join_small(hashed, table, ["_size"], width=k), cuts.select("_size", "cuts"), ["_size"], "left", width=k)
    # Ends in a cut list are distinct and above zero: a fold whose end is zero, or equals the one before, has no group.
    below = F.coalesce(F.size(F.filter("cuts", lambda c: c < F.col("_h"))), F.lit(0))
    marks = F.filter(F.array_sort(F.array_distinct("_ends")), lambda e: e > 0)
    reached = F.coalesce(F.get(marks, below - 1), F.lit(0))
    fold = F.when(below == 0, F.size(F.filter("_ends", lambda e: e <= 0))).otherwise(F.size(F.filter("_ends", lambda e: e <= reached)))
    return placed.select(group, fold.cast("int").alias("fold"))


def group_kfold(df: DataFrame, group: str, k: int, mode: str = "greedy", seed: int = 42, key: str | None = None) -> DataFrame:
    """Whole groups to k folds of similar size.

    ``greedy`` puts the largest remaining group on the lightest fold, for any number of groups; ``snake`` deals the groups
    in order of size back and forth. With fewer groups than folds rows are folded by ``key``. A missing group is a group.
    """
    sizes = kept(df.groupBy(group).agg(F.count(F.lit(1)).alias("_size")))
    if sizes.limit(k).count() < k:
        return _row_fallback(df, key, k, seed)
    if mode == "greedy":
        return join_small(df, _folds_by_size(sizes, group, k, seed), [group])
    numbered = sizes.withColumn("_v", _size_order(F.col("_size"), seed, group))
    places = running_totals(numbered.select("_v"), [], "_v").select("_v", F.col("before_cnt").alias("_place"))
    table = join_small(numbered, places, ["_v"]).select(group, _snake(F.col("_place"), k).alias("fold"))
    return join_small(df, table, [group])


def stratified_kfold(df: DataFrame, key: str, label: str, k: int, repeats: int = 1, seed: int = 42) -> DataFrame:
    """Folds with the class mix of the table; k is lowered to the smallest class."""
    smallest = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n")).first()[0]
    if smallest < 2:
        raise ValueError("a class has fewer than two rows")
    k = max(2, min(k, smallest))
    rows = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    rows = rows.withColumn("_h", order_hash(seed, "fold", F.col("repeat"), key))
    return pieces_by_hash(rows, ["repeat", label], "_h", _cut_ranks(k), "fold").drop("_h")


def stratified_group_kfold(df: DataFrame, group: str, label: str, k: int, seed: int = 42, key: str | None = None) -> DataFrame:
    """Whole groups to folds with an even class mix.

    k is lowered to the smallest number of groups that hold a class; when a class has a single group,
    plain group folds are used, as many as there are groups at most. Beyond the driver limit, groups are dealt within their main class.
    """
    cells = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("_n"))
    spread = cells.groupBy(label).agg(F.count(F.lit(1)).alias("g")).agg(F.min("g")).first()[0]
    if spread < 2:
        groups = len(cells.select(group).distinct().limit(k).collect())
        return group_kfold(df, group, max(2, min(k, groups)), seed=seed, key=key)
    k = max(2, min(k, spread))
    known = cells.limit(GREEDY_GROUPS + 1).collect()
    if len(known) <= GREEDY_GROUPS:
        labels = sorted({r[label] for r in known})
        counts: dict = {}
        for r in known:
            counts.setdefault(r[group], np.zeros(len(labels)))[labels.index(r[label])] += r["_n"]
        total = sum(counts.values())
        load = np.zeros((k, len(labels)))
        placed = []
        for name, own in sorted(counts.items(), key=lambda g: (-float(np.std(g[1])), -g[1].sum(), str(g[0]))):
            scores = []
            for f in range(k):
                trial = load.copy()
                trial[f] += own
                scores.append((float(np.mean(np.std(trial / total, axis=0))), float(load[f].sum()), f))
            fold = min(scores)[2]
            load[fold] += own
            placed.append((name, fold))
        kind = df.schema[group].dataType.simpleString()
        table = df.sparkSession.createDataFrame(placed, f"`{group}` {kind}, fold int")
        return join_small(df, table, [group])
    main = cells.groupBy(group).agg(F.max_by(label, "_n").alias("_main"), F.sum("_n").alias("_size"))
    numbered = main.withColumn("_v", _size_order(F.col("_size"), seed, group))
    places = running_totals(numbered, ["_main"], "_v").select("_main", "_v", F.col("before_cnt").alias("_place"))
    table = join_small(numbered, places, ["_main", "_v"]).select(group, _snake(F.col("_place"), k).alias("fold"))
    return join_small(df, table, [group])


def learning_subsets(df: DataFrame, fold: str, group: str, fractions: Sequence[float], seed: int = 42, folds: int | None = None) -> DataFrame:
    """Which groups train fold f at each fraction: ``fold, fraction, group`` (whole groups, nested).

    For each fold the groups outside it are ordered by a hash of their own; the first ceil(f * groups)
    belong to fraction f. Pass the row key as ``group`` for ungrouped data.
    """
    groups = df.select(F.col(group).alias("group"), F.col(fold).alias("_own")).distinct()
    if folds is None:
        folds = int(df.agg(F.max(fold)).first()[0]) + 1
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("_own"))
    rows = groups.select("group", F.explode(others).alias("fold"))
    rows = rows.withColumn("_h", F.md5(text_key(F.lit(seed) + F.col("fold"), F.lit("learn"), "group")))
    ranks = F.array(*[F.greatest(F.ceil(F.lit(f) * F.col("n")), F.lit(1).cast("bigint")) for f in fractions])
    cuts = hash_cuts(rows, ["fold"], "_h", ranks)
    placed = join_small(rows, cuts, ["fold"])
    distinct = F.array_sort(F.array_distinct(ranks))
    piece = F.size(F.filter("cuts", lambda c: c < F.col("_h")))
    inside = F.array(
        *[F.when(piece < F.array_position(distinct, F.get(ranks, F.lit(i))), F.lit(float(f))) for i, f in enumerate(fractions)]
    )
    return placed.select("fold", F.explode(F.filter(inside, lambda v: v.isNotNull())).alias("fraction"), "group")
