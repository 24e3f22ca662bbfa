"""Nested cross-validation: a search inside every outer fold of every repeat.

Outer folds run side by side, a bounded number of them, each in a scheduler pool of its own, over one table that is
kept for all and has only what fits and scores need. A fold scores its rows as soon as it has its model and leaves one
line; its predictions are not written: those of held-out rows are worked out by whoever reads them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F, types as T

from studyframe.functions.columns import join_small, kept
from studyframe.operators.aggregates import group_diagnostics_class, group_diagnostics_reg
from studyframe.operators.cv import POOL, Candidate, _chosen, _kept, fit, grid_search_cv
from studyframe.operators.metrics import classification_metrics, confusion_long, regression_metrics

FOLD = ["outer_repeat", "fold"]


def nested_cv(
    df: DataFrame, c: Candidate, grid: Sequence[Mapping], outer: str | Sequence[str], outer_k: int, inner: Callable[[DataFrame, int], DataFrame],
    inner_k: int, key: str = "row_id", group: str | None = None, metric: str | None = None, parallelism: int = 4, outer_parallelism: int = 2,
    meta: Sequence[str] = (), group_lists: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(fold rows, held-out predictions) of all outer folds.

    ``outer`` names the fold column, or one column per repeat. ``inner(rows, seed)`` adds the column ``inner_fold``
    to the training rows of an outer fold; with one combination there is no search. Error if a group is found in
    more than one outer fold of a repeat. ``meta`` columns travel with the predictions, which have
    ``outer_repeat, fold, key, group, y_true, y_pred``; see ``group_rows`` for the diagnostics of their groups. They are
    worked out from ``df`` and the models when they are read: a caller who reads them keeps ``df``, which is not kept again then.
    ``group_lists`` adds the sorted group names of both sides to the fold rows, for studies with few groups.
    """
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    metric = metric or ("r2" if c.task == "regression" else "macro_f1")
    repeats = [outer] if isinstance(outer, str) else list(outer)
    carried = list(dict.fromkeys([key, *([group] if group else []), *meta]))
    # An inner split may go by any of them.
    needed = carried if len(grid) > 1 else [group] if group else []
    level = df.storageLevel
    own = not (level.useMemory or level.useDisk)
    rows = (_kept if own else _chosen)(df, c, [*needed, *repeats])
    if group:
        spans = [F.struct(F.min(r).alias("a"), F.max(r).alias("b")).alias(f"_{i}") for i, r in enumerate(repeats)]
        torn = " OR ".join(f"_{i}.a <> _{i}.b" for i in range(len(repeats)))
        if rows.groupBy(group).agg(*spans).where(torn).limit(1).count():
            raise ValueError("a group is in more than one outer fold")

    def tagged(model: PipelineModel, table: DataFrame, r: int, f: int, names: Sequence[str]) -> DataFrame:
        return model.transform(table).select(
            F.lit(r).alias("outer_repeat"), F.lit(f).alias("fold"), (F.col(repeats[r]) == f).alias("held_out"), *names,
            F.col(c.label).alias("y_true"), F.col("prediction").alias("y_pred"),
        )

    def run(job: tuple[int, int]) -> tuple[dict, PipelineModel, list, T.StructType]:
        r, f = job
        context.setLocalProperty(POOL, f"outer-{r}-{f}")
        train = rows.where(F.col(repeats[r]) != f)
        best = dict(grid[0])
        if len(grid) > 1:
            best, _ = grid_search_cv(inner(train, c.seed + r * outer_k + f), c, grid, "inner_fold", inner_k, metric, parallelism)
        model = fit(train, c, best)
        line = fold_rows(tagged(model, rows, r, f, [group] if group else []), c.task, metric, c.n_classes, group, group_lists)
        return best, model, line.collect(), line.schema

    jobs = [(r, f) for r in range(len(repeats)) for f in range(outer_k)]
    with ThreadPool(max(1, min(outer_parallelism, len(jobs)))) as pool:
        done = pool.map(run, jobs, chunksize=1)
    if own:
        rows.unpersist()
    folds = spark.createDataFrame([row for _, _, lines, _ in done for row in lines], done[0][3])
    best = spark.createDataFrame([(*job, json.dumps(x[0], default=str)) for job, x in zip(jobs, done)], "outer_repeat int, fold int, best_params string")
    source = _chosen(df, c, [*carried, *repeats])
    parts = [tagged(x[1], source.where(F.col(repeats[r]) == f), r, f, carried).drop("held_out") for (r, f), x in zip(jobs, done)]
    return join_small(folds, best, FOLD).withColumnRenamed("fold", "outer_fold"), reduce(DataFrame.unionByName, parts)


def _side(table: DataFrame, held_out: bool, names: Mapping[str, str]) -> DataFrame:
    return table.where(F.col("held_out") == held_out).select(*FOLD, *(F.col(a).alias(b) for a, b in names.items()))


def fold_rows(tagged: DataFrame, task: str, metric: str, n_classes: int | None = None, group: str | None = None, group_lists: bool = False) -> DataFrame:
    """A line per outer fold with held-out rows, from predictions tagged with outer_repeat, fold and held_out.

    Regression: scores of both sides, error measures and target statistics; a spread of one row is 0. Classification:
    scores and class counts. With ``group`` the groups per side, and how many are on both (0 unless folds leak). A
    null group is a group.
    """
    names = [*FOLD, "held_out"]
    if task == "regression":
        scores = regression_metrics(tagged, names, agreement=False).drop("n")
        spread = F.coalesce(F.nanvl(F.stddev_samp("y_true"), F.lit(0.0)), F.lit(0.0))
        facts = {"n": F.count(F.lit(1)), "mean": F.avg("y_true"), "std": spread, "min": F.min("y_true"), "max": F.max("y_true")}
        more = {"mae": "outer_mae", "rmse": "outer_rmse", "bias": "outer_bias"}
        of_target = {f"{s}": f"outer_target_{s}" for s in ("mean", "std", "min", "max")}
        inside = {"mean": "inner_target_mean", "std": "inner_target_std"}
    else:
        labels = list(range(n_classes))
        scores = classification_metrics(confusion_long(tagged, labels, names), names).drop("n")
        counts = F.to_json(F.array(*(F.count_if(F.col("y_true") == x) for x in labels)))
        facts = {"n": F.count(F.lit(1)), "counts": counts}
        more = {s: f"outer_{s}" for s in ("macro_f1", "balanced_accuracy", "accuracy")}
        of_target, inside = {"counts": "outer_class_counts"}, {"counts": "inner_class_counts"}
    more = {a: b for a, b in more.items() if a != metric}
    # A line per fold and side, read for either side.
    table = kept(tagged.groupBy(*names).agg(*(x.alias(a) for a, x in facts.items())).join(scores, names))
    out = _side(table, True, {"n": "n_outer_validation", metric: f"outer_{metric}", **more, **of_target})
    out = out.join(_side(table, False, {"n": "n_inner_train", metric: f"train_{metric}", **inside}), FOLD)
    out = out.withColumn("train_outer_gap", F.col(f"train_{metric}") - F.col(f"outer_{metric}"))
    if not group:
        return out
    each = tagged.groupBy(*FOLD, group).agg(F.max("held_out").alias("_held"), F.max(~F.col("held_out")).alias("_train"))
    lists = {}
    if group_lists:
        named = lambda side: F.to_json(F.array_sort(F.collect_list(F.when(side, F.col(group).cast("string")))))
        lists = {"train_groups": named(F.col("_train")), "validation_groups": named(F.col("_held"))}
    groups = each.groupBy(*FOLD).agg(
        F.count_if("_train").alias("n_train_groups"), F.count_if("_held").alias("n_validation_groups"),
        F.count_if(F.col("_train") & F.col("_held")).alias("group_overlap_count"), *(x.alias(a) for a, x in lists.items()),
    )
    return out.join(groups, FOLD)


def group_rows(predictions: DataFrame, c: Candidate, group: str, meta: Sequence[str] = ()) -> DataFrame:
    """Diagnostics of every held-out group in every repeat, from the predictions of ``nested_cv``."""
    if c.task == "regression":
        return group_diagnostics_reg(predictions, "fold", group, meta, ["outer_repeat"])
    return group_diagnostics_class(predictions, "fold", group, list(range(c.n_classes)), ["outer_repeat"])
