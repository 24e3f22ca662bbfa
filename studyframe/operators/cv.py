"""Search, importances, learning curves and the final holdout score.

Preprocessing is fitted once per fold and shared by all candidates of a search. Independent fits are
submitted from a bounded thread pool; every fit and every score is a Spark job over all executors.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.evaluation import Evaluator, RegressionEvaluator
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import LinearRegressionModel
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, functions as F, types as T

from studyframe.functions.columns import draw32, finite, join_small
from studyframe.operators.fit import ONE_VS_REST, class_weights, make_estimator
from studyframe.operators.metrics import classification_metrics, confusion_long, regression_metrics
from studyframe.operators.prep import build_preprocessor
from studyframe.operators.schema import _num
from studyframe.operators.selection import best_per_feature_set

#: Combinations of a quick search, and those of a random search: drawn if the grid has more than the threshold.
QUICK_CAP = 20
RANDOM_SEARCH = {"threshold": 100, "n_iter": 40}
#: Rows of which the fits that run side by side may hold a binned copy each; a fit of more rows fills the cores by itself.
ROWS_SIDE_BY_SIDE = 20_000_000
#: The property that puts a thread's jobs into a scheduler pool.
POOL = "spark.scheduler.pool"
# Words of configuration files.
CONFIG_WORDS = {"none": None, "null": None, "true": True, "yes": True, "false": False, "no": False}
_INTEGER, _DECIMAL = re.compile(r"[+-]?\d+"), re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


@dataclass
class Candidate:
    """One model of a study: what to fit on which columns."""

    task: str
    name: str
    features: Sequence[str]
    label: str = "label"
    preprocessing: Mapping[str, object] = field(default_factory=dict)
    n_classes: int | None = None
    seed: int = 42


def plain_value(text):
    """What a scalar of a configuration file stands for; texts of no known form stay texts."""
    bare = text.strip() if isinstance(text, str) else None
    if bare is None:
        return text
    forms = ((_INTEGER, int), (_DECIMAL, float))
    return CONFIG_WORDS.get(bare.lower(), next((read(bare) for form, read in forms if form.fullmatch(bare)), text))


def param_grid(
    raw: Mapping[str, object] | None, task: str = "regression", seed: int = 42, cap: int | None = None, quick: bool = False, random_search: bool = False,
) -> list[dict]:
    """All combinations of the listed values.

    Fewer only on demand: the first `cap` in hash order (QUICK_CAP of a quick search), or a random search of a
    classification grid beyond its threshold.
    """
    lists = {k: v if isinstance(v, list) else [v] for k, v in (raw or {}).items() if not k.startswith("_")}
    lists = {k: [plain_value(v) for v in vs] for k, vs in lists.items()}
    combos = [dict(zip(lists, values)) for values in itertools.product(*lists.values())]
    if cap is None and random_search and task == "classification" and len(combos) > RANDOM_SEARCH["threshold"]:
        cap = RANDOM_SEARCH["n_iter"]
    cap = cap or (QUICK_CAP if quick else len(combos))
    if len(combos) > cap:
        combos.sort(key=lambda c: hashlib.md5(f"{seed}|{json.dumps(c, sort_keys=True, default=str)}".encode()).hexdigest())
        combos = combos[:cap]
    return combos


# ------------------------------------------------------------------ scores


def score(pred: DataFrame, metric: str, label: str = "label", classes: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``by, score`` of a prediction table, in one aggregation."""
    if metric in ("r2", "mae", "rmse", "mse"):
        out = regression_metrics(pred, list(by), label, "prediction", agreement=False)
    else:
        if classes is None:
            classes = int(pred.agg(F.max(F.greatest(label, "prediction"))).first()[0]) + 1
        keys = list(by)
        table = pred.withColumn("_all", F.lit(0)) if not keys else pred
        keys = keys or ["_all"]
        out = classification_metrics(confusion_long(table, list(range(classes)), keys, label, "prediction"), keys)
    return out.select(*by, F.col(metric).alias("score"), "n")


def _value(pred: DataFrame, metric: str, c: Candidate) -> float:
    row = score(pred, metric, c.label, c.n_classes).first()
    return float(row["score"]) if row is not None and row["score"] is not None else math.nan


def _both(pred: DataFrame, held_out, metric: str, c: Candidate) -> tuple[float, float, int, int]:
    """Train score, held-out score and the row counts of both, from one pass over the predictions."""
    found = {r["_out"]: r for r in score(pred.withColumn("_out", held_out), metric, c.label, c.n_classes, ["_out"]).collect()}
    value = lambda side: float(found[side]["score"]) if side in found and found[side]["score"] is not None else math.nan
    count = lambda side: int(found[side]["n"]) if side in found else 0
    return value(False), value(True), count(False), count(True)


class MacroF1(Evaluator):
    """Macro-F1 over a fixed label list, for use with Spark's own tuning classes."""

    def __init__(self, n_classes: int, label: str = "label", metric: str = "macro_f1"):
        super().__init__()
        self.n_classes, self.label, self.metric = n_classes, label, metric

    def _evaluate(self, dataset: DataFrame) -> float:
        row = score(dataset, self.metric, self.label, self.n_classes).first()
        return float(row["score"])

    def isLargerBetter(self) -> bool:
        return True


class BalancedAccuracy(MacroF1):
    """Mean recall over a fixed label list, for use with Spark's own tuning classes."""

    def __init__(self, n_classes: int, label: str = "label"):
        super().__init__(n_classes, label, "balanced_accuracy")


# ------------------------------------------------------------------ fits


def _ready(df: DataFrame, c: Candidate) -> DataFrame:
    """Rows with all numbers present (regression), label as a double."""
    out = df.withColumn(c.label, F.col(c.label).cast("double"))
    return out.na.drop(subset=[c.label, *([] if c.task == "classification" else list(c.features))])


def _prep(c: Candidate, df: DataFrame):
    config = dict(c.preprocessing) or {"scaling": "standard"}
    return build_preprocessor(config, list(c.features), df, impute=c.task == "classification")


# Models whose penalty depends on the number of rows or the spread of the label.
SIZED = {"RIDGE", "EN", "LOGREG", "SVC"}


def _size(rows: DataFrame, c: Candidate) -> tuple[int, float]:
    """Rows and label sd, read only for models that need them."""
    if c.name not in SIZED:
        return 1, 1.0
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop(c.label).alias("sd")).first()
    return int(row["n"]), float(row["sd"] or 1.0)


def _estimator(c: Candidate, params: Mapping, size: tuple[int, float], width: int):
    balanced = params.get("class_weight") == "balanced"
    return make_estimator(
        c.task, c.name, params, size[0], width, c.n_classes, c.seed, c.label, "weight" if balanced else None, size[1]
    )


def _weighted(df: DataFrame, c: Candidate, params: Mapping) -> DataFrame:
    return class_weights(df, c.label) if params.get("class_weight") == "balanced" else df


def _chosen(df: DataFrame, c: Candidate, extra: Sequence[str] = ()) -> DataFrame:
    """Ready rows with only the needed columns."""
    names = list(dict.fromkeys([*extra, *c.features, c.label]))
    return _ready(df.select(*[F.col(f"`{n}`") for n in names]), c)


def _kept(df: DataFrame, c: Candidate, extra: Sequence[str] = ()) -> DataFrame:
    """Ready rows with only the needed columns, kept while several jobs read them."""
    return _chosen(df, c, extra).persist(StorageLevel.MEMORY_AND_DISK)


def fit(df: DataFrame, c: Candidate, params: Mapping | None = None) -> PipelineModel:
    """Preprocessing and model fitted on all rows of ``df``."""
    params = dict(params or {})
    kept = _kept(df, c)
    rows = _weighted(kept, c, params)
    stages, names = _prep(c, rows)
    model = Pipeline(stages=[*stages, _estimator(c, params, _size(rows, c), len(names))]).fit(rows)
    kept.unpersist()
    return model


def _side_by_side(parallelism: int, fits: int, rows: int) -> int:
    """How many of a search's fits run at once, so that what they keep does not grow with their number."""
    return max(1, min(parallelism, fits, ROWS_SIDE_BY_SIDE // max(1, rows)))


def grid_search_cv(
    df: DataFrame, c: Candidate, grid: Sequence[Mapping], fold: str, k: int, metric: str | None = None, parallelism: int = 4
) -> tuple[dict, DataFrame]:
    """Mean fold score of every combination: (best parameters, result table).

    The table has ``params`` (map), ``mean_train, std_train, mean_test, std_test``.
    """
    metric = metric or ("r2" if c.task == "regression" else "macro_f1")
    rows = _kept(df, c, [fold])
    threads = _side_by_side(parallelism, len(grid), rows.count())
    context = df.sparkSession.sparkContext
    pool_name = context.getLocalProperty(POOL)
    train_scores = np.full((len(grid), k), math.nan)
    test_scores = np.full((len(grid), k), math.nan)
    for f in range(k):
        inside = rows.where(F.col(fold) != f)
        stages, names = _prep(c, inside)
        prepared = Pipeline(stages=stages).fit(inside)
        ready = prepared.transform(rows).select("features", c.label, fold).persist(StorageLevel.MEMORY_AND_DISK)
        train = ready.where(F.col(fold) != f)
        size = _size(train, c)

        def run(i: int) -> None:
            context.setLocalProperty(POOL, pool_name)
            params = grid[i]
            model = _estimator(c, params, size, len(names)).fit(_weighted(train, c, params))
            train_scores[i, f], test_scores[i, f], _, _ = _both(model.transform(ready), F.col(fold) == f, metric, c)

        with ThreadPool(threads) as pool:
            pool.map(run, range(len(grid)))
        ready.unpersist()
    rows.unpersist()
    mean = np.nanmean(test_scores, axis=1)
    lines = [
        (
            {k_: str(v) for k_, v in params.items()}, float(np.nanmean(train_scores[i])), float(np.nanstd(train_scores[i])), float(mean[i]),
            float(np.nanstd(test_scores[i])),
        )
        for i, params in enumerate(grid)
    ]
    table = df.sparkSession.createDataFrame(lines, "params map<string,string>, mean_train double, std_train double, mean_test double, std_test double")
    return dict(grid[int(np.nanargmax(mean))]), table


def _evaluator(metric: str, c: Candidate) -> Evaluator:
    if c.task == "classification":
        return BalancedAccuracy(c.n_classes, c.label) if metric == "balanced_accuracy" else MacroF1(c.n_classes, c.label, metric)
    return RegressionEvaluator(metricName=metric, labelCol=c.label)


class _PreparedOnce(Pipeline):
    """A pipeline whose first stages are fitted once for all parameter maps, which belong to its last stage."""

    def fitMultiple(self, dataset: DataFrame, paramMaps: Sequence) -> Iterator[tuple[int, PipelineModel]]:
        *first, last = self.getStages()
        prepared = Pipeline(stages=first).fit(dataset)
        models = last.copy().fitMultiple(prepared.transform(dataset), paramMaps)
        return map(lambda found: (found[0], PipelineModel([*prepared.stages, found[1]])), models)


def cross_validate(
    df: DataFrame, c: Candidate, grid: Sequence[Mapping], fold: str, k: int, metric: str | None = None, parallelism: int = 4
) -> tuple[dict, DataFrame, PipelineModel]:
    """Search by Spark's own ``CrossValidator``: (best parameters, result table, best pipeline fitted on all rows).

    The folds are those of column ``fold`` (0 .. k - 1). Preprocessing is a part of the pipeline and fitted once per
    fold, as in `grid_search_cv`. Penalties that depend on the number of rows are converted with that of all rows. The table has ``params`` (map), ``mean_test, std_test`` (population) and ``best``.
    """
    if any(params.get("class_weight") == "balanced" for params in grid):
        raise ValueError("class weights belong to the rows of a fold: use grid_search_cv")
    metric = metric or ("r2" if c.task == "regression" else "macro_f1")
    held = _kept(df, c, [fold])
    rows = held.withColumn(fold, F.col(fold).cast("int"))
    threads = _side_by_side(parallelism, len(grid), held.count())
    stages, names = _prep(c, rows)
    size = _size(rows, c)
    base = _estimator(c, {}, size, len(names))
    made = [_estimator(c, params, size, len(names)) for params in grid]
    settings = [{base.getParam(param.name): value for param, value in est._paramMap.items()} for est in made]
    evaluator = _evaluator(metric, c)
    search = CrossValidator(estimator=_PreparedOnce(stages=[*stages, base]), estimatorParamMaps=settings, evaluator=evaluator, numFolds=k, foldCol=fold, parallelism=threads)
    found = search.fit(rows)
    held.unpersist()
    means, spreads = np.array(found.avgMetrics), np.array(found.stdMetrics)
    best = int(np.argmax(means if evaluator.isLargerBetter() else -means))
    lines = [({k_: str(v) for k_, v in params.items()}, float(means[i]), float(spreads[i]), i == best) for i, params in enumerate(grid)]
    table = df.sparkSession.createDataFrame(lines, "params map<string,string>, mean_test double, std_test double, best boolean")
    return dict(grid[best]), table, found.bestModel


# ------------------------------------------------------------------ permutation importance

# Rows among which a feature is exchanged, about.
BLOCK_ROWS = 4096


def _dealt(df: DataFrame, seed: int, key: str, block_rows: int) -> DataFrame:
    """The rows with the number ``_block`` of a random block of theirs, whole blocks in a task, in random order."""
    spark = df.sparkSession
    blocks = max(1, math.ceil(df.count() / block_rows))
    tasks = min(blocks, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    rows = df.withColumn("_block", F.pmod(draw32(F.lit(seed), F.lit("block"), key), F.lit(blocks)).cast("int")).withColumn("_place", draw32(F.lit(seed), F.lit("place"), key))
    return rows.repartition(tasks, "_block").sortWithinPartitions("_block", "_place", key).drop("_place")


def _order(seed: int, block: int, feature: int, repeat: int, n: int) -> np.ndarray:
    return np.random.default_rng([seed, block, feature, repeat]).permutation(n)


def permuted(
    df: DataFrame, features: Sequence[str], n_repeats: int, seed: int, key: str = "row_id", block_rows: int = BLOCK_ROWS, keep_key: bool = True
) -> DataFrame:
    """Copies of the rows in which one feature is exchanged among random rows: adds ``feature, repeat``.

    Rows are dealt once, by a hash of their key, into random blocks. The task that has a block makes all its copies,
    one (feature, repeat) at a time: so only the rows themselves are shuffled, memory holds one block and one copy,
    and each copy of a block is a permutation of the column that depends on seed, block, feature and repeat alone.
    """
    names = list(features)
    rows = _dealt(df, seed, key, block_rows)
    kept = [c for c in df.columns if keep_key or c != key]
    schema = T.StructType([f for f in df.schema.fields if f.name in kept] + [T.StructField("feature", T.StringType()), T.StructField("repeat", T.IntegerType())])

    def copies(block: int, parts: list[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = pd.concat(parts, ignore_index=True)[kept]
        for i, name in enumerate(names):
            for repeat in range(n_repeats):
                yield whole.assign(**{name: whole[name].to_numpy()[_order(seed, block, i, repeat, len(whole))], "feature": name, "repeat": np.int32(repeat)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, held = None, []
        for batch in batches:
            for number, part in batch.groupby("_block", sort=True):
                if held and number != block:
                    yield from copies(block, held)
                    held = []
                block = int(number)
                held.append(part)
        if held:
            yield from copies(block, held)

    return rows.mapInPandas(run, schema)


def _scaled_alone(stage) -> bool:
    """Whether a stage is a fitted Scaler, which works out every column from itself and two numbers."""
    found = re.fullmatch(r"SELECT \* EXCEPT \((.*)\), (.*) FROM __THIS__", stage.getStatement()) if isinstance(stage, SQLTransformer) else None
    if not found:
        return False
    number = r"CAST\('[^']*' AS DOUBLE\)"
    names = re.findall(r"`([^`]*)`", found[1])
    news = ", ".join(rf"\(CAST\(`{re.escape(c)}` AS DOUBLE\) - {number}\) / {number} AS `{re.escape(c)}`" for c in names)
    return found[1] == ", ".join(f"`{c}`" for c in names) and re.fullmatch(news, found[2]) is not None


def _additive(model: PipelineModel, c: Candidate, metric: str) -> tuple[PipelineModel, list[str], np.ndarray, float] | None:
    """Scalers, columns, slopes and intercept of a linear model whose columns are scaled one by one, so that each adds a number of its own."""
    *first, assembler, last = [None, None, *model.stages][-max(2, len(model.stages)) :]
    if metric not in ("r2", "mae", "mse", "rmse") or not (isinstance(last, LinearRegressionModel) and isinstance(assembler, VectorAssembler) and all(map(_scaled_alone, first))):
        return None
    columns = list(assembler.getInputCols())
    slopes = last.coefficients.toArray()
    if len(slopes) != len(columns) or last.getFeaturesCol() != assembler.getOutputCol() or last.getPredictionCol() != "prediction":
        return None
    return PipelineModel(first), columns, slopes, float(last.intercept)


def _additive_scores(parts: tuple, rows: DataFrame, features: Sequence[str], n_repeats: int, seed: int, key: str, metric: str, label: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``feature, repeat, score`` of the copies that ``permuted`` makes, for a model that `_additive` knows.

    Only what the exchanged column adds changes in a copy: a task works out the errors of all copies of a block from the
    numbers that the columns add, and sends sums, so that no copy leaves it."""
    scalers, columns, slopes, intercept = parts
    names = list(features)
    ready = scalers.transform(rows).select(key, F.col(label).alias("_y"), *(F.col(f"`{x}`").cast("double").alias(f"_x{j}") for j, x in enumerate(columns)))
    centre = rows.agg(F.avg(finite(F.col(label)))).first()[0] or 0.0
    dealt = _dealt(ready, seed, key, block_rows).drop(key)

    def sums(e: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.array([len(e), e @ e, np.abs(e).sum(), (y - centre).sum(), ((y - centre) ** 2).sum()])

    def add(block: int, y: np.ndarray, x: np.ndarray, total: np.ndarray, ends: np.ndarray) -> None:
        with np.errstate(invalid="ignore", over="ignore"):
            adds = x * slopes[:, None]
            plain = np.isfinite(adds).all() and np.isfinite(y).all()
            sy = sums(np.zeros(len(y)), y) if plain else None
            for i, name in enumerate(names):
                at = columns.index(name) if name in columns else -1
                rest = intercept + sum((a for j, a in enumerate(adds) if j != at), np.zeros(len(y)))
                short = rest - y
                for repeat in range(n_repeats):
                    own = adds[at][_order(seed, block, i, repeat, len(y))] if at >= 0 else 0.0
                    if plain:
                        e = short + own
                        squares = e @ e
                        if np.isfinite(squares):
                            total[i, repeat] += (len(e), squares, np.abs(e).sum(), sy[3], sy[4])
                            ends[i, repeat] = min(ends[i, repeat, 0], y.min()), max(ends[i, repeat, 1], y.max())
                            continue
                    good = np.isfinite(rest + own) & np.isfinite(y)
                    if good.any():
                        total[i, repeat] += sums((rest + own - y)[good], y[good])
                        ends[i, repeat] = min(ends[i, repeat, 0], y[good].min()), max(ends[i, repeat, 1], y[good].max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ends = np.zeros((len(names), n_repeats, 5)), np.tile([np.inf, -np.inf], (len(names), n_repeats, 1))
        block, held = None, []

        def close() -> None:
            whole = np.concatenate(held, axis=1)
            add(block, whole[0], whole[1:], total, ends)

        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = batch.column("_block").to_numpy()
            values = np.stack([batch.column(f).to_numpy(zero_copy_only=False) for f in ("_y", *(f"_x{j}" for j in range(len(columns))))])
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for first, stop in zip(cuts, cuts[1:]):
                if held and int(numbers[first]) != block:
                    close()
                    held = []
                block = int(numbers[first])
                held.append(values[:, first:stop])
        if held:
            close()
            flat, span = total.reshape(-1, 5), ends.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x for x in names for _ in range(n_repeats)]), pa.array(np.tile(np.arange(n_repeats, dtype=np.int32), len(names)))] + [pa.array(a) for a in (*flat.T, *span.T)],
                ["feature", "repeat", "n", "sse", "sae", "sy", "syy", "lo", "hi"],
            )

    done = dealt.mapInArrow(run, "feature string, repeat int, n double, sse double, sae double, sy double, syy double, lo double, hi double")
    done = done.groupBy("feature", "repeat").agg(*(F.sum(x).alias(x) for x in ("n", "sse", "sae", "sy", "syy")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    n, mse = F.col("n"), F.col("sse") / F.col("n")
    spread = F.when(F.col("lo") < F.col("hi"), F.col("syy") - F.col("sy") * F.col("sy") / n).otherwise(0.0)
    scores = {"r2": F.when(spread > 0, 1 - F.col("sse") / spread).when(F.col("sse") == 0, 1.0).otherwise(0.0), "mae": F.col("sae") / n, "mse": mse, "rmse": F.sqrt(mse)}
    return done.select("feature", "repeat", F.when(n >= 2, scores[metric]).alias("score"))


def permutation_importance(
    model: PipelineModel, df: DataFrame, features: Sequence[str], c: Candidate, metric: str | None = None, n_repeats: int = 30, seed: int = 42, key: str = "row_id"
) -> DataFrame:
    """Score lost when a raw feature is permuted: mean, sd (population) and share, largest first."""
    metric = metric or ("r2" if c.task == "regression" else "macro_f1")
    rows = _ready(df, c).select(key, c.label, *features)
    base = _value(model.transform(rows), metric, c)
    lower = metric in ("mse", "mae", "rmse")
    parts = _additive(model, c, metric)
    if parts:
        scored = _additive_scores(parts, rows, features, n_repeats, seed, key, metric, c.label)
    else:
        scored = score(model.transform(permuted(rows, features, n_repeats, seed, key, keep_key=False)), metric, c.label, c.n_classes, ["feature", "repeat"])
    loss = F.col("score") - base if lower else base - F.col("score")
    out = scored.groupBy("feature").agg(F.avg(loss).alias("mean_importance"), F.stddev_pop(loss).alias("std_importance"))
    out = out.persist(StorageLevel.MEMORY_AND_DISK)  # a line per feature, read for the total too: all copies are scored once
    total = out.select(F.abs("mean_importance").alias("a")).agg(F.sum("a").alias("total"))
    out = join_small(out, total, [])
    share = F.when(F.col("total") > 0, F.abs("mean_importance") / F.col("total") * 100.0).otherwise(0.0)
    out = out.select(
        "feature", "mean_importance", "std_importance", F.abs("mean_importance").alias("absolute_importance"), share.alias("relative_contribution_percent"),
        F.lit(metric).alias("scoring"), F.lit(n_repeats).alias("n_repeats"),
    )
    return out.orderBy(F.col("absolute_importance").desc(), "feature")


def learning_curve(
    df: DataFrame, c: Candidate, params: Mapping, subsets: DataFrame, fold: str, group: str, k: int, fractions: Sequence[float], metric: str | None = None,
    parallelism: int = 4,
) -> DataFrame:
    """``fraction, train_size, train_mean, train_sd, cv_mean, cv_sd`` from fits on growing group subsets."""
    metric = metric or ("r2" if c.task == "regression" else "macro_f1")
    rows = _kept(df, c, [fold, group])
    sets = subsets.persist(StorageLevel.MEMORY_AND_DISK)

    def run(job: tuple[int, float]) -> tuple:
        f, fraction = job
        chosen = sets.where((F.col("fold") == f) & (F.col("fraction") == fraction)).select(F.col("group").alias(group), F.lit(False).alias("_out"))
        marked = join_small(rows, chosen, [group], "left")
        out = F.when(F.col(fold) == f, True).otherwise(F.col("_out"))
        marked = marked.withColumn("_out", out).where(F.col("_out").isNotNull())
        train = marked.where(~F.col("_out"))
        if train.limit(2).count() < 2:
            return f, fraction, 0, None, None
        model = fit(train, c, params)
        train_score, cv_score, n, _ = _both(model.transform(marked), F.col("_out"), metric, c)
        return f, fraction, n, train_score, cv_score

    with ThreadPool(parallelism) as pool:
        lines = pool.map(run, [(f, float(x)) for f in range(k) for x in fractions])
    rows.unpersist()
    sets.unpersist()
    table = df.sparkSession.createDataFrame(lines, "fold int, fraction double, n bigint, train double, cv double")
    return table.groupBy("fraction").agg(
        F.round(F.avg("n")).cast("bigint").alias("train_size"), F.avg("train").alias("train_mean"), F.stddev_samp("train").alias("train_sd"),
        F.avg("cv").alias("cv_mean"), F.stddev_samp("cv").alias("cv_sd"),
    ).orderBy("fraction")


# ------------------------------------------------------------------ selection and scoring


def select_then_test(
    ranked: DataFrame, models: Mapping[str, PipelineModel], test: DataFrame, candidates: Mapping[str, Candidate],
    order: Sequence[tuple[str, bool]] = (("cv_r2_mean", False), ("cv_r2_std", True), ("abs_train_cv_gap", True)),
) -> DataFrame:
    """Holdout scores of the models chosen by CV scores alone; the holdout is read after the choice.

    One model per (target, feature set) and the best overall. ``models`` and ``candidates`` are keyed by file.
    """
    chosen = best_per_feature_set(ranked, list(order)).select("file").collect()
    keys = [F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last() for c, up in order]
    overall = ranked.orderBy(*keys).limit(1).select("file").first()["file"]
    out = None
    for scope, file in [("best_for_feature_set", r["file"]) for r in chosen] + [("best_overall", overall)]:
        c = candidates[file]
        pred = models[file].transform(_ready(test, c))
        if c.task == "regression":
            scores = regression_metrics(pred.withColumn("file", F.lit(file)), ["file"], c.label, "prediction")
        else:
            scores = classification_metrics(confusion_long(pred.withColumn("file", F.lit(file)), list(range(c.n_classes)), ["file"], c.label, "prediction"), ["file"])
        scores = scores.withColumn("selection_scope", F.lit(scope)).withColumn("test_used_for_selection", F.lit(False))
        out = scores if out is None else out.unionByName(scores)
    return out


def score_batch(model: PipelineModel, df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), out: str = "prediction") -> DataFrame:
    """Apply a stored model; every feature of the model must be present as numbers."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"the model needs columns that are missing: {missing}")
    rows = df.withColumns({f: _num(df, f) for f in features}).na.drop(subset=list(features))
    scored = model.transform(rows)
    extra = [c for c in ("probability",) if c in scored.columns]
    return scored.select(*keep, *features, *extra, F.col("prediction").alias(out))
