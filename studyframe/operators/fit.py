"""Model registry: study model names to Spark ML estimators; nearest neighbours come from ``neighbors``."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml import classification as C, regression as R
from pyspark.sql import DataFrame, Window as W, functions as F

from studyframe.functions.columns import join_small
from studyframe.operators.neighbors import knn_predict  # noqa: F401


def _depth(value) -> int:
    """Spark trees stop at depth 30; no limit in the study means that, and a deeper one gives a warning."""
    if value is not None and int(value) > 30:
        warnings.warn(f"Spark trees stop at depth 30; max_depth {value} is out of reach", stacklevel=2)
    return 30 if value is None else min(30, int(value))


def _features(value) -> str:
    if value in (None, 1.0, "auto", "all"):
        return "all" if value != "auto" else "auto"
    return str(value) if value in ("sqrt", "log2", "onethird") or isinstance(value, (int, float)) else "auto"


# Per model: study parameter -> (Spark parameter, conversion from (value, rows)).
_TREE = {
    "max_depth": ("maxDepth", lambda v, n: _depth(v)),
    "min_samples_leaf": ("minInstancesPerNode", lambda v, n: int(v)),
}
_FOREST = {
    **_TREE,
    "n_estimators": ("numTrees", lambda v, n: int(v)),
    "max_features": ("featureSubsetStrategy", lambda v, n: _features(v)),
}
_BOOST = {
    **_TREE,
    "n_estimators": ("maxIter", lambda v, n: int(v)),
    "learning_rate": ("stepSize", lambda v, n: float(v)),
    "subsample": ("subsamplingRate", lambda v, n: float(v)),
}
_IMPURITY = {"criterion": ("impurity", lambda v, n: "gini" if v == "gini" else "entropy")}
_ITER = {"max_iter": ("maxIter", lambda v, n: int(v))}
REGRESSORS: dict[str, tuple[Callable[[int], Estimator], dict]] = {
    "MLR": (lambda seed: R.LinearRegression(solver="normal"), {}),
    "RIDGE": (lambda seed: R.LinearRegression(elasticNetParam=0.0, standardization=False), {"alpha": ("alpha", None)}),
    "LASSO": (lambda seed: R.LinearRegression(elasticNetParam=1.0, standardization=False), {"alpha": ("regParam", lambda v, n: float(v)), **_ITER}),
    "EN": (
        lambda seed: R.LinearRegression(elasticNetParam=0.5, standardization=False),
        {"alpha": ("alpha", None), "l1_ratio": ("l1_ratio", None), **_ITER},
    ),
    "DT": (lambda seed: R.DecisionTreeRegressor(maxDepth=10, seed=seed), _TREE),
    "RF": (lambda seed: R.RandomForestRegressor(seed=seed, featureSubsetStrategy="all"), _FOREST),
    "GBR": (lambda seed: R.GBTRegressor(maxDepth=3, maxIter=100, seed=seed), _BOOST),
    "XGB": (lambda seed: R.GBTRegressor(maxDepth=6, maxIter=100, stepSize=0.3, seed=seed), _BOOST),
}
CLASSIFIERS: dict[str, tuple[Callable[[int], Estimator], dict]] = {
    "LOGREG": (lambda seed: C.LogisticRegression(family="multinomial"), {"C": ("regParam", lambda v, n: 1.0 / (float(v) * n)), **_ITER}),
    "SVC": (lambda seed: C.LinearSVC(maxIter=50), {"C": ("regParam", lambda v, n: 1.0 / (float(v) * n)), **_ITER}),
    "DT": (lambda seed: C.DecisionTreeClassifier(maxDepth=10, seed=seed), {**_TREE, **_IMPURITY}),
    "RF": (lambda seed: C.RandomForestClassifier(seed=seed), {**_FOREST, **_IMPURITY}),
    "GBC": (lambda seed: C.GBTClassifier(maxDepth=3, maxIter=100, seed=seed), _BOOST),
    "XGB": (lambda seed: C.GBTClassifier(maxDepth=6, maxIter=100, stepSize=0.3, seed=seed), _BOOST),
    "ANN": (lambda seed: C.MultilayerPerceptronClassifier(seed=seed, maxIter=100), _ITER),
}
# Binary learners that are fitted once per class.
ONE_VS_REST = {"SVC", "GBC", "XGB"}


def _penalty(name: str, params: Mapping, n: int, sd: float) -> dict[str, float]:
    """regParam and elasticNetParam for penalties alpha * (ratio * |w| + (1 - ratio) / 2 * w²).

    Ridge's alpha belongs to the sum of squares, so it is divided by the rows. Spark weighs the squared
    part by 1 / sd of the label, which is undone here.
    """
    alpha = float(params.get("alpha", 1.0))
    ratio = 0.0 if name == "RIDGE" else float(params.get("l1_ratio", 0.5))
    if name == "RIDGE":
        alpha /= n
    first, second = alpha * ratio, alpha * (1.0 - ratio) * sd
    total = first + second
    return {"regParam": total, "elasticNetParam": first / total if total > 0 else 0.0}


def register_model(task: str, name: str, factory: Callable[[int], Estimator], mapping: Mapping | None = None) -> None:
    """Add a model of your own: a factory that takes the seed, and how study parameters map to it."""
    (REGRESSORS if task == "regression" else CLASSIFIERS)[name] = (factory, dict(mapping or {}))


def make_estimator(
    task: str, name: str, params: Mapping[str, object] | None = None, n_rows: int = 1, n_features: int | None = None, n_classes: int | None = None,
    seed: int = 42, label: str = "label", weight: str | None = None, label_sd: float = 1.0,
) -> Estimator:
    """Unfitted Spark ML estimator of a study model; parameters without a counterpart give a warning."""
    table = REGRESSORS if task == "regression" else CLASSIFIERS
    if name not in table:
        raise ValueError(f"unknown {task} model {name}; known: {sorted(table)}")
    factory, mapping = table[name]
    est = factory(seed)
    params = dict(params or {})
    hidden = params.pop("hidden_layer_sizes", None)
    params.pop("class_weight", None)
    if name == "ANN":
        if not n_features or not n_classes:
            raise ValueError("the network needs the numbers of features and classes")
        hidden = [hidden] if isinstance(hidden, int) else list(hidden or [32])
        est.setLayers([n_features, *[int(h) for h in hidden], n_classes])
    unknown = []
    if name in ("RIDGE", "EN"):
        est._set(**_penalty(name, params, max(1, n_rows), label_sd))
        params = {k: v for k, v in params.items() if k not in ("alpha", "l1_ratio")}
    for key, value in params.items():
        if key in mapping:
            spark_name, convert = mapping[key]
            est._set(**{spark_name: convert(value, max(1, n_rows))})
        elif value is not None:
            unknown.append(key)
    if unknown:
        warnings.warn(f"{name}: no counterpart for {sorted(unknown)}, ignored")
    est._set(labelCol=label, featuresCol="features")
    if weight and name not in ONE_VS_REST and est.hasParam("weightCol"):
        est._set(weightCol=weight)
    if task == "classification" and name in ONE_VS_REST:
        rest = C.OneVsRest(classifier=est, labelCol=label, featuresCol="features")
        return rest.setWeightCol(weight) if weight else rest
    return est


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights n / (classes * rows of the class) beside each row."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_c"))
    everything = W.partitionBy(F.lit(0))
    k, n = F.count(F.lit(1)).over(everything), F.sum("_c").over(everything)
    weights = sizes.select(label, (n / (k * F.col("_c"))).alias(out))
    return join_small(df, weights, [label])
