"""Scores computed from tables of predictions, for all models of a study in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from studyframe.functions.columns import finite, join_small, kept
from studyframe.functions.running import running_totals

EPS = 1e-12
PROB_EPS = 2.220446049250313e-16


def _pairs(pred: DataFrame, keys: Sequence[str], y: str, p: str) -> DataFrame:
    rows = pred.select(*keys, finite(F.col(y).cast("double")).alias("_y"), finite(F.col(p).cast("double")).alias("_p"))
    return rows.where(F.col("_y").isNotNull() & F.col("_p").isNotNull())


def _r2(sse: Column, sst: Column) -> Column:
    """1 - SSE/SST; a constant target scores 1 if it is hit exactly, else 0."""
    return F.when(sst > 0, 1 - sse / sst).when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))


def regression_metrics(
    pred: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred", agreement: bool = True
) -> DataFrame:
    """n, r2, mae, mse, rmse, bias, ioa, ios, p20 per key; all scores NULL when n < 2.

    The agreement index needs the group mean first: group means come from one map-side aggregation and
    are offered to the executors only if their number is small. Without ``agreement`` one pass is made.
    """
    keys = list(keys)
    rows = _pairs(pred, keys, y, p)
    error = F.col("_p") - F.col("_y")
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.sum(error * error).alias("_sse"),
        F.sum(F.abs(error)).alias("_sae"),
        F.sum(error).alias("_se"),
        F.var_pop("_y").alias("_var"),
        F.count_if(F.abs(error) <= 0.2 * (F.abs("_y") + EPS)).alias("_ok"),
    ]
    if agreement:
        means = rows.groupBy(*keys).agg(F.avg("_y").alias("_mean"))
        rows = join_small(rows, means, keys)
        spread = F.abs(F.col("_p") - F.col("_mean")) + F.abs(F.col("_y") - F.col("_mean"))
        aggs.append(F.sum(spread * spread).alias("_den"))
    out = rows.groupBy(*keys).agg(*aggs) if keys else rows.agg(*aggs)
    n = F.col("n")
    mse = F.col("_sse") / n
    ok = n >= 2
    scores = {
        "r2": _r2(F.col("_sse"), F.col("_var") * n),
        "mae": F.col("_sae") / n,
        "mse": mse,
        "rmse": F.sqrt(mse),
        "bias": F.col("_se") / n,
    }
    if agreement:
        scores["ioa"] = F.when(F.col("_den") > 0, 1 - F.col("_sse") / F.col("_den"))
    scores["ios"] = F.when(F.col("_var") > 0, 1 - F.sqrt(mse) / F.sqrt("_var"))
    scores["p20"] = 100.0 * F.col("_ok") / n
    return out.select(*keys, "n", *[F.when(ok, value).alias(name) for name, value in scores.items()])


def r2_eps(pred: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """R² whose denominator carries +1e-12, so a constant target yields a finite number."""
    error = F.col("_y") - F.col("_p")
    out = _pairs(pred, keys, y, p).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(error * error).alias("_sse"), F.var_pop("_y").alias("_var")
    )
    return out.select(*keys, "n", (1 - F.col("_sse") / (F.col("_var") * F.col("n") + EPS)).alias("r2_eps"))


def max_error(pred: DataFrame, keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return _pairs(pred, keys, y, p).groupBy(*keys).agg(F.max(F.abs(F.col("_y") - F.col("_p"))).alias("max_error"))


def binary_auc(rows: DataFrame, keys: Sequence[str], score: str, positive: str, negative: Column | None = None, **kw) -> DataFrame:
    """Rank-sum AUC of a 0/1 column; ties count half. NULL when one side is empty.

    ``negative`` makes ``positive`` and itself counts of lines that stand for many rows."""
    negative = 1 - F.col(positive) if negative is None else negative
    totals = running_totals(
        rows,
        keys,
        score,
        {"pos": F.col(positive).cast("bigint"), "neg": negative.cast("bigint")},
        **kw,
    )
    won = F.col("pos").cast("double") * (F.col("before_neg").cast("double") + F.col("neg").cast("double") / 2.0)
    out = totals.groupBy(*keys).agg(F.sum(won).alias("_u"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    product = F.col("n_pos").cast("double") * F.col("n_neg").cast("double")
    return out.select(*keys, "n_pos", "n_neg", F.when(product > 0, F.col("_u") / product).alias("auc"))


def band_metrics(
    pred: DataFrame,
    low: float,
    high: float,
    keys: Sequence[str],
    y: str = "y_true",
    p: str = "y_pred",
    truth_based: bool = False,
) -> DataFrame:
    """AUC of (1 - relative error) for predictions inside [low, high], and the accuracy pair.

    By default the band label is compared with itself, as the published study does (accuracy 1 by
    construction); ``truth_based`` compares the band of the truth with the band of the prediction.
    """
    rows = _pairs(pred, keys, y, p)
    inside = lambda c: ((c >= low) & (c <= high)).cast("int")
    rows = rows.select(
        *keys,
        inside(F.col("_p")).alias("_in"),
        inside(F.col("_y") if truth_based else F.col("_p")).alias("_label"),
        (1.0 - F.abs(F.col("_p") - F.col("_y")) / (F.abs("_y") + EPS)).alias("_score"),
    )
    auc = binary_auc(rows, keys, "_score", "_in").withColumnRenamed("auc", "band_auc")
    hit = F.when(F.col("_in") == F.col("_label"), 1.0).otherwise(0.0)
    acc = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("band_accuracy"),
        F.avg(F.when(F.col("_label") == 1, hit)).alias("_tpr"),
        F.avg(F.when(F.col("_label") == 0, hit)).alias("_tnr"),
    )
    both = (F.coalesce("_tpr", "_tnr") + F.coalesce("_tnr", "_tpr")) / 2.0
    acc = acc.select(*keys, "n", "band_accuracy", both.alias("band_balanced_accuracy"))
    return join_small(acc, auc.select(*keys, "band_auc"), keys, "left")


# ------------------------------------------------------------------ hard labels


def confusion_long(pred: DataFrame, labels: Sequence[int], keys: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Every (true, predicted) cell of the label list, zeros included.

    Rows with a label outside the list, or none, are counted in cells whose label is NULL; those cells are
    there only if they hold rows.
    """
    keys, labels = list(keys), [int(v) for v in labels]
    listed = lambda c: F.when(F.col(c).isin(labels), F.col(c).cast("int"))
    counts = pred.groupBy(*keys, listed(y).alias("_t"), listed(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    named = lambda t, q: F.concat(F.coalesce(t.cast("string"), F.lit("other")), F.lit("|"), F.coalesce(q.cast("string"), F.lit("other")))
    cells = counts.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(named(F.col("_t"), F.col("_p")), F.col("_n")))).alias("_cells")
    )
    cell = lambda a, b: F.struct(F.lit(a).cast("int").alias("t"), F.lit(b).cast("int").alias("p"))
    grid = F.array(*[cell(a, b) for a in labels for b in labels])
    others = F.filter(
        F.array(*[cell(a, None) for a in [*labels, None]], *[cell(None, b) for b in labels]), lambda g: F.map_contains_key("_cells", named(g["t"], g["p"]))
    )
    cells = cells.select(*keys, "_cells", F.explode(F.concat(grid, others)).alias("_g"))
    at = named(F.col("_g.t"), F.col("_g.p"))
    return cells.select(
        *keys,
        F.col("_g.t").alias("true_label"),
        F.col("_g.p").alias("pred_label"),
        F.coalesce(F.try_element_at("_cells", at), F.lit(0)).cast("bigint").alias("n"),
    )


def _per_class(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    side = F.array(
        F.struct(F.col("true_label").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
        F.struct(F.col("pred_label").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("bigint").alias("tp")),
    )
    rows = confusion.select(*keys, F.inline(side))
    out = rows.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("tp", "support", "predicted")])
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("predicted")))
    out = out.withColumn("recall", ratio(F.col("tp"), F.col("support")))
    return out.withColumn("f1", ratio(2 * F.col("tp"), F.col("support") + F.col("predicted")))


def class_report(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Precision, recall, F1 and support per class, and the macro and weighted average rows."""
    per = _per_class(confusion, keys).where("label is not null")
    score = ("precision", "recall", "f1")
    lines = per.select(*keys, F.col("label").cast("string").alias("row"), *score, "support")
    both = per.groupBy(*keys).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in score],
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(f"_w_{c}") for c in score],
        F.sum("support").alias("support"),
    )
    averages = both.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("macro avg").alias("row"), *[F.col(f"_m_{c}").alias(c) for c in score], F.col("support")),
                F.struct(F.lit("weighted avg").alias("row"), *[F.col(f"_w_{c}").alias(c) for c in score], F.col("support")),
            )
        ),
    )
    return lines.unionByName(averages)


def classification_metrics(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores of hard labels. Macro averages run over the whole label list, empty classes score 0.

    Rows with a label outside the list count in n, accuracy, MCC and kappa, as one more class without hits.
    """
    per = _per_class(confusion, keys)
    listed = lambda c: F.when(F.col("label").isNotNull(), F.col(c))
    d = lambda c: F.col(c).cast("double")
    out = per.groupBy(*keys).agg(
        F.sum("support").alias("n"),
        F.sum(d("tp")).alias("_c"),
        F.avg(F.when(F.col("support") > 0, listed("recall"))).alias("balanced_accuracy"),
        F.avg(listed("precision")).alias("macro_precision"),
        F.avg(listed("recall")).alias("macro_recall"),
        F.avg(listed("f1")).alias("macro_f1"),
        (F.sum(listed("f1") * F.col("support")) / F.nullif(F.sum(listed("support")), F.lit(0))).alias("weighted_f1"),
        F.sum(d("support") * d("predicted")).alias("_tp"),
        F.sum(d("support") * d("support")).alias("_tt"),
        F.sum(d("predicted") * d("predicted")).alias("_pp"),
    )
    s = d("n")
    root = F.sqrt(s * s - F.col("_pp")) * F.sqrt(s * s - F.col("_tt"))
    chance = F.col("_tp") / (s * s)
    accuracy = F.col("_c") / s
    return out.select(
        *keys,
        "n",
        accuracy.alias("accuracy"),
        "balanced_accuracy",
        "macro_precision",
        "macro_recall",
        "macro_f1",
        "weighted_f1",
        F.when(root > 0, (F.col("_c") * s - F.col("_tp")) / root).otherwise(0.0).alias("mcc"),
        F.when(chance < 1, (accuracy - chance) / (1 - chance)).alias("cohen_kappa"),
    )


def ovr_points(confusion: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sensitivity and specificity of each class against the rest, from hard labels."""
    per = _per_class(confusion, keys)
    total = F.sum("support").over(W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0)))
    per = per.withColumn("_n", total)
    fp = F.col("predicted") - F.col("tp")
    tn = F.col("_n") - F.col("support") - fp
    spec = F.when(tn + fp > 0, tn / (tn + fp))
    return per.where("label is not null").select(
        *keys,
        "label",
        (1 - spec).alias("fpr"),
        F.when(F.col("support") > 0, F.col("tp") / F.col("support")).alias("sensitivity"),
        spec.alias("specificity"),
    )


# ------------------------------------------------------------------ class probabilities


def align_probabilities(
    df: DataFrame, scores: str, labels: Sequence[int], classes: Sequence[int] | None = None, mode: str = "proba",
    strict: bool = False, out: str = "probability",
) -> DataFrame:
    """Order class scores by ``labels`` and make each row sum to 1.

    ``classes`` names the class of each score (default: the same as ``labels``). Margins go through a
    softmax; two classes may be given as one margin. Negative shares are clipped. A row without any
    positive share becomes uniform, or an error with ``strict``.
    """
    labels = list(labels)
    classes = list(classes) if classes is not None else labels
    raw = F.col(scores)
    if mode == "margin":
        raw = F.when(F.size(raw) == 1, F.array(-raw[0], raw[0])).otherwise(raw)
        top = F.array_max(raw)
        raw = F.transform(raw, lambda v: F.exp(v - top))
    zero = F.lit(0.0)
    ordered = F.array(*[F.get(raw, F.lit(classes.index(c))) if c in classes else zero for c in labels])
    clipped = F.transform(ordered, lambda v: F.when(v > 0, v.cast("double")).otherwise(zero))
    total = F.aggregate(clipped, zero, lambda a, v: a + v)
    usable = (total > 0) & (total < float("inf"))
    if strict:
        empty = F.raise_error(F.lit("a row has no positive class score"))
    else:
        empty = F.array(*[F.lit(1.0 / len(labels)) for _ in labels])
    with_total = df.withColumn("_clipped", clipped).withColumn("_total", F.aggregate("_clipped", zero, lambda a, v: a + v))
    usable = (F.col("_total") > 0) & (F.col("_total") < float("inf"))
    value = F.when(usable, F.transform("_clipped", lambda v: v / F.col("_total"))).otherwise(empty)
    return with_total.withColumn(out, value).drop("_clipped", "_total")


def log_loss(pred: DataFrame, labels: Sequence[int], keys: Sequence[str], y: str = "y_true", proba: str = "probability") -> DataFrame:
    """Mean negative log of the true class's share; shares are clipped and renormalised first."""
    labels = [int(v) for v in labels]
    clip = lambda v: F.least(F.greatest(v, F.lit(PROB_EPS)), F.lit(1.0 - PROB_EPS))
    clipped = F.transform(proba, clip)
    total = F.aggregate(clipped, F.lit(0.0), lambda a, v: a + v)
    at = F.array_position(F.array(*[F.lit(v) for v in labels]), F.col(y).cast("int"))
    own = F.get(clipped, (at - 1).cast("int")) / total
    return pred.where(F.col(y).isin(labels)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (-F.avg(F.log(own))).alias("log_loss")
    )


def _one_vs_rest(pred: DataFrame, labels: Sequence[int], keys: Sequence[str], y: str, proba: str) -> DataFrame:
    sides = F.array(
        *[
            F.struct(
                F.lit(int(c)).alias("label"),
                F.get(proba, F.lit(i)).alias("_score"),
                (F.col(y) == c).cast("int").alias("_pos"),
            )
            for i, c in enumerate(labels)
        ]
    )
    return pred.where(F.col(y).isNotNull()).select(*keys, F.inline(sides))


def _scored(pred: DataFrame, labels: Sequence[int], keys: Sequence[str], y: str, proba: str, scope: str, micro: bool = True) -> DataFrame:
    """keys, scope, _score, pos, neg: one-vs-rest counts of every distinct score, per label and, with ``micro``, over all of them.

    Counts come before the copy for the micro scope, so that tied scores are copied once."""
    pos = F.col("_pos").cast("bigint")
    rows = _one_vs_rest(pred, labels, keys, y, proba).where(F.col("_score").isNotNull())
    lines = rows.groupBy(*keys, "label", "_score").agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    scopes = [F.col("label").cast("string")] + ([F.lit("micro")] if micro else [])
    return lines.select(*keys, F.explode(F.array(*scopes)).alias(scope), "_score", "pos", "neg")


def auc_ovr(pred: DataFrame, labels: Sequence[int], keys: Sequence[str], y: str = "y_true", proba: str = "probability") -> DataFrame:
    """One-vs-rest AUC: a row per class (``scope`` = the label) and macro, weighted and micro rows."""
    keys = list(keys)
    rows = _scored(pred, labels, keys, y, proba, "_scope")
    auc = kept(binary_auc(rows, [*keys, "_scope"], "_score", "pos", F.col("neg")))
    own = auc.where(F.col("_scope") != "micro")
    complete = F.count("auc") == F.lit(len(labels))
    means = own.groupBy(*keys).agg(
        F.when(complete, F.avg("auc")).alias("_macro"),
        F.when(complete, F.sum(F.col("auc") * F.col("n_pos")) / F.sum("n_pos")).alias("_weighted"),
    )
    means = means.select(
        *keys,
        F.inline(
            F.array(
                F.struct(F.lit("macro").alias("scope"), F.col("_macro").alias("auc")),
                F.struct(F.lit("weighted").alias("scope"), F.col("_weighted").alias("auc")),
            )
        ),
    )
    return auc.select(*keys, F.col("_scope").alias("scope"), "auc").unionByName(means)


def roc_points(
    pred: DataFrame, labels: Sequence[int], keys: Sequence[str], k: int | None = None, y: str = "y_true",
    proba: str = "probability", micro: bool = True,
) -> DataFrame:
    """False and true positive rate at every distinct score, highest score first.

    ``k`` thins each curve to about k points at evenly spaced row counts (first and last are kept).
    """
    keys = list(keys)
    rows = _scored(pred, labels, keys, y, proba, "scope", micro)
    part = [*keys, "scope"]
    totals = running_totals(rows, part, "_score", {"pos": F.col("pos"), "neg": F.col("neg")}, ascending=False)
    sizes = totals.groupBy(*part).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = join_small(totals, sizes, part)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    if k:
        before, total = F.col("before_pos") + F.col("before_neg"), F.col("_p") + F.col("_n")
        step = lambda at: F.floor(at * F.lit(k) / total)
        keep = (before == 0) | (tp + fp == total) | (step(tp + fp) > step(before))
        points = points.where(keep)
    return points.where((F.col("_p") > 0) & (F.col("_n") > 0)).select(
        *part, F.col("_score").alias("threshold"), (fp / F.col("_n")).alias("fpr"), (tp / F.col("_p")).alias("tpr")
    )


def confidence_histogram(
    pred: DataFrame, bins: int = 10, keys: Sequence[str] = (), y: str = "y_true", p: str = "y_pred", proba: str = "probability"
) -> DataFrame:
    """Counts of the largest class share in equal bins of [0, 1], by correct and incorrect."""
    share = F.array_max(proba)
    rows = pred.where(F.col(y).isNotNull() & share.isNotNull())
    at = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(*keys, (F.col(y) == F.col(p)).alias("correct"), at.alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    ).select(*keys, "correct", "bin", (F.col("bin") / F.lit(float(bins))).alias("bin_start"), "n")


def prediction_columns(pred: DataFrame, task: str, y: str = "y_true", p: str = "y_pred", proba: str = "probability") -> DataFrame:
    """Residual (regression), or correct flag and confidence (classification)."""
    if task == "regression":
        return pred.withColumn("residual", F.col(y) - F.col(p))
    out = pred.withColumn("correct", (F.col(y) == F.col(p)).cast("int"))
    return out.withColumn("predicted_confidence", F.array_max(proba)) if proba in pred.columns else out


def filter_predictions(
    pred: DataFrame, file: str | None = None, split: str | None = None, limit: int | None = None, order: Sequence[str] = ()
) -> DataFrame:
    """Rows of one model file and one split; ``limit`` is the preview size (sorted by ``order``)."""
    out = pred
    if file is not None:
        out = out.where(F.col("file") == file)
    if split is not None:
        out = out.where(F.col("split") == split)
    if limit is not None:
        out = out.orderBy(*order).limit(limit) if order else out.limit(limit)
    return out
