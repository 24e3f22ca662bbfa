import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyframe.operators import metrics as m


@pytest.fixture(scope="module")
def classes(spark):
    rng = np.random.default_rng(5)
    n = 300
    truth = rng.integers(0, 3, n)
    scores = np.round(rng.random((n, 3)) + 0.6 * np.eye(3)[truth], 1)
    proba = scores / scores.sum(axis=1, keepdims=True)
    pdf = pd.DataFrame({"g": "x", "y_true": truth, "y_pred": proba.argmax(axis=1), "probability": [r.tolist() for r in proba]})
    return pdf, proba, spark.createDataFrame(pdf)


def test_regression_edge_cases(spark):
    rows = [("one", 1.0, 1.0), ("flat", 2.0, 2.0), ("flat", 2.0, 2.0), ("off", 2.0, 3.0), ("off", 2.0, 2.0), ("nan", float("nan"), 1.0), ("nan", 1.0, 1.5), ("nan", 2.0, 2.0)]
    got = {r["k"]: r for r in m.regression_metrics(spark.createDataFrame(rows, "k string, y_true double, y_pred double"), ["k"]).collect()}
    assert got["one"]["r2"] is None and got["one"]["n"] == 1
    assert got["flat"]["r2"] == 1.0 and got["flat"]["ios"] is None and got["flat"]["ioa"] is None
    assert got["off"]["r2"] == 0.0 and got["off"]["p20"] == 50.0
    assert got["nan"]["n"] == 2 and got["nan"]["bias"] == 0.25


def test_regression_against_numpy(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(5, 2, 200)
    p = y + rng.normal(0, 1, 200)
    row = m.regression_metrics(spark.createDataFrame(pd.DataFrame({"y_true": y, "y_pred": p})), []).first()
    e = p - y
    assert math.isclose(row["r2"], 1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    assert math.isclose(row["ioa"], 1 - (e**2).sum() / ((abs(p - y.mean()) + abs(y - y.mean())) ** 2).sum())
    assert math.isclose(row["ios"], 1 - math.sqrt((e**2).mean()) / y.std())
    assert math.isclose(row["p20"], 100 * (abs(e) <= 0.2 * abs(y)).mean())


def auc(pos, neg):
    return float(np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg]))


def test_auc_with_ties(classes):
    pdf, proba, df = classes
    got = {r["scope"]: r["auc"] for r in m.auc_ovr(df, [0, 1, 2], ["g"]).collect()}
    own = [auc(proba[pdf["y_true"] == c, c], proba[pdf["y_true"] != c, c]) for c in range(3)]
    for c in range(3):
        assert math.isclose(got[str(c)], own[c], rel_tol=1e-12)
    assert math.isclose(got["macro"], np.mean(own), rel_tol=1e-12)
    onehot = np.eye(3)[pdf["y_true"]].astype(bool)
    assert math.isclose(got["micro"], auc(proba[onehot], proba[~onehot]), rel_tol=1e-12)


def test_roc_area_equals_auc(classes):
    pdf, proba, df = classes
    points = m.roc_points(df, [0, 1, 2], ["g"]).where("scope = '1'").toPandas().sort_values("threshold", ascending=False)
    x, y = np.r_[0, points["fpr"]], np.r_[0, points["tpr"]]
    area = float(np.sum(np.diff(x) * (y[1:] + y[:-1]) / 2))
    assert math.isclose(area, auc(proba[pdf["y_true"] == 1, 1], proba[pdf["y_true"] != 1, 1]), rel_tol=1e-9)
    thin = m.roc_points(df, [0, 1, 2], ["g"], k=5).where("scope = '1'").toPandas()
    assert len(thin) < len(points) and thin["fpr"].max() == 1.0


def test_hard_label_scores(classes):
    pdf, _, df = classes
    cells = m.confusion_long(df, [0, 1, 2, 3], ["g"])
    assert cells.count() == 16
    row = m.classification_metrics(m.confusion_long(df, [0, 1, 2], ["g"]), ["g"]).first()
    cm = pd.crosstab(pdf["y_true"], pdf["y_pred"]).reindex(index=range(3), columns=range(3), fill_value=0).to_numpy(float)
    t, p, tp, s = cm.sum(1), cm.sum(0), np.diag(cm), cm.sum()
    f1 = 2 * tp / (t + p)
    assert math.isclose(row["macro_f1"], f1.mean()) and math.isclose(row["weighted_f1"], (f1 * t).sum() / s)
    assert math.isclose(row["mcc"], (tp.sum() * s - t @ p) / math.sqrt((s * s - p @ p) * (s * s - t @ t)))
    pe = t @ p / s**2
    assert math.isclose(row["cohen_kappa"], (tp.sum() / s - pe) / (1 - pe))
    four = m.classification_metrics(cells, ["g"]).first()
    assert math.isclose(four["macro_f1"], f1.sum() / 4) and math.isclose(four["balanced_accuracy"], row["balanced_accuracy"])


def test_log_loss_and_confidence(classes):
    pdf, proba, df = classes
    want = -np.mean(np.log(proba[np.arange(len(pdf)), pdf["y_true"]]))
    assert math.isclose(m.log_loss(df, [0, 1, 2], ["g"]).first()["log_loss"], want, rel_tol=1e-9)
    assert sum(r["n"] for r in m.confidence_histogram(df).collect()) == len(pdf)


def test_alignment_rules(spark):
    df = spark.createDataFrame([([0.2, -0.5, 0.6],), ([0.0, 0.0, 0.0],)], "s array<double>")
    rows = m.align_probabilities(df, "s", [0, 1, 2], classes=[2, 1, 0]).collect()
    assert rows[0]["probability"] == pytest.approx([0.75, 0.0, 0.25]) and rows[1]["probability"] == pytest.approx([1 / 3] * 3)
    with pytest.raises(Exception, match="no positive class score"):
        m.align_probabilities(df, "s", [0, 1, 2], strict=True).collect()
    margin = spark.createDataFrame([([1.5],)], "s array<double>")
    got = m.align_probabilities(margin, "s", [0, 1], mode="margin").first()["probability"]
    assert got == pytest.approx([1 / (1 + math.exp(3)), 1 / (1 + math.exp(-3))])


def test_band_accuracy_variants(spark):
    df = spark.createDataFrame([(1.0, 1.0), (5.0, 1.1), (5.0, 6.0)], "y_true double, y_pred double").withColumn("k", F.lit(1))
    assert m.band_metrics(df, 0.5, 2.0, ["k"]).first()["band_accuracy"] == 1.0
    assert math.isclose(m.band_metrics(df, 0.5, 2.0, ["k"], truth_based=True).first()["band_accuracy"], 2 / 3)


def test_auc_and_roc_read_the_predictions_once(spark, monkeypatch):
    from studyframe.functions import running

    rng = np.random.default_rng(5)
    rows = [(f"m{i % 2}", int(y), [float(v) for v in np.round(p, 2)]) for i, (y, p) in enumerate(zip(rng.integers(0, 3, 600), rng.dirichlet([1, 1, 1], 600)))]
    read = spark.sparkContext.accumulator(0)

    def seen(row):
        read.add(1)
        return row

    frame = lambda: spark.createDataFrame(spark.sparkContext.parallelize(rows, 4).map(seen), "model string, y_true int, probability array<double>")
    plain = {(r["model"], r["scope"]): r["auc"] for r in m.auc_ovr(frame(), [0, 1, 2], ["model"]).collect()}
    assert read.value == 600 and len(plain) == 12
    monkeypatch.setattr(running, "ROWS_PER_BUCKET", 10)
    cut = {(r["model"], r["scope"]): r["auc"] for r in m.auc_ovr(frame(), [0, 1, 2], ["model"]).collect()}
    assert cut == pytest.approx(plain) and read.value == 1200
    for model in ("m0", "m1"):
        y = np.array([[int(t == c) for c in range(3)] for who, t, _ in rows if who == model])
        p = np.array([v for who, _, v in rows if who == model])
        gap = lambda a, b: ((a[:, None] > b) + (a[:, None] == b) / 2).mean()
        for c in range(3):
            assert cut[model, str(c)] == pytest.approx(gap(p[y[:, c] == 1, c], p[y[:, c] == 0, c]))
        assert cut[model, "micro"] == pytest.approx(gap(p[y == 1], p[y == 0]))
    points = m.roc_points(frame(), [0, 1, 2], ["model"]).collect()
    assert read.value == 1800 and max(r["tpr"] for r in points) == 1.0
