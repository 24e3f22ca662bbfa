"""Study tables built from the provided tables, each with the SQL text of the same table.

samples       lineitem with part: features, continuous target ``y``, group, label
predictions   predictions of 25 "models" on those samples (train, cv and test parts)
class_pred    class predictions with three scores from lineitem
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from studyframe.functions.columns import draw32, kept, spread, with_row_id
from studyframe.operators.metrics import classification_metrics, confusion_long, regression_metrics
from studyframe.sources.tables import read_table

FEATURES = ["quantity", "discount", "tax", "size", "retail"]

# ------------------------------------------------------------------ samples

_LINE = [
    "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus",
]


def _row_hash() -> list:
    """Parts of a lineitem row's hash: integers and texts only, so that every engine prints them alike."""
    hundredths = lambda name: F.round(F.col(name) * 100).cast("bigint")
    return [
        *[F.col(c) for c in _LINE[:4]],
        *[hundredths(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")],
        F.col("l_returnflag"),
        F.col("l_linestatus"),
    ]


HASH_SQL = (
    "md5(concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_quantity*100) AS BIGINT), "
    "CAST(round(l_extendedprice*100) AS BIGINT), CAST(round(l_discount*100) AS BIGINT), CAST(round(l_tax*100) AS BIGINT), "
    "l_returnflag, l_linestatus))"
)
F1 = f"""f1 AS (
  SELECT {HASH_SQL} || '#' || row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity,
         l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus) AS row_id,
         l_quantity AS quantity, l_discount AS discount, nullif(l_discount, 0) AS discount_n, l_tax AS tax,
         CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, l_extendedprice / 1000.0 AS y,
         'S' || l_suppkey AS grp, l_returnflag AS label, l_linestatus AS status, p_brand AS brand, l_partkey AS partkey
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def samples(spark: SparkSession, sf: str, identity: bool = False) -> DataFrame:
    line = read_table(spark, sf, "lineitem").select(*_LINE)
    if not identity:
        line = spread(line)
    part = read_table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice", "p_brand")
    if identity:
        line = with_row_id(line, "row_id", _row_hash())
    joined = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.select(
        *(["row_id"] if identity else []),
        F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"),
        F.when(F.col("l_discount") != 0, F.col("l_discount")).alias("discount_n"),
        F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("size"),
        F.col("p_retailprice").alias("retail"),
        (F.col("l_extendedprice") / 1000.0).alias("y"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("grp"),
        F.col("l_returnflag").alias("label"),
        F.col("l_linestatus").alias("status"),
        F.col("p_brand").alias("brand"),
        F.col("l_partkey").alias("partkey"),
    )


# ------------------------------------------------------------------ regression predictions

F2 = """f2 AS (
  SELECT model, feature_set, target, model || '_' || feature_set || '_' || target || '.pkl' AS file, part, fold, grp, y_true,
         CASE WHEN part = 'train' THEN y_true + (y_cv - y_true) * 0.6 ELSE y_cv END AS y_pred
  FROM (
    SELECT *, unnest(CASE WHEN is_test THEN ['test'] ELSE ['train', 'cv'] END) AS part
    FROM (
      SELECT b.*, y_true * (1.0 - k * 0.006) + (quantity - 25.5)
             * ((CASE feature_set WHEN 'A' THEN 0.5 WHEN 'N' THEN 1.0 ELSE 1.8 END) * (1.0 + fold * (k % 4) * 0.1)) AS y_cv
      FROM (
        SELECT 'M' || regexp_extract(p_brand, '([0-9]+)', 1) AS model, l_returnflag AS feature_set, 'price' || l_linestatus AS target,
               'S' || l_suppkey AS grp, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS k, l_quantity AS quantity,
               l_extendedprice / 1000.0 AS y_true, h % 5 = 0 AS is_test,
               CASE WHEN h % 5 = 0 THEN -1 ELSE CAST((h // 5) % 5 AS INTEGER) END AS fold
        FROM (SELECT *, CAST('0x' || substr(HASH, 1, 8) AS BIGINT) AS h FROM lineitem) JOIN part ON l_partkey = p_partkey) b)))""".replace(
    "HASH", HASH_SQL
)


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    line = spread(read_table(spark, sf, "lineitem").select(*_LINE)).withColumn("_h", draw32(*_row_hash()))
    part = read_table(spark, sf, "part").select("p_partkey", "p_brand")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey"))
    number = F.regexp_extract("p_brand", "([0-9]+)", 1)
    test = F.col("_h") % 5 == 0
    rows = rows.select(
        F.concat(F.lit("M"), number).alias("model"),
        F.col("l_returnflag").alias("feature_set"),
        F.concat(F.lit("price"), F.col("l_linestatus")).alias("target"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("grp"),
        number.cast("int").alias("k"),
        F.col("l_quantity").alias("quantity"),
        (F.col("l_extendedprice") / 1000.0).alias("y_true"),
        test.alias("is_test"),
        F.when(test, F.lit(-1)).otherwise((F.floor(F.col("_h") / 5) % 5).cast("int")).alias("fold"),
    )
    weight = F.when(F.col("feature_set") == "A", 0.5).when(F.col("feature_set") == "N", 1.0).otherwise(1.8)
    y_cv = F.col("y_true") * (1.0 - F.col("k") * 0.006) + (F.col("quantity") - 25.5) * (
        weight * (1.0 + F.col("fold") * (F.col("k") % 4) * 0.1)
    )
    parts = F.when(F.col("is_test"), F.array(F.lit("test"))).otherwise(F.array(F.lit("train"), F.lit("cv")))
    rows = rows.withColumn("y_cv", y_cv).withColumn("part", F.explode(parts))
    fitted = F.col("y_true") + (F.col("y_cv") - F.col("y_true")) * 0.6
    return rows.select(
        "model", "feature_set", "target",
        F.concat(F.col("model"), F.lit("_"), F.col("feature_set"), F.lit("_"), F.col("target"), F.lit(".pkl")).alias("file"),
        "part", "fold", "grp", "y_true",
        F.when(F.col("part") == "train", fitted).otherwise(F.col("y_cv")).alias("y_pred"),
    )


KEYS = ["target", "feature_set", "model"]

# One row per (target, feature set, model): train, CV and test scores, rounded so ranks are repeatable.
LB = F2 + """, sc AS (
  SELECT target, feature_set, model, part, CASE WHEN part = 'cv' THEN fold ELSE -1 END AS fold, count(*) AS n,
         CASE WHEN count(*) >= 2 THEN 1 - sum((y_true-y_pred)^2) / (var_pop(y_true) * count(*)) END AS r2,
         CASE WHEN count(*) >= 2 THEN avg(abs(y_true-y_pred)) END AS mae, CASE WHEN count(*) >= 2 THEN avg((y_true-y_pred)^2) END AS mse,
         CASE WHEN count(*) >= 2 THEN 100.0 * avg(CASE WHEN abs(y_pred-y_true) <= 0.2*(abs(y_true)+1e-12) THEN 1.0 ELSE 0.0 END) END AS p20,
         CASE WHEN count(*) >= 2 THEN 1 - sum((y_true-y_pred)^2) / sum((abs(y_pred-ym)+abs(y_true-ym))^2) END AS ioa,
         CASE WHEN count(*) >= 2 THEN 1 - sqrt(avg((y_true-y_pred)^2)) / stddev_pop(y_true) END AS ios
  FROM (SELECT *, avg(y_true) OVER (PARTITION BY target, feature_set, model, part, CASE WHEN part = 'cv' THEN fold ELSE -1 END) AS ym FROM f2)
  GROUP BY ALL),
lb AS (
  SELECT target, feature_set, model,
    round(max(CASE WHEN part='train' THEN r2 END), 6) AS r2_train,
    round(avg(CASE WHEN part='cv' THEN r2 END), 6) AS cv_r2_mean,
    round(stddev_samp(CASE WHEN part='cv' THEN r2 END), 6) AS cv_r2_std,
    round(max(CASE WHEN part='test' THEN r2 END), 6) AS r2_test,
    round(max(CASE WHEN part='test' THEN mae END), 6) AS mae_test,
    round(max(CASE WHEN part='test' THEN mse END), 4) AS mse_test,
    round(sqrt(max(CASE WHEN part='test' THEN mse END)), 6) AS rmse_test,
    round(max(CASE WHEN part='test' THEN p20 END), 6) AS p20_test,
    round(max(CASE WHEN part='test' THEN ioa END), 6) AS ioa_test,
    round(max(CASE WHEN part='test' THEN ios END), 6) AS ios_test
  FROM sc GROUP BY target, feature_set, model)"""


def fold_scores(pred: DataFrame, agreement: bool = True) -> DataFrame:
    """Scores per model and part; CV rows keep their fold, the others get -1."""
    fold = F.when(F.col("part") == "cv", F.col("fold")).otherwise(F.lit(-1))
    return regression_metrics(pred.withColumn("fold", fold), [*KEYS, "part", "fold"], agreement=agreement)


def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scores = fold_scores(predictions(spark, sf))
    of = lambda part, name: F.when(F.col("part") == part, F.col(name))
    test = ["mae", "rmse", "p20", "ioa", "ios"]
    # One row per model, read by many ranks: computed once.
    return kept(scores.groupBy(*KEYS).agg(
        F.round(F.max(of("train", "r2")), 6).alias("r2_train"),
        F.round(F.avg(of("cv", "r2")), 6).alias("cv_r2_mean"),
        F.round(F.stddev_samp(of("cv", "r2")), 6).alias("cv_r2_std"),
        F.round(F.max(of("test", "r2")), 6).alias("r2_test"),
        F.round(F.max(of("test", "mse")), 4).alias("mse_test"),
        *[F.round(F.max(of("test", c)), 6).alias(f"{c}_test") for c in test],
    ))


# ------------------------------------------------------------------ class predictions

LABELS = [0, 1, 2]
LOWER, UPPER = 20.0, 60.0

F3 = """f3 AS (
  SELECT 'M' || l_linenumber AS model, l_returnflag AS feature_set, 'price' || l_linestatus AS target, part, fold, grp, y_true,
         CASE WHEN shifted < 20.0 THEN 0 WHEN shifted > 60.0 THEN 2 ELSE 1 END AS y_pred,
         s0, s1, s2, s0 / (s0 + s1 + s2) AS p0, s1 / (s0 + s1 + s2) AS p1, s2 / (s0 + s1 + s2) AS p2
  FROM (
    SELECT *, 1.0 / (1.0 + abs(shifted - 10.0) / 10.0) AS s0, 1.0 / (1.0 + abs(shifted - 40.0) / 15.0) AS s1,
           1.0 / (1.0 + abs(shifted - 80.0) / 20.0) AS s2
    FROM (
      SELECT *, price + (l_quantity - 25.5) * l_linenumber * (CASE WHEN part = 'train' THEN 0.05 ELSE 0.1 END) AS shifted,
             CASE WHEN price < 20.0 THEN 0 WHEN price > 60.0 THEN 2 ELSE 1 END AS y_true
      FROM (
        SELECT *, unnest(CASE WHEN h % 10 = 0 THEN ['test'] WHEN h % 10 = 1 THEN ['val'] ELSE ['train', 'cv'] END) AS part,
               CASE WHEN h % 10 < 2 THEN -1 ELSE CAST((h // 10) % 5 AS INTEGER) END AS fold, 'S' || l_suppkey AS grp
        FROM (SELECT *, CAST('0x' || substr(HASH, 1, 8) AS BIGINT) AS h, l_extendedprice / 1000.0 AS price FROM lineitem)))))""".replace(
    "HASH", HASH_SQL
)


def class_predictions(spark: SparkSession, sf: str) -> DataFrame:
    from studyframe.operators.labels import class_from_thresholds

    line = spread(read_table(spark, sf, "lineitem").select(*_LINE))
    line = line.withColumn("_h", draw32(*_row_hash()))
    turn = F.col("_h") % 10
    parts = (
        F.when(turn == 0, F.array(F.lit("test"))).when(turn == 1, F.array(F.lit("val"))).otherwise(F.array(F.lit("train"), F.lit("cv")))
    )
    price = F.col("l_extendedprice") / 1000.0
    rows = line.withColumn("part", F.explode(parts)).select(
        F.concat(F.lit("M"), F.col("l_linenumber").cast("string")).alias("model"),
        F.col("l_returnflag").alias("feature_set"),
        F.concat(F.lit("price"), F.col("l_linestatus")).alias("target"),
        "part",
        F.when(turn < 2, F.lit(-1)).otherwise((F.floor(F.col("_h") / 10) % 5).cast("int")).alias("fold"),
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("grp"),
        price.alias("price"),
        (price + (F.col("l_quantity") - 25.5) * F.col("l_linenumber") * F.when(F.col("part") == "train", 0.05).otherwise(0.1)).alias("shifted"),
    )
    rows = class_from_thresholds(rows, "price", LOWER, UPPER, "y_true")
    rows = class_from_thresholds(rows, "shifted", LOWER, UPPER, "y_pred")
    near = lambda centre, width: 1.0 / (1.0 + F.abs(F.col("shifted") - centre) / width)
    rows = rows.withColumns({"s0": near(10.0, 10.0), "s1": near(40.0, 15.0), "s2": near(80.0, 20.0)})
    total = F.col("s0") + F.col("s1") + F.col("s2")
    rows = rows.withColumn("probability", F.array(*[F.col(f"s{i}") / total for i in range(3)]))
    return rows.drop("price", "shifted")


# Scores of hard labels for every (keys) group of a frame ``cm(keys, t, p, n)`` written as SQL.
def class_metric_sql(source: str, keys: str) -> str:
    return f"""(
  WITH cc AS (SELECT {keys}, y_true AS t, y_pred AS p, count(*)::DOUBLE AS n FROM {source} GROUP BY ALL),
  gr AS (SELECT DISTINCT {keys} FROM cc),
  pc AS (SELECT {keys}, c.label,
      coalesce(sum(CASE WHEN t = label AND p = label THEN n END), 0) AS tp,
      coalesce(sum(CASE WHEN t = label THEN n END), 0) AS support,
      coalesce(sum(CASE WHEN p = label THEN n END), 0) AS predicted
      FROM cc CROSS JOIN (VALUES (0), (1), (2)) c(label) GROUP BY ALL),
  pm AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS rc,
      CASE WHEN support + predicted > 0 THEN 2 * tp / (support + predicted) ELSE 0 END AS f1 FROM pc)
  SELECT {keys}, CAST(sum(support) AS BIGINT) AS n, sum(tp) / sum(support) AS accuracy, avg(CASE WHEN support > 0 THEN rc END) AS balanced_accuracy,
    avg(pr) AS macro_precision, avg(rc) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1,
    CASE WHEN sqrt(sum(support)^2 - sum(predicted^2)) * sqrt(sum(support)^2 - sum(support^2)) > 0
      THEN (sum(tp) * sum(support) - sum(support * predicted)) / (sqrt(sum(support)^2 - sum(predicted^2)) * sqrt(sum(support)^2 - sum(support^2))) ELSE 0 END AS mcc,
    CASE WHEN sum(support * predicted) / sum(support)^2 < 1 THEN (sum(tp) / sum(support) - sum(support * predicted) / sum(support)^2)
      / (1 - sum(support * predicted) / sum(support)^2) END AS cohen_kappa
  FROM pm GROUP BY {keys})"""


CLB = F3 + """, f3k AS (SELECT target, feature_set, model, part, CASE WHEN part = 'cv' THEN fold ELSE -1 END AS fold, y_true, y_pred FROM f3),
csc AS (SELECT * FROM """ + class_metric_sql("f3k", "target, feature_set, model, part, fold") + """),
clb AS (
  SELECT target, feature_set, model,
    round(max(CASE WHEN part='train' THEN macro_f1 END), 6) AS train_macro_f1,
    round(avg(CASE WHEN part='cv' THEN macro_f1 END), 6) AS cv_macro_f1,
    round(stddev_samp(CASE WHEN part='cv' THEN macro_f1 END), 6) AS cv_macro_f1_std,
    round(avg(CASE WHEN part='cv' THEN mcc END), 6) AS cv_mcc,
    round(avg(CASE WHEN part='cv' THEN balanced_accuracy END), 6) AS cv_balanced_accuracy,
    round(avg(CASE WHEN part='cv' THEN accuracy END), 6) AS cv_accuracy,
    round(max(CASE WHEN part='val' THEN macro_f1 END), 6) AS val_macro_f1,
    round(1 - max(CASE WHEN part='val' THEN balanced_accuracy END), 6) AS val_balanced_error,
    round(max(CASE WHEN part='test' THEN macro_f1 END), 6) AS test_macro_f1,
    round(max(CASE WHEN part='test' THEN balanced_accuracy END), 6) AS test_balanced_accuracy,
    round(max(CASE WHEN part='test' THEN mcc END), 6) AS test_mcc
  FROM csc GROUP BY target, feature_set, model)"""


def class_fold_scores(pred: DataFrame) -> DataFrame:
    keys = [*KEYS, "part", "fold"]
    fold = F.when(F.col("part") == "cv", F.col("fold")).otherwise(F.lit(-1))
    return classification_metrics(confusion_long(pred.withColumn("fold", fold), LABELS, keys), keys)


def class_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    scores = class_fold_scores(class_predictions(spark, sf))
    of = lambda part, name: F.when(F.col("part") == part, F.col(name))
    return kept(scores.groupBy(*KEYS).agg(
        F.round(F.max(of("train", "macro_f1")), 6).alias("train_macro_f1"),
        F.round(F.avg(of("cv", "macro_f1")), 6).alias("cv_macro_f1"),
        F.round(F.stddev_samp(of("cv", "macro_f1")), 6).alias("cv_macro_f1_std"),
        F.round(F.avg(of("cv", "mcc")), 6).alias("cv_mcc"),
        F.round(F.avg(of("cv", "balanced_accuracy")), 6).alias("cv_balanced_accuracy"),
        F.round(F.avg(of("cv", "accuracy")), 6).alias("cv_accuracy"),
        F.round(F.max(of("val", "macro_f1")), 6).alias("val_macro_f1"),
        F.round(1 - F.max(of("val", "balanced_accuracy")), 6).alias("val_balanced_error"),
        *[F.round(F.max(of("test", c)), 6).alias(f"test_{c}") for c in ("macro_f1", "balanced_accuracy", "mcc")],
    ))
