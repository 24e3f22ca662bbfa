"""Queries: coercion, schema resolution, row filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.columns import round_doubles as rd, safe_file_name, steady
from studyframe.operators import joins as j, labels as lab, schema as sc, selection as sel
from studyframe.operators.metrics import prediction_columns
from studyframe.plans.fixtures import CLB, F1, F2, F3, FEATURES, KEYS, LB, class_fold_scores, class_leaderboard, class_predictions, leaderboard, predictions, samples
from studyframe.plans.registry import query, steady_sql
from studyframe.sources.tables import read_table
from studyframe.spec import StudySpec

# ------------------------------------------------------------------ text that should be numbers

TXT = """tx AS (SELECT p_partkey AS id,
  CASE p_partkey % 7 WHEN 0 THEN ' 1.5 ' WHEN 1 THEN 'abc' WHEN 2 THEN 'NaN' WHEN 3 THEN '' WHEN 4 THEN CAST(p_size AS VARCHAR) WHEN 5 THEN '1e3' ELSE '-' || p_size END AS mixed,
  CASE WHEN p_size = 50 THEN 'n/a' ELSE CAST(p_size AS VARCHAR) END AS nearly, p_type AS words, p_retailprice AS price FROM part)"""


def _texts(spark, sf):
    part = read_table(spark, sf, "part")
    turn = F.col("p_partkey") % 7
    size = F.col("p_size").cast("string")
    mixed = (
        F.when(turn == 0, " 1.5 ").when(turn == 1, "abc").when(turn == 2, "NaN").when(turn == 3, "").when(turn == 4, size)
        .when(turn == 5, "1e3").otherwise(F.concat(F.lit("-"), size))
    )
    return part.select(
        F.col("p_partkey").alias("id"), mixed.alias("mixed"), F.when(F.col("p_size") == 50, "n/a").otherwise(size).alias("nearly"),
        F.col("p_type").alias("words"), F.col("p_retailprice").alias("price"),
    )


_D = "CASE WHEN isfinite(try_cast({0} AS DOUBLE)) THEN try_cast({0} AS DOUBLE) END"


@query("to_double", f"WITH {TXT} SELECT id, {_D.format('mixed')} AS mixed, {_D.format('nearly')} AS nearly FROM tx")
def to_double(spark, sf):
    return sc.to_double(_texts(spark, sf), ["mixed", "nearly"]).select("id", "mixed", "nearly")


_RATIO = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count({c}) AS n_nonnull, count({_D.format(c)}) AS n_numeric, round(count({_D.format(c)})::DOUBLE / count({c}), 6) AS ratio FROM tx"
    for c in ("mixed", "nearly", "words", "price")
)


@query("numeric_ratio", f"WITH {TXT} {_RATIO}")
def numeric_ratio(spark, sf):
    return rd(sc.numeric_ratio(_texts(spark, sf), ["mixed", "nearly", "words", "price"]))


@query("detect_numeric", steady_sql(f"""WITH {TXT}, r AS ({_RATIO}), d AS (SELECT "column" FROM r WHERE ratio >= 0.90)
SELECT 'nearly' AS "column", count({_D.format('nearly')}) AS n, round(avg({_D.format('nearly')}), 6) AS mean FROM tx WHERE 'nearly' IN (SELECT * FROM d)
UNION ALL SELECT 'price', count(price), round(avg(price), 6) FROM tx WHERE 'price' IN (SELECT * FROM d)"""))
def detect_numeric(spark, sf):
    """Mean of every column that counts as numeric."""
    table = _texts(spark, sf).drop("id")
    found = sc.detect_numeric(table)
    facts = {c: {"n": F.count(sc._num(table, c)), "mean": F.avg(sc._num(table, c))} for c in found}
    return steady(sc.column_facts(table, facts))


# ------------------------------------------------------------------ study specification

SPEC = StudySpec(
    targets={
        "Y": {"fs1": ["Quantity", "discount_n", "TAX"], "fs2": ["quantity", "size", "retail"], "fs3": ["quantity", "no_such_column"]},
        "retail": {"fs1": ["quantity", "discount-n"], "fs4": ["size"]},
    }
)


def _spec_counts(spark, sf, policy):
    table = samples(spark, sf)
    usable = sc.resolve_feature_sets(SPEC, table.columns, policy)
    sets = {}
    for target, name, feature, ordinal in usable:
        sets.setdefault((target, name), []).append((feature, ordinal))
    target_of = sc.resolve_columns(list(SPEC.targets), table.columns)
    facts = {}
    for (target, name), features in sets.items():
        complete = F.col(target_of[target]).isNotNull()
        for feature, _ in features:
            complete = complete & F.col(feature).isNotNull()
        facts[(target, name)] = F.count_if(complete)
    row = table.agg(*[e.alias(f"_{i}") for i, e in enumerate(facts.values())])
    lines = [
        F.struct(F.lit(t).alias("target"), F.lit(s).alias("feature_set"), F.lit(f).alias("feature"), F.lit(o).alias("ordinal"), F.col(f"_{i}").alias("n_complete"))
        for i, (t, s) in enumerate(facts) for f, o in sets[(t, s)]
    ]
    return row.select(F.inline(F.array(*lines)))


_SPEC_SQL = {
    ("Y", "fs1"): ("quantity", "discount_n", "tax"), ("Y", "fs2"): ("quantity", "size", "retail"), ("Y", "fs3"): ("quantity",),
    ("retail", "fs1"): ("quantity", "discount_n"), ("retail", "fs4"): ("size",),
}


def _spec_sql(keys):
    return f"WITH {F1} " + " UNION ALL ".join(
        f"SELECT '{t}' AS target, '{s}' AS feature_set, '{f}' AS feature, {i} AS ordinal, (SELECT count(*) FROM f1 WHERE y IS NOT NULL AND "
        + " AND ".join(f"{c} IS NOT NULL" for c in _SPEC_SQL[(t, s)]) + ") AS n_complete"
        for t, s in keys for i, f in enumerate(_SPEC_SQL[(t, s)])
    )


@query("resolve_feature_sets", _spec_sql([k for k in _SPEC_SQL if k != ("Y", "fs3")]))
def resolve_feature_sets(spark, sf):
    """Usable feature sets (strict) with their complete rows."""
    return _spec_counts(spark, sf, "strict")


@query("resolve_feature_sets_lenient", _spec_sql(list(_SPEC_SQL)))
def resolve_feature_sets_lenient(spark, sf):
    return _spec_counts(spark, sf, "lenient")


@query("resolve_columns", f"""WITH {F1} SELECT 'Discount N' AS wanted, 'discount_n' AS resolved, count(discount_n) AS n_nonnull FROM f1
UNION ALL SELECT 'RETAIL', 'retail', count(retail) FROM f1 UNION ALL SELECT 'none such', NULL, 0 FROM (SELECT 1)""")
def resolve_columns(spark, sf):
    table = samples(spark, sf)
    match = sc.resolve_columns(["Discount N", "RETAIL", "none such"], table.columns)
    return sc.column_facts(
        table, {w: {"resolved": F.lit(c).cast("string"), "n_nonnull": F.count(c) if c else F.lit(0).cast("bigint")} for w, c in match.items()}
    ).withColumnRenamed("column", "wanted")


@query("leakage_guard", f"WITH {F1} SELECT 'Y' AS target, 'fs2' AS feature_set, count(*) FILTER (y = quantity OR y = size OR y = retail) AS n_equal, count(*) AS n FROM f1")
def leakage_guard(spark, sf):
    """The guard must pass; the rows in which a feature equals the target are counted."""
    sc.leakage_guard(SPEC)
    same = (F.col("y") == F.col("quantity")) | (F.col("y") == F.col("size")) | (F.col("y") == F.col("retail"))
    return samples(spark, sf).agg(F.count_if(same).alias("n_equal"), F.count(F.lit(1)).alias("n")).select(
        F.lit("Y").alias("target"), F.lit("fs2").alias("feature_set"), "n_equal", "n"
    )


@query("derive_difference", steady_sql(f"WITH {F1} SELECT grp, count(*) AS n, round(avg(retail - y), 6) AS mean_margin FROM f1 GROUP BY grp"))
def derive_difference(spark, sf):
    out = sc.derive_difference(samples(spark, sf), "margin", "retail", "y")
    return steady(out.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("margin").alias("mean_margin")))


@query("drop_empty_rows", """WITH z AS (SELECT nullif(l_discount, 0) AS a, nullif(l_tax, 0) AS b, CASE WHEN l_quantity <> 1 THEN 1 / (l_quantity - 2) END AS c0 FROM lineitem),
z2 AS (SELECT a, b, CASE WHEN isfinite(c0) THEN c0 END AS c FROM z) SELECT count(*) AS n, count(a) AS n_a, count(b) AS n_b, count(c) AS n_c FROM z2 WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""")
def drop_empty_rows(spark, sf):
    line = read_table(spark, sf, "lineitem")
    infinite = F.when(F.col("l_quantity") == 2, float("inf")).otherwise(1 / F.nullif(F.col("l_quantity") - 2, F.lit(0.0)))
    table = line.select(
        F.nullif("l_discount", F.lit(0.0)).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"), F.when(F.col("l_quantity") != 1, infinite).alias("c")
    )
    return sc.drop_empty_rows(table).agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in "abc"])


@query("complete_cases", steady_sql(f"WITH {F1} SELECT label, count(*) AS n, round(avg(y), 6) AS mean_y FROM f1 WHERE discount_n IS NOT NULL AND y IS NOT NULL GROUP BY label"))
def complete_cases(spark, sf):
    out = sc.complete_cases(samples(spark, sf), ["y", "discount_n", "quantity"])
    return steady(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("validate_groups", """SELECT event_id, CASE event_id % 997 WHEN 0 THEN ' ' WHEN 1 THEN 'NaN' WHEN 2 THEN ' None ' ELSE ' u' || user_id END AS grp FROM events
WHERE event_id % 997 < 3 ORDER BY event_id LIMIT 20""")
def validate_groups(spark, sf):
    """The first 20 rows without a usable group."""
    turn = F.col("event_id") % 997
    grp = F.when(turn == 0, " ").when(turn == 1, "NaN").when(turn == 2, " None ").otherwise(F.concat(F.lit(" u"), F.col("user_id").cast("string")))
    table = read_table(spark, sf, "events").select("event_id", grp.alias("grp"))
    return sc.invalid_groups(table, "grp", ["event_id"])


# ------------------------------------------------------------------ leaderboards


@query("drop_alias_models", f"WITH {LB}, a AS (SELECT *, CASE WHEN r2_test > 0.9 THEN 'Best_' || model ELSE model END AS m2 FROM lb) SELECT target, feature_set, m2 AS model FROM a WHERE NOT contains(lower(m2), 'best')")
def drop_alias_models(spark, sf):
    lb = leaderboard(spark, sf)
    lb = lb.withColumn("model", F.when(F.col("r2_test") > 0.9, F.concat(F.lit("Best_"), "model")).otherwise(F.col("model")))
    return sc.drop_alias_models(lb).select(*KEYS)


@query("normalize_leaderboard", f"WITH {LB} SELECT target, feature_set, model, r2_train, cv_r2_mean, cv_r2_std, NULL::DOUBLE AS r2_test, mae_test, rmse_test FROM lb")
def normalize_leaderboard(spark, sf):
    lb = leaderboard(spark, sf)
    odd = lb.select(
        "target", F.col("feature_set").alias("fs"), "model", F.col("r2_train").alias("train_r2"), F.col("cv_r2_mean").cast("string").alias("outer_cv_r2"),
        F.col("cv_r2_std").alias("cv_r2_sd"), "mae_test", F.col("rmse_test").alias("test_rmse"),
    )
    return sc.normalize_leaderboard(odd, "regression").select(*KEYS, "r2_train", "cv_r2_mean", "cv_r2_std", "r2_test", "mae_test", "rmse_test")


@query("class_from_thresholds", "SELECT l_returnflag AS flag, CASE WHEN l_extendedprice < 20000 THEN 0 WHEN l_extendedprice > 60000 THEN 2 ELSE 1 END AS label, count(*) AS n FROM lineitem GROUP BY ALL")
def class_from_thresholds(spark, sf):
    line = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), "l_extendedprice")
    return lab.class_from_thresholds(line, "l_extendedprice", 20000.0, 60000.0).groupBy("flag", "label").agg(F.count(F.lit(1)).alias("n"))


@query("encode_labels", "WITH k AS (SELECT *, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM part) SELECT p_brand AS brand, code, count(*) AS n FROM k GROUP BY ALL")
def encode_labels(spark, sf):
    return lab.encode_labels(read_table(spark, sf, "part").select(F.col("p_brand").alias("brand")), "brand", "code").groupBy("brand", "code").agg(F.count(F.lit(1)).alias("n"))


_MODE_COLS = {"quality": "labels", "l_quantity": "lineitem", "l_extendedprice": "lineitem", "l_returnflag": "lineitem"}


def _mode_sql():
    parts = []
    for c in ("l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber"):
        text = c == "l_returnflag"
        num = f"try_cast({c} AS DOUBLE)"
        parts.append(f"SELECT '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {num}) AS n_distinct, count(*) FILTER ({c} IS NOT NULL AND {num} IS NULL) AS n_unreadable FROM lineitem")
    return "WITH f AS (" + " UNION ALL ".join(parts) + """) SELECT *, CASE WHEN n = 0 THEN 'threshold' WHEN n_unreadable > 0 THEN 'categorical'
  WHEN n_distinct <= greatest(20, ceil(sqrt(n))) AND n_distinct / n <= 0.20 THEN 'categorical' ELSE 'threshold' END AS mode FROM f"""


@query("target_mode", _mode_sql())
def target_mode(spark, sf):
    return lab.target_mode_facts(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_returnflag", "l_linenumber"])


@query("boundary_text", """SELECT p_brand AS brand, 'price ' || p_brand AS target, format('Low: {} < {:.4f}; Mid: {:.4f} <= {} <= {:.4f}; High: {} > {:.4f}', 'price', lo, lo, 'price', up, 'price', up) AS text
FROM (SELECT p_brand, min(p_retailprice) AS lo, max(p_retailprice) AS up FROM part GROUP BY p_brand)""")
def boundary_text(spark, sf):
    limits = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("up"))
    text = lab.boundary_text("price", F.col("lo"), F.col("up"), ("Low", "Mid", "High"))
    return limits.select("brand", F.concat(F.lit("price "), "brand").alias("target"), text.alias("text"))


@query("flatten_results", f"""WITH {CLB}, p AS (SELECT target, feature_set, model, max(CASE WHEN part='val' THEN macro_f1 END) AS vf, max(CASE WHEN part='val' THEN accuracy END) AS va,
 max(CASE WHEN part='test' THEN macro_f1 END) AS tf, max(CASE WHEN part='test' THEN accuracy END) AS ta FROM csc GROUP BY ALL)
SELECT target, feature_set, model, round(vf, 6) AS val_macro_f1, round(va, 6) AS val_accuracy, round(tf, 6) AS test_macro_f1, round(ta, 6) AS test_accuracy FROM p""")
def flatten_results(spark, sf):
    scores = class_fold_scores(class_predictions(spark, sf))
    pack = lambda part: F.max(F.when(F.col("part") == part, F.struct("macro_f1", "accuracy")))
    nested = scores.groupBy(*KEYS).agg(pack("val").alias("validation"), pack("test").alias("test"))
    return rd(sc.flatten_results(nested))


# ------------------------------------------------------------------ joins


@query("attach_metadata", "SELECT l_returnflag AS flag, s_nationkey AS nation, count(*) AS n, count(s_name) AS n_known FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL")
def attach_metadata(spark, sf):
    line = read_table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("key"), F.col("l_returnflag").alias("flag"))
    meta = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), "s_name")
    return j.attach_metadata(line, meta, "key").groupBy("flag", "nation").agg(F.count(F.lit(1)).alias("n"), F.count("s_name").alias("n_known"))


@query("attach_rank", f"""WITH {LB}, rk AS (SELECT target, feature_set, model, rank() OVER (PARTITION BY target ORDER BY cv_r2_mean DESC) AS selection_rank FROM lb)
SELECT f2.target, f2.feature_set, f2.model, selection_rank, count(*) AS n FROM f2 LEFT JOIN rk USING (target, feature_set, model) WHERE part = 'test' GROUP BY ALL""")
def attach_rank(spark, sf):
    from studyframe.operators.ranking import rank_min

    ranks = leaderboard(spark, sf).select(*KEYS, rank_min("cv_r2_mean", False, ["target"]).alias("selection_rank"))
    rows = j.attach_rank(predictions(spark, sf).where("part = 'test'"), ranks, KEYS)
    return rows.groupBy(*KEYS, "selection_rank").agg(F.count(F.lit(1)).alias("n"))


@query("attach_split", steady_sql(f"""WITH {F1}, sp AS (SELECT grp, CASE WHEN CAST('0x' || substr(md5('7|' || grp), 1, 8) AS BIGINT) % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM (SELECT DISTINCT grp FROM f1))
SELECT split, label, count(*) AS n, round(avg(y), 6) AS mean_y FROM f1 JOIN sp USING (grp) GROUP BY ALL"""))
def attach_split(spark, sf):
    from studyframe.functions.columns import draw32

    table = samples(spark, sf)
    split = table.select("grp").distinct().withColumn("split", F.when(draw32(F.lit(7), "grp") % 5 == 0, "test").otherwise("train"))
    return steady(j.attach_split(table, split, "grp", by_group=True).groupBy("split", "label").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("group_overlap", "SELECT o_custkey AS \"group\" FROM (SELECT o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM orders) GROUP BY o_custkey HAVING count(DISTINCT split) > 1")
def group_overlap(spark, sf):
    split = read_table(spark, sf, "orders").select("o_custkey", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split"))
    return j.group_overlap(split, "o_custkey")


@query("split_coverage", """WITH s AS (SELECT o_orderkey AS row_id FROM orders WHERE o_orderkey % 11 <> 3 UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 13 = 5 UNION ALL SELECT -1 - c_custkey FROM customer WHERE c_custkey < 3),
c AS (SELECT row_id, count(*) AS k FROM s GROUP BY row_id)
SELECT coalesce(o_orderkey, row_id) AS row_id, CASE WHEN o_orderkey IS NULL THEN 'unknown row' WHEN k IS NULL THEN 'in no part' ELSE 'in several parts' END AS problem
FROM orders FULL JOIN c ON o_orderkey = row_id WHERE o_orderkey IS NULL OR k IS NULL OR k > 1""")
def split_coverage(spark, sf):
    rows = read_table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"))
    extra = read_table(spark, sf, "customer").where("c_custkey < 3").select((-1 - F.col("c_custkey")).alias("row_id"))
    split = rows.where("row_id % 11 <> 3").unionByName(rows.where("row_id % 13 = 5")).unionByName(extra)
    return j.split_coverage(rows, split)


@query("intersect_groups", "SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%' INTERSECT SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '5%'")
def intersect_groups(spark, sf):
    orders = read_table(spark, sf, "orders")
    return j.intersect_groups(orders.where("o_orderpriority LIKE '1%'"), orders.where("o_orderpriority LIKE '5%'"), "o_custkey")


# ------------------------------------------------------------------ top-k and sets


BEST = [("cv_r2_mean", False), ("cv_r2_std", True), ("model", True)]


@query("best_per_feature_set", f"WITH {LB} SELECT target, feature_set, model, cv_r2_mean, cv_r2_std FROM lb QUALIFY row_number() OVER (PARTITION BY target, feature_set ORDER BY cv_r2_mean DESC NULLS LAST, cv_r2_std NULLS LAST, model) = 1")
def best_per_feature_set(spark, sf):
    return sel.best_per_feature_set(leaderboard(spark, sf), BEST).select(*KEYS, "cv_r2_mean", "cv_r2_std")


@query("best_overall", f"WITH {LB} SELECT target, feature_set, model, cv_r2_mean FROM lb ORDER BY cv_r2_mean DESC NULLS LAST, cv_r2_std NULLS LAST, abs(r2_train - cv_r2_mean) NULLS LAST, model LIMIT 1")
def best_overall(spark, sf):
    lb = leaderboard(spark, sf).withColumn("gap", F.abs(F.col("r2_train") - F.col("cv_r2_mean")))
    return sel.best_overall(lb, [("cv_r2_mean", False), ("cv_r2_std", True), ("gap", True), ("model", True)]).select(*KEYS, "cv_r2_mean")


@query("pick_model", f"""WITH {LB}, rk AS (SELECT model || '_' || feature_set || '_' || target || '.pkl' AS file, rank() OVER (ORDER BY cv_r2_mean DESC) AS rank FROM lb),
ar AS (SELECT DISTINCT file FROM f2 WHERE grp = 'S1' AND feature_set <> 'A') SELECT file, rank FROM rk WHERE file IN (SELECT file FROM ar) ORDER BY rank, file LIMIT 1""")
def pick_model(spark, sf):
    from studyframe.operators.ranking import rank_min

    lb = leaderboard(spark, sf).withColumn("file", F.concat("model", F.lit("_"), "feature_set", F.lit("_"), "target", F.lit(".pkl")))
    lb = lb.withColumn("selection_rank", rank_min("cv_r2_mean", False))
    artifacts = predictions(spark, sf).where("grp = 'S1' AND feature_set <> 'A'").select("file").distinct()
    return sel.pick_model(lb, artifacts)


@query("natural_sort", "SELECT p_brand AS brand, row_number() OVER (ORDER BY lower(regexp_replace(p_brand, '[0-9]+$', '')), CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS BIGINT), p_brand) AS place, count(*) AS n FROM part GROUP BY p_brand")
def natural_sort(spark, sf):
    from pyspark.sql import Window as W

    brands = read_table(spark, sf, "part").groupBy(F.col("p_brand").alias("brand")).agg(F.count(F.lit(1)).alias("n"))
    return brands.withColumn("place", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*sel.natural_order("brand"))).cast("bigint"))


@query("union_reports", f"""WITH {LB}, {CLB} SELECT target, feature_set, model, 'regression' AS task, cv_r2_mean, NULL::DOUBLE AS cv_macro_f1 FROM lb
UNION ALL SELECT target, feature_set, model, 'classification', NULL, cv_macro_f1 FROM clb""")
def union_reports(spark, sf):
    reg = leaderboard(spark, sf).select(*KEYS, F.lit("regression").alias("task"), "cv_r2_mean")
    cls = class_leaderboard(spark, sf).select(*KEYS, F.lit("classification").alias("task"), "cv_macro_f1")
    return sel.union_reports(reg, cls)


@query("distinct_selected", f"WITH {F2} SELECT DISTINCT file, part AS scope FROM f2")
def distinct_selected(spark, sf):
    return sel.distinct_selected(predictions(spark, sf).select("file", F.col("part").alias("scope")))


@query("feature_union", """WITH s AS (SELECT l_returnflag AS target, 'fs' || l_linenumber AS feature_set, 'f' || (l_partkey % 40) AS feature, CAST(l_quantity AS INTEGER) AS ordinal FROM lineitem),
f AS (SELECT feature, min((target, feature_set, ordinal)) AS first FROM s GROUP BY feature) SELECT feature, row_number() OVER (ORDER BY first, feature) AS position FROM f""")
def feature_union(spark, sf):
    line = read_table(spark, sf, "lineitem")
    spec = line.select(
        F.col("l_returnflag").alias("target"), F.concat(F.lit("fs"), F.col("l_linenumber").cast("string")).alias("feature_set"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 40).cast("string")).alias("feature"), F.col("l_quantity").cast("int").alias("ordinal"),
    )
    return sel.feature_union(spec)


@query("upsert_manifest", """WITH o AS (SELECT s_suppkey AS key, s_nationkey AS nation, 'old' AS version FROM supplier), n AS (SELECT DISTINCT l_suppkey AS key, -1 AS nation, 'new' AS version FROM lineitem WHERE l_quantity = 50 AND l_discount = 0.1)
SELECT * FROM o WHERE key NOT IN (SELECT key FROM n) UNION ALL SELECT * FROM n""")
def upsert_manifest(spark, sf):
    old = read_table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("nation"), F.lit("old").alias("version"))
    new = read_table(spark, sf, "lineitem").where("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_suppkey").alias("key"), F.lit(-1).alias("nation"), F.lit("new").alias("version")).distinct()
    return sel.upsert_manifest(old, new, ["key"])


@query("safe_file_name", f"SELECT DISTINCT p_name AS name, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS safe FROM part")
def safe_names(spark, sf):
    return read_table(spark, sf, "part").select(F.col("p_name").alias("name"), safe_file_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("safe")).distinct()


@query("model_name_parts", f"WITH {F2} SELECT DISTINCT file, model, feature_set, target FROM f2")
def model_name_parts(spark, sf):
    """Model, feature set and target read back from the file names."""
    from studyframe.functions.columns import model_name_parts as parts

    model, fs, target = parts(F.col("file"))
    return predictions(spark, sf).select("file").distinct().select("file", model.alias("model"), fs.alias("feature_set"), target.alias("target"))
