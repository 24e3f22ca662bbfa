"""Queries: class boundaries, bins, holdouts, folds and learning subsets."""

from __future__ import annotations

from pyspark.sql import functions as F

from studyframe.functions.columns import kept, round_doubles as rd, steady
from studyframe.operators import labels as lab, split as sp
from studyframe.plans.fixtures import F1, samples
from studyframe.plans.registry import query, steady_sql
from studyframe.sources.tables import read_table

H = "md5(concat_ws('|', 42, '{p}', {k}))"


def _rows(spark, sf):
    """Row identities with what the splits need; several passes read them, so they are kept."""
    return kept(samples(spark, sf, identity=True).select("row_id", "label"))


@query("auto_boundaries", f"WITH {F1} SELECT round(quantile_cont(y, 1.0/3), 6) AS lower, round(quantile_cont(y, 2.0/3), 6) AS upper, 'quantile' AS method FROM f1")
def auto_boundaries(spark, sf):
    return rd(lab.auto_boundaries(samples(spark, sf), "y"))


@query("auto_boundaries_cv", f"WITH {F1} SELECT round(quantile_cont(y, 0.25), 6) AS lower, round(quantile_cont(y, 0.75), 6) AS upper, 'training_quantiles' AS method FROM f1")
def auto_boundaries_cv(spark, sf):
    return rd(lab.auto_boundaries_cv(samples(spark, sf), "y", (0.25, 0.75)))


@query("auto_boundaries_cv_tied", """WITH c AS (SELECT v, count(*) AS k FROM (SELECT CASE WHEN l_linenumber >= 3 THEN 3 ELSE l_linenumber END::DOUBLE AS v FROM lineitem UNION ALL SELECT 9.0 + (c_custkey % 2) FROM customer WHERE c_custkey < 4) GROUP BY v),
u AS (SELECT v, sum(k) OVER (ORDER BY v) AS upto, sum(k) OVER () AS n, lead(v) OVER (ORDER BY v) AS nx FROM c),
p AS (SELECT abs(a.upto/a.n - 1.0/3) + abs(b.upto/b.n - 2.0/3) AS s, (a.v + a.nx)/2 AS lower, (b.v + b.nx)/2 AS upper FROM u a JOIN u b ON b.v > a.v WHERE a.upto >= 2 AND b.upto - a.upto >= 2 AND b.n - b.upto >= 2)
SELECT lower, upper, 'unique_value_cv_safe_fallback' AS method FROM p ORDER BY s, lower, upper LIMIT 1""")
def auto_boundaries_cv_tied(spark, sf):
    """A target with few distinct values, for which the quantiles coincide."""
    line = read_table(spark, sf, "lineitem").select(F.least(F.col("l_linenumber"), F.lit(3)).cast("double").alias("v"))
    extra = read_table(spark, sf, "customer").where("c_custkey < 4").select((9.0 + F.col("c_custkey") % 2).alias("v"))
    return lab.auto_boundaries_cv(line.unionByName(extra), "v")


@query("resolve_boundaries", f"WITH {F1} SELECT 25.0::DOUBLE AS lower, 75.0::DOUBLE AS upper, 'configured' AS source FROM f1 LIMIT 1")
def resolve_boundaries(spark, sf):
    return lab.resolve_boundaries(samples(spark, sf), "y", {"lower": 25.0, "upper": 75.0})


@query("quantile_labels", f"""WITH {F1}, e AS (SELECT quantile_cont(y, [0.2, 0.4, 0.6, 0.8]) AS q FROM f1)
SELECT (y > q[1])::INTEGER + (y > q[2])::INTEGER + (y > q[3])::INTEGER + (y > q[4])::INTEGER AS bin, count(*) AS n, min(y) AS lo, max(y) AS hi FROM f1, e GROUP BY ALL""")
def quantile_labels(spark, sf):
    return lab.quantile_labels(samples(spark, sf), "y").groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.min("y").alias("lo"), F.max("y").alias("hi"))


HOLD = H.format(p="holdout", k="row_id")


@query("split_random", f"WITH {F1}, r AS (SELECT row_id, row_number() OVER (ORDER BY {HOLD}) AS rn, count(*) OVER () AS n FROM f1) SELECT row_id, CASE WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM r")
def split_random(spark, sf):
    return sp.split_random(_rows(spark, sf).select("row_id"), "row_id", 0.2)


STRAT = f"""sz AS (SELECT label, count(*) AS s FROM f1 GROUP BY label), al AS (SELECT label, s, ceil(0.2::DOUBLE * sum(s) OVER ()) AS want, ceil(0.2::DOUBLE * sum(s) OVER ()) * s / sum(s) OVER () AS sh FROM sz),
tk AS (SELECT label, floor(sh) + CASE WHEN row_number() OVER (ORDER BY round(sh - floor(sh), 9) DESC, label) <= want - sum(floor(sh)) OVER () THEN 1 ELSE 0 END AS take FROM al),
rn AS (SELECT f1.*, row_number() OVER (PARTITION BY label ORDER BY {HOLD}) AS rn FROM f1)"""


@query("split_stratified", f"WITH {F1}, {STRAT} SELECT row_id, rn.label, CASE WHEN rn <= take THEN 'test' ELSE 'train' END AS split FROM rn JOIN tk ON rn.label = tk.label")
def split_stratified(spark, sf):
    return sp.split_stratified(_rows(spark, sf), "row_id", "label", 0.2)


GRP = f"""gs AS (SELECT grp, row_number() OVER (ORDER BY {H.format(p='holdout', k='grp')}) AS rn, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM f1)),
sg AS (SELECT f1.*, CASE WHEN rn <= ceil(0.2::DOUBLE * n) THEN 'test' ELSE 'train' END AS split FROM f1 JOIN gs USING (grp))"""


@query("split_grouped", steady_sql(f"WITH {F1}, {GRP} SELECT grp, split, count(*) AS n, round(avg(y), 6) AS mean_y FROM sg GROUP BY ALL"))
def split_grouped(spark, sf):
    out = sp.split_grouped(samples(spark, sf), "grp", 0.2)
    return steady(out.groupBy("grp", "split").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean_y")))


@query("validate_split", f"""WITH {F1}, {GRP} SELECT 'rows' AS "check", count(*) AS "value", 20 AS "limit", count(*) >= 20 AS ok FROM sg UNION ALL SELECT 'rows in ' || split, count(*), 10, count(*) >= 10 FROM sg GROUP BY split
UNION ALL SELECT 'rows of class ' || label, count(*), 5, count(*) >= 5 FROM sg GROUP BY label""")
def validate_split(spark, sf):
    return sp.validate_split(sp.split_grouped(samples(spark, sf), "grp", 0.2), label="label")


@query("split_report", steady_sql(f"""WITH {F1}, {GRP}, a AS (SELECT split, count(*)::DOUBLE AS n, avg(y) AS mean, stddev_samp(y) AS std, min(y) AS min, max(y) AS max, count(DISTINCT grp)::DOUBLE AS groups, count(*)::DOUBLE / (SELECT count(*) FROM sg) AS share FROM sg GROUP BY split)
SELECT 'part' AS section, split, unnest(['n', 'mean', 'std', 'min', 'max', 'groups', 'share']) AS key, round(unnest([n, mean, std, min, max, groups, share]), 6) AS value FROM a
UNION ALL SELECT 'class', split, label, count(*)::DOUBLE FROM sg GROUP BY split, label"""))
def split_report(spark, sf):
    return steady(sp.split_report(sp.split_grouped(samples(spark, sf), "grp", 0.2), "y", "label", "grp"))


DRAW = "CAST('0x' || substr(md5(concat_ws('|', 42, 'fold', {r}, row_id)), 1, 8) AS BIGINT)"


@query("kfold", f"WITH {F1} SELECT row_id, CAST({DRAW.format(r=0)} % 5 AS INTEGER) AS fold FROM f1")
def kfold(spark, sf):
    return sp.kfold(_rows(spark, sf).select("row_id"), "row_id", 5)


@query("kfold_exact", f"WITH {F1}, r AS (SELECT row_id, row_number() OVER (ORDER BY {H.format(p='fold0', k='row_id')}) AS rn, count(*) OVER () AS n FROM f1) SELECT row_id, {' + '.join(f'(rn > ceil(n*{i}/5))::INTEGER' for i in range(1, 5))} AS fold FROM r")
def kfold_exact(spark, sf):
    return sp.kfold(_rows(spark, sf).select("row_id"), "row_id", 5, exact=True)


@query("repeated_kfold", f"WITH {F1}, r AS (SELECT row_id, unnest([0, 1, 2]) AS repeat FROM f1) SELECT row_id, repeat, CAST({DRAW.format(r='repeat')} % 5 AS INTEGER) AS fold FROM r")
def repeated_kfold(spark, sf):
    return sp.repeated_kfold(_rows(spark, sf).select("row_id"), "row_id", 5, 3)


@query("group_kfold", f"""WITH {F1}, g AS (SELECT grp, count(*) AS s FROM f1 GROUP BY grp), o AS (SELECT grp, s, rank() OVER (ORDER BY s DESC, CAST('0x' || substr(md5('42|' || grp), 1, 8) AS BIGINT)) - 1 AS p FROM g)
SELECT grp, CAST(CASE WHEN (p // 5) % 2 = 0 THEN p % 5 ELSE 4 - p % 5 END AS INTEGER) AS fold, s AS n FROM o""")
def group_kfold(spark, sf):
    return sp.group_kfold(samples(spark, sf), "grp", 5, mode="snake").groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


GREEDY = """WITH RECURSIVE {f1}, g AS (SELECT grp, count(*) AS s FROM f1 GROUP BY grp), o AS (SELECT s, row_number() OVER (ORDER BY s DESC) AS i FROM g),
st(i, loads, s, fold) AS (SELECT 0::BIGINT, [0, 0, 0, 0, 0]::BIGINT[], 0::BIGINT, 0::BIGINT UNION ALL
  SELECT o.i, list_transform(range(1, 6), lambda f: loads[f] + CASE WHEN f = list_position(loads, list_min(loads)) THEN o.s ELSE 0 END), o.s, list_position(loads, list_min(loads)) - 1 FROM st JOIN o ON o.i = st.i + 1),
n AS (SELECT s, fold, sum(c) OVER (PARTITION BY s ORDER BY fold) AS upto, sum(c) OVER (PARTITION BY s ORDER BY fold) - c AS before_ FROM (SELECT s, fold, count(*) AS c FROM st WHERE i > 0 GROUP BY s, fold)),
r AS (SELECT grp, s, row_number() OVER (PARTITION BY s ORDER BY {h}) AS rn FROM g)
SELECT grp, CAST(fold AS INTEGER) AS fold, r.s AS n FROM r JOIN n ON r.s = n.s AND rn > before_ AND rn <= upto"""


@query("group_kfold_greedy", GREEDY.format(f1=F1, h=H.format(p="groups", k="grp")))
def group_kfold_greedy(spark, sf):
    return sp.group_kfold(samples(spark, sf), "grp", 5).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("stratified_kfold", f"""WITH {F1}, x AS (SELECT row_id, label, unnest([0, 1]) AS repeat FROM f1), r AS (SELECT *, row_number() OVER (PARTITION BY repeat, label ORDER BY md5(concat_ws('|', 42, 'fold', repeat, row_id))) AS rn, count(*) OVER (PARTITION BY repeat, label) AS n FROM x)
SELECT row_id, label, repeat, {' + '.join(f'(rn > ceil(n*{i}/5))::INTEGER' for i in range(1, 5))} AS fold FROM r""")
def stratified_kfold(spark, sf):
    return sp.stratified_kfold(_rows(spark, sf), "row_id", "label", 5, 2)


@query("stratified_group_kfold")
def stratified_group_kfold(spark, sf):
    return sp.stratified_group_kfold(samples(spark, sf), "grp", "label", 5).groupBy("grp", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("learning_subsets", f"""WITH {F1}, g AS (SELECT DISTINCT grp, CAST(CAST('0x' || substr(md5('5|' || grp), 1, 8) AS BIGINT) % 5 AS INTEGER) AS own FROM f1),
t AS (SELECT grp, f.v AS fold FROM g JOIN (VALUES (0),(1),(2),(3),(4)) f(v) ON own <> f.v), r AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5(concat_ws('|', 42 + fold, 'learn', grp))) AS rn, count(*) OVER (PARTITION BY fold) AS n FROM t)
SELECT fold, fr.v::DOUBLE AS fraction, grp AS "group" FROM r JOIN (VALUES (0.25), (0.5), (0.75), (1.0)) fr(v) ON rn <= greatest(1, ceil(fr.v::DOUBLE * n))""")
def learning_subsets(spark, sf):
    from studyframe.functions.columns import draw32

    rows = samples(spark, sf).withColumn("fold", (draw32(F.lit(5), "grp") % 5).cast("int"))
    return sp.learning_subsets(rows, "fold", "grp", [0.25, 0.5, 0.75, 1.0])
