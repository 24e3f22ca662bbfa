"""Queries: correlations, moments, rank tests, collinearity, normality."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from studyframe.functions.columns import round_doubles as rd
from studyframe.operators import htests as h, selection as sel, stats as st
from studyframe.operators.labels import class_from_thresholds
from studyframe.operators.quality import _long
from studyframe.plans.fixtures import F1, F2, F3, FEATURES, KEYS, class_predictions, predictions, samples
from studyframe.plans.registry import query

COLS = [*FEATURES, "discount_n", "y"]


def _matrix_sql(corr) -> str:
    """All ordered pairs; ``corr(a, b)`` gives the SQL of one unordered pair."""
    lines = []
    for a, b in combinations(COLS, 2):
        lines.append(f"SELECT '{a}' AS a, '{b}' AS b, r FROM ({corr(a, b)}) UNION ALL SELECT '{b}', '{a}', r FROM ({corr(a, b)})")
    lines += [f"SELECT '{a}', '{a}', 1.0::DOUBLE" for a in COLS]
    return " UNION ALL ".join(lines)


PEARSON = _matrix_sql(lambda a, b: f"SELECT round(corr({a}, {b}), 6) + 0.0::DOUBLE AS r FROM f1")


@query("corr_pearson", f"WITH {F1} {PEARSON}")
def corr_pearson(spark, sf):
    return rd(st.corr_pearson(samples(spark, sf), COLS))


def _rank(c, source="f1"):
    return f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0"


SPEARMAN = _matrix_sql(
    lambda a, b: f"SELECT round(corr(x, z), 6) + 0.0::DOUBLE AS r FROM (SELECT ({_rank(a)})::DOUBLE AS x, ({_rank(b)})::DOUBLE AS z FROM f1 WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
)


@query("corr_spearman", f"WITH {F1} {SPEARMAN}")
def corr_spearman(spark, sf):
    return rd(st.corr_spearman(samples(spark, sf), COLS))


@query("top_correlations", f"WITH {F1}, m AS ({PEARSON}) SELECT b AS feature, r, abs(r) AS abs_r FROM m WHERE a = 'y' AND b <> 'y'")
def top_correlations(spark, sf):
    return sel.top_correlations(rd(st.corr_pearson(samples(spark, sf), COLS)), "y")


def _per(template: str, cols=COLS) -> str:
    return " UNION ALL ".join(template.replace("{c}", c) for c in cols)


MOM = _per("SELECT '{c}' AS \"column\", count({c}) AS n, avg({c}) AS mean, stddev_samp({c}) AS sd, skewness({c}) AS skew, kurtosis({c}) AS exkurt FROM f1")


@query("moments", f"WITH {F1}, m AS ({MOM}) SELECT \"column\", n, round(mean, 8) AS mean, round(sd, 8) AS sd, round(skew, 8) + 0.0::DOUBLE AS skew, round(exkurt, 8) + 0.0::DOUBLE AS exkurt FROM m")
def moments(spark, sf):
    return rd(st.moments(samples(spark, sf), COLS).select("column", "n", "mean", "sd", "skew", "exkurt"), 8)


DAGOSTINO = f"""m AS ({MOM}), a AS (SELECT "column", n::DOUBLE AS n, skew * (n - 2) / sqrt(n::DOUBLE * (n - 1)) AS g1, (exkurt * (n - 2)::DOUBLE * (n - 3) / (n - 1) - 6) / (n + 1) AS g2 FROM m),
b AS (SELECT *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) AS yy, 3 * (n*n + 27*n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
  (g2 + 3 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) AS x,
  6 * (n*n - 5*n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS rt FROM a),
c AS (SELECT *, sqrt(2 * (beta2 - 1)) - 1 AS w2, 6 + 8 / rt * (2 / rt + sqrt(1 + 4 / (rt * rt))) AS aa FROM b),
d AS (SELECT *, asinh(yy / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) AS z1, 1 + x * sqrt(2 / (aa - 4)) AS dn FROM c),
e AS (SELECT *, (1 - 2 / (9 * aa) - sign(dn) * pow((1 - 2 / aa) / abs(dn), 1.0::DOUBLE / 3)) / sqrt(2 / (9 * aa)) AS z2 FROM d)"""


@query("dagostino_k2", f"""WITH {F1}, {DAGOSTINO} SELECT "column", n::BIGINT AS n, round(z1*z1 + z2*z2, 3) AS dagostino_k2, round(exp(-(z1*z1 + z2*z2) / 2), 6) AS dagostino_p FROM e""")
def dagostino_k2(spark, sf):
    out = st.dagostino_k2(st.moments(samples(spark, sf), COLS))
    return out.select("column", "n", F.round("dagostino_k2", 3).alias("dagostino_k2"), F.round("dagostino_p", 6).alias("dagostino_p"))


def _phi(z: str) -> str:
    """SQL of the normal distribution function by its power series: z * (1 + z²/3 * (1 + z²/5 * (...)))."""
    series = "1"
    for odd in range(161, 1, -2):
        series = f"(1 + {z} * {z} / {odd} * {series})"
    return f"CASE WHEN {z} < -7 THEN 0 WHEN {z} > 7 THEN 1 ELSE 0.5::DOUBLE + exp(-{z} * {z} / 2) / sqrt(2 * pi()) * {z} * {series} END"


def _scores(source: str, share: str, out: str) -> str:
    """CTEs that add ``z``, the inverse normal of ``share``: a published rough start, mended by Halley steps."""
    ctes = [f"{out}_0 AS (SELECT *, {share} AS p_, sqrt(-2 * ln(least({share}, 1 - ({share})))) AS t_ FROM {source})"]
    ctes.append(f"{out}_1 AS (SELECT * EXCLUDE (t_), sign(p_ - 0.5) * (t_ - (2.515517 + 0.802853 * t_ + 0.010328 * t_ * t_) / (1 + 1.432788 * t_ + 0.189269 * t_ * t_ + 0.001308 * t_ * t_ * t_)) AS x_ FROM {out}_0)")
    for i in (2, 3, 4):
        ctes.append(f"{out}_{i}s AS (SELECT *, ({_phi('x_')} - p_) * sqrt(2 * pi()) * exp(x_ * x_ / 2) AS e_ FROM {out}_{i - 1})")
        ctes.append(f"{out}_{i} AS (SELECT * EXCLUDE (e_) REPLACE (x_ - e_ / (1 + x_ * e_ / 2) AS x_) FROM {out}_{i}s)")
    return ", ".join(ctes) + f", {out} AS (SELECT * EXCLUDE (p_, x_), x_ AS z FROM {out}_4)"


def _ordered_sql(source: str, keys: str) -> str:
    """CTE ``o``: values v of the source with their place i, n, mean and the deviations."""
    w = f"PARTITION BY {keys}"
    return f"""o AS (SELECT *, v - m AS c FROM (SELECT {keys}, v, row_number() OVER ({w} ORDER BY v) AS i, count(*) OVER ({w}) AS n, avg(v) OVER ({w}) AS m,
      stddev_samp(v) OVER ({w}) AS sd, stddev_pop(v) OVER ({w}) AS sp FROM {source} WHERE v IS NOT NULL))"""


def _ad_sql(keys: str, z: str, clip: bool = False) -> str:
    """CTE ``ad``: A² of the ordered rows."""
    f, s = _phi("zz"), _phi("(-zz)")
    if clip:
        f = f"least(greatest({f}, 1e-12::DOUBLE), 1 - 1e-12::DOUBLE)"
        s = f"(1 - {f})"
    return f"ad AS (SELECT {keys}, n, -n - sum((2 * i - 1) * ln({f}) + (2 * (n - i) + 1) * ln({s})) / n AS a2 FROM (SELECT *, {z} AS zz FROM o WHERE sd > 0) GROUP BY {keys}, n)"


def _shapiro_sql(keys: str) -> str:
    """CTE ``sw``: Shapiro-Wilk W and p of the ordered rows (12 or more per group)."""
    return _scores("o", "(i - 0.375::DOUBLE) / (n + 0.25::DOUBLE)", "q") + f""", s1 AS (SELECT {keys}, n, sum(z * z) AS ssm, sum(z * c) AS total, sum(c * c) AS ssq, max(z) AS mn, max(CASE WHEN i = n - 1 THEN z END) AS mn1,
      max(c) - min(c) AS outer_, max(CASE WHEN i = n - 1 THEN c END) - max(CASE WHEN i = 2 THEN c END) AS inner_, 1 / sqrt(n::DOUBLE) AS u FROM q GROUP BY {keys}, n),
    s2 AS (SELECT *, mn / sqrt(ssm) + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5 AS an,
      mn1 / sqrt(ssm) + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5 AS an1 FROM s1),
    s3 AS (SELECT *, least(1, (an * outer_ + an1 * inner_ + (total - mn * outer_ - mn1 * inner_) / sqrt((ssm - 2 * mn**2 - 2 * mn1**2) / (1 - 2 * an**2 - 2 * an1**2)))**2 / ssq) AS w, ln(n::DOUBLE) AS l FROM s2),
    s4 AS (SELECT *, (ln(1 - w) - (-1.5861 - 0.31082 * l - 0.083751 * l**2 + 0.0038915 * l**3)) / exp(-0.4803 - 0.082676 * l + 0.0030302 * l**2) AS zz FROM s3),
    sw AS (SELECT {keys}, n, w, {_phi('(-zz)')} AS p FROM s4)"""


LONG = "lg AS (" + _per("SELECT '{c}' AS \"column\", {c} AS v FROM f1") + ")"
def _critical(n: str = "n") -> str:
    return f"round(0.787::DOUBLE / (1 + 4.0::DOUBLE / {n} - 25.0::DOUBLE / ({n} * {n})), 3)"


NORMAL = "CASE WHEN {} THEN 'Approximately normal' ELSE 'Non-normal' END"


@query("anderson_darling_normal", f"""WITH {F1}, {LONG}, {_ordered_sql('lg', '"column"')}, {_ad_sql('"column"', 'c / sd')}
SELECT "column", n, round(a2, 6) AS anderson_statistic, {_critical()} AS anderson_critical_5pct, {NORMAL.format('a2 < ' + _critical())} AS anderson_decision_5pct FROM ad""")
def anderson_darling_normal(spark, sf):
    return rd(st.anderson_darling_normal(_long(samples(spark, sf), COLS)))


RESIDUALS = "rs AS (SELECT target, feature_set, model, part, y_true - y_pred AS v FROM f2)"
GROUP = "target, feature_set, model, part"
AD_RESIDUAL = f"{RESIDUALS}, {_ordered_sql('rs', GROUP)}, {_ad_sql(GROUP, 'c / (sp + 1e-12::DOUBLE)', True)}"


@query("ad_residual", f"WITH {F2}, {AD_RESIDUAL} SELECT {GROUP}, n, CASE WHEN n >= 5 THEN round(a2, 6) END AS ad_stat FROM ad")
def ad_residual(spark, sf):
    return rd(st.ad_residual(predictions(spark, sf), [*KEYS, "part"]))


SHAPIRO = f"""{_ordered_sql('lg', '"column"')}, {_shapiro_sql('"column"')}"""
SHAPIRO_COLUMNS = f"""round(w, 6) AS shapiro_w, round(p, 6) + 0.0::DOUBLE AS shapiro_p, {NORMAL.format('p >= 0.05')} AS normality_decision_shapiro,
  CASE WHEN sw.n > 5000 THEN 'For n > 5000 the Shapiro-Wilk p-value may be less accurate.' END AS note"""


@query("shapiro_wilk", f"""WITH {F1}, {LONG}, {SHAPIRO} SELECT "column", n, {SHAPIRO_COLUMNS} FROM sw""")
def shapiro_wilk(spark, sf):
    return rd(st.shapiro_wilk(_long(samples(spark, sf), COLS)))


@query("normality_table", f"""WITH {F1}, {LONG}, {DAGOSTINO}, {SHAPIRO}, {_ad_sql('"column"', 'c / sd')}
SELECT m."column", m.n, round(m.mean, 6) AS mean, round(m.sd, 6) AS std, round(m.skew, 6) + 0.0::DOUBLE AS skewness, round(m.exkurt, 6) + 0.0::DOUBLE AS excess_kurtosis, round(z1*z1 + z2*z2, 3) AS dagostino_k2,
  round(exp(-(z1*z1 + z2*z2) / 2), 6) AS dagostino_p, round(a2, 6) AS anderson_statistic, {_critical('m.n')} AS anderson_critical_5pct,
  {NORMAL.format('a2 < ' + _critical('m.n'))} AS anderson_decision_5pct, 0.05::DOUBLE AS alpha, {SHAPIRO_COLUMNS}
FROM m JOIN e ON e."column" = m."column" JOIN sw ON sw."column" = m."column" JOIN ad ON ad."column" = m."column" """)
def normality_table(spark, sf):
    out = st.normality_table(samples(spark, sf), COLS)
    return rd(out.withColumn("dagostino_k2", F.round("dagostino_k2", 3)))


QQ_SHARE = "CASE WHEN i = n THEN 0.5::DOUBLE ** (1.0::DOUBLE / n) WHEN i = 1 THEN 1 - 0.5::DOUBLE ** (1.0::DOUBLE / n) ELSE (i - 0.3175::DOUBLE) / (n + 0.365::DOUBLE) END"


@query("qq_points", f"""WITH {F1}, lg AS (SELECT 'y' AS k, y AS v FROM f1), {_ordered_sql('lg', 'k')}, {_scores('o', QQ_SHARE, 'q')}, f AS (SELECT regr_slope(v, z) AS slope, avg(v) AS intercept, corr(v, z) AS r FROM q)
SELECT i AS rank, round(z, 6) + 0.0::DOUBLE AS theoretical, round(v, 6) AS ordered, round(f.slope, 6) AS slope, round(f.intercept, 6) AS intercept, round(f.r, 6) AS r FROM q, f""")
def qq_points(spark, sf):
    return rd(st.qq_points(samples(spark, sf), "y"))


@query("residual_diagnostics", f"""WITH {F2}, r AS (SELECT target, feature_set, model, part, y_true - y_pred AS e FROM f2)
SELECT target, feature_set, model, part, count(*) AS n, round(avg(e), 6) AS residual_bias, round(stddev_samp(e), 6) AS residual_sd, round(skewness(e), 6) AS residual_skewness, round(kurtosis(e), 6) AS residual_kurtosis FROM r GROUP BY ALL""")
def residual_diagnostics(spark, sf):
    """The columns SQL can express; A² and Shapiro-Wilk of the same groups are in the next query."""
    out = st.residual_diagnostics(predictions(spark, sf), [*KEYS, "part"])
    return rd(out.select(*KEYS, "part", "n", "residual_bias", "residual_sd", "residual_skewness", "residual_kurtosis"))


@query("residual_normality", f"""WITH {F2}, {AD_RESIDUAL}, {_shapiro_sql(GROUP)}
SELECT {GROUP}, n, CASE WHEN n >= 5 THEN round(a2, 6) END AS ad_stat, CASE WHEN n BETWEEN 3 AND 5000 THEN round(w, 6) END AS shapiro_w, CASE WHEN n BETWEEN 3 AND 5000 THEN round(p, 6) + 0.0::DOUBLE END AS shapiro_p
FROM ad JOIN sw USING ({GROUP}, n)""")
def residual_normality(spark, sf):
    out = st.residual_diagnostics(predictions(spark, sf), [*KEYS, "part"])
    return rd(out.select(*KEYS, "part", "n", "ad_stat", "shapiro_w", "shapiro_p"))


MWU_COLS = ["quantity", "discount", "size", "retail"]


@query("mann_whitney_median", f"""WITH {F1}, q AS (SELECT *, y <= (SELECT quantile_cont(y, 0.5) FROM f1) AS low FROM f1), """ + ", ".join(
    f"r_{c} AS (SELECT '{c}' AS feature, low, ({_rank(c)})::DOUBLE AS r FROM q)" for c in MWU_COLS
) + ", al AS (" + " UNION ALL ".join(f"SELECT * FROM r_{c}" for c in MWU_COLS) + """),
s AS (SELECT feature, sum(CASE WHEN low THEN r END) AS r1, count(*) FILTER (low) AS n_low, count(*) FILTER (NOT low) AS n_high FROM al GROUP BY feature),
u AS (SELECT *, r1 - n_low::DOUBLE * (n_low + 1) / 2 AS uu FROM s)
SELECT feature, round(uu, 1) AS "U", round((uu - n_low::DOUBLE * n_high / 2) / sqrt(n_low::DOUBLE * n_high * (n_low + n_high + 1) / 12), 6) + 0.0::DOUBLE AS "Z", n_low, n_high FROM u""")
def mann_whitney_median(spark, sf):
    out = h.mann_whitney_median(samples(spark, sf), "y", MWU_COLS)
    return out.select("feature", F.round("U", 1).alias("U"), (F.round("Z", 6) + 0.0).alias("Z"), "n_low", "n_high")


KW = f"""q AS (SELECT *, CASE WHEN y < 20 THEN 0 WHEN y > 60 THEN 2 ELSE 1 END AS cls FROM f1), al AS (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, cls, ({_rank(c)})::DOUBLE AS r, {c} AS v FROM q WHERE {c} IS NOT NULL" for c in [*MWU_COLS, "discount_n", "y"]
) + """), t AS (SELECT feature, sum(k::DOUBLE^3 - k) AS ties FROM (SELECT feature, v, count(*) AS k FROM al GROUP BY ALL) GROUP BY feature),
g AS (SELECT feature, cls, count(*)::DOUBLE AS n, sum(r) AS rs FROM al GROUP BY ALL), hh AS (SELECT feature, sum(n) AS n, sum(rs*rs/n) AS b, max(CASE WHEN cls = 0 THEN n END) AS n0, max(CASE WHEN cls = 1 THEN n END) AS n1, max(CASE WHEN cls = 2 THEN n END) AS n2 FROM g GROUP BY feature),
kw AS (SELECT feature, (12 / (n * (n + 1)) * b - 3 * (n + 1)) / (1 - ties / (n^3 - n)) AS h, n0, n1, n2 FROM hh JOIN t USING (feature))"""


def _classes(spark, sf):
    return class_from_thresholds(samples(spark, sf), "y", 20.0, 60.0, "cls")


@query("kruskal_wallis", f"""WITH {F1}, {KW} SELECT feature, round(h, 4) AS kruskal_h, round(exp(-h/2), 6) AS p_value, exp(-h/2) < 0.05 AS significant_0_05, n0::BIGINT AS n_class_0, n1::BIGINT AS n_class_1, n2::BIGINT AS n_class_2, 'omnibus test' AS note FROM kw""")
def kruskal_wallis(spark, sf):
    out = h.kruskal_wallis(_classes(spark, sf), "cls", [*MWU_COLS, "discount_n", "y"])
    return out.withColumns({"kruskal_h": F.round("kruskal_h", 4), "p_value": F.round("p_value", 6)})


@query("pairwise_mwu", f"""WITH {F1}, {KW}, pr AS (SELECT feature, a.v AS g1, b.v AS g2 FROM kw, (VALUES (0),(1),(2)) a(v), (VALUES (0),(1),(2)) b(v) WHERE a.v < b.v AND exp(-h/2) < 0.05),
x AS (SELECT pr.feature, g1, g2, cls = g1 AS f, rank() OVER (PARTITION BY pr.feature, g1, g2 ORDER BY v) + (count(*) OVER (PARTITION BY pr.feature, g1, g2, v) - 1)/2.0 AS r FROM pr JOIN al ON al.feature = pr.feature AND (cls = g1 OR cls = g2))
SELECT feature, g1 AS group_1, g2 AS group_2, count(*) FILTER (f) AS n_group_1, count(*) FILTER (NOT f) AS n_group_2, round(sum(CASE WHEN f THEN r END)::DOUBLE - count(*) FILTER (f)::DOUBLE * (count(*) FILTER (f) + 1)/2, 1) AS "U" FROM x GROUP BY feature, g1, g2""")
def pairwise_mwu(spark, sf):
    rows = _classes(spark, sf)
    features = [*MWU_COLS, "discount_n", "y"]
    out = h.pairwise_mwu(rows, "cls", features, h.kruskal_wallis(rows, "cls", features))
    return out.select("feature", "group_1", "group_2", "n_group_1", "n_group_2", F.round("U", 1).alias("U"))


@query("pairwise_mwu_p")
def pairwise_mwu_p(spark, sf):
    """Raw and Holm-adjusted p-values of the pairwise tests (SQL has no normal tail)."""
    rows = _classes(spark, sf)
    features = [*MWU_COLS, "discount_n", "y"]
    out = h.pairwise_mwu(rows, "cls", features, h.kruskal_wallis(rows, "cls", features))
    return out.select("feature", "group_1", "group_2", "p_raw", "p_holm", "significant_holm")


@query("holm_adjust", f"""WITH {F1}, pv AS (SELECT label AS family, brand AS member, round(exp(-abs(corr(retail, y)) * sqrt(count(*))), 6) AS p FROM f1 GROUP BY ALL),
s AS (SELECT *, least(1, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p) + 1) * p) AS st FROM pv)
SELECT family, member, p, round(max(st) OVER (PARTITION BY family ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM s""")
def holm_adjust(spark, sf):
    groups = samples(spark, sf).groupBy(F.col("label").alias("family"), F.col("brand").alias("member"))
    p = groups.agg(F.round(F.exp(-F.abs(F.corr("retail", "y")) * F.sqrt(F.count(F.lit(1)).cast("double"))), 6).alias("p"))
    return rd(h.holm_adjust(p, "p", ["family"]))


@query("split_similarity", f"""WITH {F3}, c AS (SELECT y_true, count(*) FILTER (part = 'train') + 1e-10::DOUBLE AS a, count(*) FILTER (part = 'test') + 1e-10::DOUBLE AS b FROM f3 GROUP BY y_true),
s AS (SELECT a / sum(a) OVER () AS s, b / sum(b) OVER () AS t FROM c), x AS (SELECT sum((s-t)^2/t) AS chi2, count(*) AS classes FROM s)
SELECT round(chi2, 9) AS chi2, classes, round(exp(-chi2/2), 6) AS p, exp(-chi2/2) <= 0.1 AS differs FROM x""")
def split_similarity(spark, sf):
    out = h.split_similarity(class_predictions(spark, sf), "y_true", "part")
    return out.select(F.round("chi2", 9).alias("chi2"), "classes", F.round("p", 6).alias("p"), "differs")


@query("vif", f"""WITH {F1}, r AS (SELECT corr(quantity, retail) AS r FROM f1) SELECT f AS feature, round(1 / (1 - r*r), 9) AS vif FROM r, (VALUES ('quantity'), ('retail')) v(f)""")
def vif(spark, sf):
    return rd(st.vif(samples(spark, sf), ["quantity", "retail"]), 9)


@query("vif_all")
def vif_all(spark, sf):
    return rd(st.vif(samples(spark, sf), [*FEATURES, "y"]), 9)


@query("ols_fit", f"""WITH {F1}, a AS (SELECT count(*) AS n, regr_r2(y, quantity) AS r1, regr_intercept(y, quantity) AS i1, corr(y, quantity) AS ya, corr(y, retail) AS yb, corr(quantity, retail) AS ab,
  avg(y) AS my, avg(quantity) AS mq, avg(retail) AS mr, var_pop(quantity) AS vq, var_pop(retail) AS vr, covar_pop(y, quantity) AS cq, covar_pop(y, retail) AS cr, covar_pop(quantity, retail) AS c FROM f1)
SELECT 'y' AS target, 'fs1' AS feature_set, n, 1 AS n_features, round(r1, 6) AS r2, round(i1, 6) AS intercept FROM a
UNION ALL SELECT 'y', 'fs2', n, 2, round((ya*ya + yb*yb - 2*ya*yb*ab)/(1 - ab*ab), 6), round(my - (cq*vr - cr*c)/(vq*vr - c*c)*mq - (cr*vq - cq*c)/(vq*vr - c*c)*mr, 6) FROM a""")
def ols_fit(spark, sf):
    table = samples(spark, sf)
    return rd(st.ols_fit(table, "y", ["quantity"], "fs1").unionByName(st.ols_fit(table, "y", ["quantity", "retail"], "fs2")))


@query("anova_type2", f"""WITH {F1}, a AS (SELECT count(*)::DOUBLE AS n, var_pop(y) AS vy, var_pop(quantity) AS vq, var_pop(retail) AS vr, covar_pop(y, quantity) AS cq, covar_pop(y, retail) AS cr, covar_pop(quantity, retail) AS c FROM f1),
b AS (SELECT *, vq*vr - c*c AS det, (cq*vr - cr*c)/(vq*vr - c*c) AS b1, (cr*vq - cq*c)/(vq*vr - c*c) AS b2 FROM a),
s AS (SELECT n, b1*b1*n*det/vr AS s1, b2*b2*n*det/vq AS s2, n*(vy - b1*cq - b2*cr) AS res FROM b)
SELECT 'quantity' AS feature, round(s1, 4) AS sum_sq, 1.0::DOUBLE AS df, round(s1/(res/(n-3)), 6) AS f FROM s UNION ALL SELECT 'retail', round(s2, 4), 1.0, round(s2/(res/(n-3)), 6) FROM s
UNION ALL SELECT 'Residual', round(res, 4), n - 3, NULL FROM s""")
def anova_type2(spark, sf):
    out = st.anova_type2(samples(spark, sf), "y", ["quantity", "retail"])
    return out.select("feature", F.round("sum_sq", 4).alias("sum_sq"), "df", F.round("f", 6).alias("f"))


@query("anova_type2_p")
def anova_type2_p(spark, sf):
    return st.anova_type2(samples(spark, sf), "y", FEATURES)
