import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyframe.functions import normal, special
from studyframe.operators import htests, quality, stats
from studyframe.operators.quality import _long


def phi(z):
    return 0.5 * math.erfc(-z / math.sqrt(2))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    n = 400
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": np.round(rng.exponential(size=n), 1), "c": rng.integers(0, 4, n).astype(float)})
    pdf["y"] = 2 * pdf["a"] - pdf["b"] + rng.normal(size=n)
    pdf["cls"] = np.where(pdf["y"] < -1, 0, np.where(pdf["y"] > 1, 2, 1))
    pdf.loc[:30, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    return pdf, df.withColumn("c", F.when(~F.isnan("c"), F.col("c")))


def test_published_tail_values():
    assert math.isclose(special.f_sf(1.01211, 1, 327), 0.31515, rel_tol=1e-3)
    assert math.isclose(special.chi2_sf(81.2427, 2), math.exp(-81.2427 / 2), rel_tol=1e-10)
    assert math.isclose(special.chi2_sf(7.814728, 3), 0.05, rel_tol=1e-5)
    assert math.isclose(special.beta_inc(2.5, 1.5, 0.3), 1 - special.beta_inc(1.5, 2.5, 0.7), rel_tol=1e-12)


def test_normal_score_sums_match_direct_sums():
    n = 60_000
    ranks = np.arange(1, n + 1, dtype=float)
    z = special._score_at(ranks, n, 0.375, 0.25)
    for first, last in ((1, n), (5, 40_000), (20_000, 59_999)):
        for power in (1, 2):
            want = math.fsum(z[first - 1 : last] ** power)
            assert math.isclose(special.normal_score_sum(first, last, n, 0.375, 0.25, power), want, rel_tol=1e-9, abs_tol=1e-6)


def test_shapiro_published_example(spark):
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("w", float(v)) for v in weights], "column string, value double")
    row = stats.shapiro_wilk(df).first()
    assert math.isclose(row["shapiro_w"], 0.78881, abs_tol=2e-5) and math.isclose(row["shapiro_p"], 0.006704, abs_tol=2e-5)
    assert row["normality_decision_shapiro"] == "Non-normal"


def test_shapiro_of_constant_and_tiny_groups(spark):
    df = spark.createDataFrame([("c", 1.0)] * 5 + [("t", 1.0), ("t", 2.0)], "column string, value double")
    rows = {r["column"]: r for r in stats.shapiro_wilk(df).collect()}
    assert rows["c"]["shapiro_w"] is None and rows["t"]["normality_decision_shapiro"] == "Not assessed"


def test_anderson_darling_with_ties(table):
    pdf, df = table
    rows = {r["column"]: r for r in stats.anderson_darling_normal(_long(df, ["a", "b"])).collect()}
    for c in ("a", "b"):
        x = np.sort(pdf[c])
        z = (x - x.mean()) / x.std(ddof=1)
        n, i = len(x), np.arange(1, len(x) + 1)
        f = np.array([phi(v) for v in z])
        s = np.array([phi(-v) for v in z])
        want = -n - np.sum((2 * i - 1) * (np.log(f) + np.log(s[::-1]))) / n
        assert math.isclose(rows[c]["anderson_statistic"], want, rel_tol=1e-9)
    assert rows["a"]["anderson_critical_5pct"] == round(0.787 / (1 + 4 / 400 - 25 / 160000), 3)


def test_normality_table_agrees_with_parts(table):
    _, df = table
    full = {r["column"]: r for r in stats.normality_table(df, ["a", "b"]).collect()}
    shapiro = {r["column"]: r for r in stats.shapiro_wilk(_long(df, ["a", "b"])).collect()}
    k2 = {r["column"]: r for r in stats.dagostino_k2(stats.moments(df, ["a", "b"])).collect()}
    for c in ("a", "b"):
        assert math.isclose(full[c]["shapiro_w"], shapiro[c]["shapiro_w"], rel_tol=1e-12)
        assert math.isclose(full[c]["dagostino_k2"], k2[c]["dagostino_k2"], rel_tol=1e-9)


def test_qq_line_matches_least_squares(table):
    pdf, df = table
    points = stats.qq_points(df, "b", k=10_000).toPandas().sort_values("rank")
    assert len(points) == len(pdf)
    slope, intercept = np.polyfit(points["theoretical"], points["ordered"], 1)
    assert math.isclose(points["slope"].iloc[0], slope, rel_tol=1e-9) and math.isclose(points["intercept"].iloc[0], intercept, rel_tol=1e-9)
    assert math.isclose(points["r"].iloc[0], np.corrcoef(points["theoretical"], points["ordered"])[0, 1], rel_tol=1e-9)


def test_spearman_ranks_pairs_with_gaps_on_common_rows(table):
    pdf, df = table
    got = {(r["a"], r["b"]): r["r"] for r in stats.corr_spearman(df, ["a", "b", "c"]).collect()}
    for x, y in (("a", "b"), ("a", "c"), ("c", "b")):
        both = pdf[[x, y]].dropna().rank()
        assert math.isclose(got[x, y], both[x].corr(both[y]), rel_tol=1e-9)


def brute_u(x, y):
    return sum((a > b) + 0.5 * (a == b) for a in x for b in y)


def test_mann_whitney_against_pairs(table):
    pdf, df = table
    got = {r["feature"]: r for r in htests.mann_whitney_median(df, "y", ["a", "b"]).collect()}
    low = pdf["y"] <= pdf["y"].median()
    for c in ("a", "b"):
        x, z = pdf.loc[low, c].to_numpy(), pdf.loc[~low, c].to_numpy()
        u, n1, n2 = brute_u(x, z), len(x), len(z)
        assert math.isclose(got[c]["U"], u)
        assert math.isclose(got[c]["Z"], (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), rel_tol=1e-9)
        t = np.unique(pdf[c], return_counts=True)[1].astype(float)
        n = n1 + n2
        sd = math.sqrt(n1 * n2 / 12 * ((n + 1) - np.sum(t**3 - t) / (n * (n - 1))))
        z_cc = (max(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sd
        assert math.isclose(got[c]["p"], math.erfc(z_cc / math.sqrt(2)), rel_tol=1e-9)


def test_published_mann_whitney_z():
    u, n1, n2 = 20571, 166, 166
    assert math.isclose((u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12), 7.768229235116537, rel_tol=1e-12)


def test_exact_u_distribution():
    # All 20 splits of 6 ranks into 3 and 3: U = 0 and U = 9 once each.
    assert math.isclose(special.mwu_exact_p(0, 3, 3), 0.1) and math.isclose(special.mwu_exact_p(4.5, 3, 3), 1.0)


def test_kruskal_and_pairs(table):
    pdf, df = table
    kw = htests.kruskal_wallis(df, "cls", ["a", "b"])
    got = {r["feature"]: r for r in kw.collect()}
    for c in ("a", "b"):
        ranks = pdf[c].rank()
        n = len(pdf)
        t = np.unique(pdf[c], return_counts=True)[1].astype(float)
        h = 12 / (n * (n + 1)) * sum(ranks[pdf["cls"] == k].sum() ** 2 / (pdf["cls"] == k).sum() for k in range(3)) - 3 * (n + 1)
        h /= 1 - np.sum(t**3 - t) / (n**3 - n)
        assert math.isclose(got[c]["kruskal_h"], h, rel_tol=1e-9)
    pairs = htests.pairwise_mwu(df, "cls", ["a", "b"], kw).collect()
    for r in pairs:
        want = brute_u(pdf.loc[pdf["cls"] == r["group_1"], r["feature"]], pdf.loc[pdf["cls"] == r["group_2"], r["feature"]])
        assert math.isclose(r["U"], want) and r["p_holm"] >= r["p_raw"]


def test_kruskal_with_an_empty_class(table):
    _, df = table
    row = htests.kruskal_wallis(df.where("cls <> 1"), "cls", ["a"]).first()
    assert row["kruskal_h"] is None and row["note"].startswith("not run") and not row["significant_0_05"]


def test_holm(spark):
    df = spark.createDataFrame([("x", 0.01), ("x", 0.04), ("x", 0.03)], "f string, p double")
    got = {r["p"]: r["p_holm"] for r in htests.holm_adjust(df, "p", ["f"]).collect()}
    assert got == pytest.approx({0.01: 0.03, 0.03: 0.06, 0.04: 0.06})


def test_linear_models(table):
    pdf, df = table
    x = np.column_stack([np.ones(len(pdf)), pdf["a"], pdf["b"]])
    beta, *_ = np.linalg.lstsq(x, pdf["y"], rcond=None)
    sse = float(((pdf["y"] - x @ beta) ** 2).sum())
    sst = float(((pdf["y"] - pdf["y"].mean()) ** 2).sum())
    assert math.isclose(stats.ols_fit(df, "y", ["a", "b"]).first()["r2"], 1 - sse / sst, rel_tol=1e-9)
    rows = {r["feature"]: r for r in stats.anova_type2(df, "y", ["a", "b"]).collect()}
    for drop, name in ((1, "a"), (2, "b")):
        rest = np.delete(x, drop, axis=1)
        other, *_ = np.linalg.lstsq(rest, pdf["y"], rcond=None)
        ss = float(((pdf["y"] - rest @ other) ** 2).sum()) - sse
        assert math.isclose(rows[name]["sum_sq"], ss, rel_tol=1e-8)
    assert rows["Residual"]["df"] == len(pdf) - 3
    r = np.corrcoef(pdf["a"], pdf["b"])[0, 1]
    assert math.isclose(stats.vif(df, ["a", "b"]).first()["vif"], 1 / (1 - r * r), rel_tol=1e-9)
    assert stats.vif(df, ["a"]).count() == 0


def test_describe_large_path_equals_small_path(table):
    _, df = table
    small = sorted(map(tuple, quality.describe_table(df, ["a", "b", "c"]).collect()))
    large = sorted(map(tuple, quality.describe_table(df, ["a", "b", "c"], limit=50).collect()))
    for x, y in zip(small, large):
        assert x[0] == y[0] and np.allclose(x[1:], y[1:], rtol=1e-12)


def test_histogram_counts_every_row(table):
    pdf, df = table
    rows = quality.histogram(df, "c", 4).collect()
    assert sum(r["n"] for r in rows) == pdf["c"].count()
    one = quality.histogram(df.withColumn("k", F.lit(5.0)), "k").collect()
    assert len(one) == 1 and one[0]["n"] == len(pdf)


def test_normal_expressions(spark):
    from statistics import NormalDist

    from studyframe.functions import normal

    zs = [0.0, -0.0, 0.3, -0.3, 0.66, 2.0, -2.0, 5.7, -5.7, 12.0, 37.0, 60.0, -60.0, None]
    rows = spark.createDataFrame([(z,) for z in zs], "z double")
    for r in rows.select("z", normal.norm_sf(F.col("z")).alias("s"), normal.norm_cdf(F.col("z")).alias("c")).collect():
        if r["z"] is None:
            assert r["s"] is None and r["c"] is None
        elif abs(r["z"]) < 38:
            assert math.isclose(r["s"], 0.5 * math.erfc(r["z"] / math.sqrt(2)), rel_tol=1e-12)
            assert math.isclose(r["c"], 0.5 * math.erfc(-r["z"] / math.sqrt(2)), rel_tol=1e-12)
        else:
            assert {r["s"], r["c"]} == {0.0, 1.0}
    ps = [0.0, 1.0, 0.5, 1e-12, 0.02, 0.08, 0.6, 0.99, None, -1.0, 2.0]
    for r in spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal.norm_ppf("p").alias("z")).collect():
        if r["p"] is None or not 0 < r["p"] < 1:
            assert r["z"] is None
        else:
            assert math.isclose(r["z"], NormalDist().inv_cdf(r["p"]), rel_tol=1e-12, abs_tol=1e-15)


def test_run_score_sums_of_many_runs(monkeypatch):
    rng = np.random.default_rng(4)
    cnt = rng.integers(1, 60, 500)
    cnt[7] = 9_000
    before = np.cumsum(cnt) - cnt
    n = np.full(500, int(cnt.sum()))
    want = [special.normal_score_sum(int(b) + 1, int(b + c), int(n[0]), 0.375, 0.25) for b, c in zip(before, cnt)]
    for step in (1 << 20, 100):
        monkeypatch.setattr(special, "STEP_RANKS", step)
        assert np.allclose(special.run_score_sums(before, cnt, n, 0.375, 0.25), want, rtol=1e-9, atol=1e-9)
    empty = np.array([], dtype=np.int64)
    assert len(special.run_score_sums(empty, empty, empty, 0.375, 0.25)) == 0


def test_spearman_regroups_the_rows_once(spark):
    """Gaps, ties, a hot value, doubled rows, a constant and an empty column; both ways to look ranks up agree with pandas."""
    rng = np.random.default_rng(6)
    n = 3000
    pdf = pd.DataFrame({"a": rng.normal(size=n), "b": rng.normal(size=n).round(1), "c": np.where(rng.random(n) < 0.4, 0.0, rng.normal(size=n))})
    pdf["d"] = np.where(rng.random(n) < 0.1, np.nan, pdf["a"] + rng.normal(size=n))
    pdf["k"], pdf["e"] = 1.0, np.nan
    pdf = pd.concat([pdf, pdf.iloc[:500]], ignore_index=True)
    df = spark.createDataFrame(pdf).repartition(7)
    cols = list(pdf.columns)
    want = pdf.corr(method="spearman")
    for small_rows in (200_000, 200, 0):
        out = stats.corr_spearman(df, cols, small_rows=small_rows)
        for r in out.collect():
            expected = want.loc[r["a"], r["b"]]
            if r["r"] is None or math.isnan(expected):
                assert r["r"] is None and math.isnan(expected), (small_rows, r, expected)
            else:
                assert math.isclose(r["r"], expected, abs_tol=1e-9), (small_rows, r)


def test_a_constant_in_many_parts_has_no_spread(spark):
    df = spark.range(3500).select(F.lit(1.0).alias("k"), F.col("id").cast("double").alias("v")).repartition(7)
    assert {(r["a"], r["b"]): r["r"] for r in stats.corr_pearson(df, ["k", "v"]).collect()} == {("k", "k"): None, ("k", "v"): None, ("v", "k"): None, ("v", "v"): 1.0}
    row = {r["column"]: r for r in stats.normality_table(df, ["k", "v"]).collect()}["k"]
    assert row["std"] == 0.0 and row["shapiro_w"] is None and row["anderson_statistic"] is None and row["skewness"] is None


@pytest.fixture
def counted(spark):
    """3,000 rows with three classes, and how many of them were read so far."""
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return (i % 3, float(i * 7919 % 3001) + i % 3 * 400, float(i % 40), None if i % 11 == 0 else float(i % 17))

    return read, spark.createDataFrame(spark.sparkContext.parallelize(range(3000), 4).map(seen), "cls int, a double, b double, c double")


def test_omnibus_and_pairwise_tests_share_one_reading(counted):
    read, df = counted
    pairs = htests.pairwise_mwu(df, "cls", ["a", "b", "c"], htests.kruskal_wallis(df, "cls", ["a", "b", "c"])).collect()
    assert read.value == 3000 and [r["feature"] for r in pairs] == ["a"] * 3
    x = df.toPandas()
    for r in pairs:
        assert r["U"] == brute_u(x.a[x.cls == r["group_1"]], x.a[x.cls == r["group_2"]]) and r["n_group_1"] == r["n_group_2"] == 1000


def test_spearman_reads_the_rows_once(counted):
    read, df = counted
    got = {(r["a"], r["b"]): r["r"] for r in stats.corr_spearman(df, ["a", "b", "c"], small_rows=50).collect()}
    assert read.value == 3000
    want = df.select("a", "b", "c").toPandas().corr(method="spearman")
    assert all(math.isclose(r, want.loc[k], abs_tol=1e-9) for k, r in got.items())


def test_ordered_statistics_read_the_rows_once(counted):
    read, df = counted
    rows = {r["column"]: r for r in stats.normality_table(df, ["a", "c"]).collect()}
    assert read.value == 3000
    x = df.toPandas()
    for c in ("a", "c"):
        assert rows[c]["n"] == x[c].count() and math.isclose(rows[c]["std"], x[c].std(), rel_tol=1e-12)
        assert math.isclose(rows[c]["skewness"], x[c].skew(), rel_tol=1e-9, abs_tol=1e-12) and math.isclose(rows[c]["excess_kurtosis"], x[c].kurt(), rel_tol=1e-9)


def test_array_tails_are_the_column_tails(spark):
    z = [0.0, 0.3, -0.3, 0.6628, 2.0, -2.0, 5.656, 5.7, -9.0, 37.0, 39.0, -39.0, float("inf"), float("nan")]
    rows = spark.createDataFrame([(x,) for x in z], "z double").select(normal.norm_cdf(F.col("z")).alias("c"), normal.norm_sf(F.col("z")).alias("s")).collect()
    lower, upper = normal.tails(np.array(z))
    assert np.allclose(lower, [r["c"] for r in rows], rtol=1e-13, atol=0) and np.allclose(upper, [r["s"] for r in rows], rtol=1e-13, atol=0)
