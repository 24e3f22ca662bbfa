import pytest
from pyspark.sql import functions as F

from studyframe.operators import joins, labels, split as sp


@pytest.fixture(scope="module")
def rows(spark):
    """1000 rows; group g0 holds a third, class 2 is small."""
    g = F.when(F.col("id") < 333, "g0").otherwise(F.concat(F.lit("g"), (F.col("id") % 23).cast("string")))
    return spark.range(1000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("row_id"), g.alias("grp"),
        F.when(F.col("id") % 50 == 0, 2).otherwise((F.col("id") % 2)).cast("int").alias("label"), F.col("id").cast("double").alias("y"),
    ).cache()


def sizes(df, col):
    return {r[col]: r["count"] for r in df.groupBy(col).count().collect()}


def test_random_split_is_exact_and_repeatable(rows):
    out = sp.split_random(rows, "row_id", 0.25)
    assert sizes(out, "split") == {"test": 250, "train": 750}
    again = sp.split_random(rows.repartition(37), "row_id", 0.25)
    assert out.select("row_id", "split").exceptAll(again.select("row_id", "split")).count() == 0
    assert joins.split_coverage(rows, out).count() == 0


def test_stratified_split_keeps_shares(rows):
    out = sp.split_stratified(rows, "row_id", "label", 0.2)
    got = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert got[2, "test"] == 4 and sum(v for (c, s), v in got.items() if s == "test") == 200
    assert abs(got[0, "test"] - 0.2 * (got[0, "test"] + got[0, "train"])) <= 1


def test_tiny_stratum_without_test_rows(spark):
    df = spark.range(101).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 0, "rare").otherwise("often").alias("c"))
    out = sp.split_stratified(df, "k", "c", 0.1)
    assert out.where("c = 'rare'").first()["split"] == "train" and sizes(out, "split")["test"] == 11


def test_groups_stay_whole(rows):
    out = sp.split_grouped(rows, "grp", 0.2)
    assert joins.group_overlap(out, "grp").count() == 0
    assert out.where("split = 'test'").select("grp").distinct().count() == 5


def test_validate_split(rows):
    out = sp.split_random(rows, "row_id", 0.2)
    assert sp.validate_split(out, label="label").where("NOT ok").count() == 0
    with pytest.raises(ValueError, match="not usable"):
        sp.validate_split(out.limit(15))
    with pytest.raises(ValueError, match="ratios"):
        sp.validate_split(out, (0.9, 0.2))


@pytest.mark.parametrize("mode", ["greedy", "snake"])
def test_group_folds(rows, mode):
    out = sp.group_kfold(rows, "grp", 4, mode=mode)
    assert out.count() == 1000 and set(sizes(out, "fold")) == {0, 1, 2, 3}
    assert out.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0


def test_greedy_balances_the_hot_group(rows):
    assert max(sizes(sp.group_kfold(rows, "grp", 3), "fold").values()) <= 370


def test_too_few_groups_fall_back_to_rows(rows):
    assert set(sizes(sp.group_kfold(rows, "grp", 50, key="row_id"), "fold")) <= set(range(50))
    with pytest.raises(ValueError, match="fewer groups"):
        sp.group_kfold(rows, "grp", 50)


def test_stratified_folds_lower_k(rows):
    out = sp.stratified_kfold(rows, "row_id", "label", 50)
    assert len(sizes(out, "fold")) == 20
    per = out.groupBy("label", "fold").count().where("label = 2").collect()
    assert len(per) == 20 and all(r["count"] == 1 for r in per)


def test_stratified_group_folds(rows):
    out = sp.stratified_group_kfold(rows, "grp", "label", 3)
    assert out.groupBy("grp").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.groupBy("fold", "label").count().where("label < 2").count() == 6


def test_large_path_of_stratified_groups(rows, monkeypatch):
    monkeypatch.setattr(sp, "GREEDY_GROUPS", 5)
    for out in (sp.stratified_group_kfold(rows, "grp", "label", 3), sp.group_kfold(rows, "grp", 3)):
        assert out.count() == 1000 and len(sizes(out, "fold")) == 3


def test_learning_subsets_are_nested_and_never_from_the_fold(rows):
    folded = sp.group_kfold(rows, "grp", 3)
    sets = sp.learning_subsets(folded, "fold", "grp", [0.1, 0.5, 1.0])
    fold_of = {r["grp"]: r["fold"] for r in folded.select("grp", "fold").distinct().collect()}
    got = {}
    for r in sets.collect():
        assert fold_of[r["group"]] != r["fold"]
        got.setdefault((r["fold"], r["fraction"]), set()).add(r["group"])
    for f in range(3):
        others = {g for g, own in fold_of.items() if own != f}
        assert got[f, 0.1] <= got[f, 0.5] <= got[f, 1.0] == others
        assert len(got[f, 0.5]) == -(-len(others) // 2)


def test_boundaries(spark, rows):
    b = labels.auto_boundaries(rows, "y").first()
    assert (b["lower"], b["upper"]) == pytest.approx((333.0, 666.0))
    tied = spark.createDataFrame([(v,) for v in [1.0] * 50 + [2.0, 2.0, 3.0, 3.0]], "y double")
    assert labels.auto_boundaries(tied, "y").first()["method"] == "distinct_midpoints"
    cv = labels.auto_boundaries_cv(tied, "y").first()
    assert (cv["lower"], cv["upper"]) == (1.5, 2.5)
    with pytest.raises(ValueError):
        labels.auto_boundaries(tied.where("y < 3"), "y")
    with pytest.raises(ValueError, match="not usable"):
        labels.resolve_boundaries(rows, "y", {"lower": 5.0, "upper": 4.0})
    assert labels.resolve_boundaries(rows, "y", {"lower": 5.0, "upper": 4.0}, "auto").first()["source"] == "automatic"


def test_quantile_bins_use_fewer_when_needed(spark, rows):
    assert sizes(labels.quantile_labels(rows, "y"), "bin") == {i: 200 for i in range(5)}
    few = spark.createDataFrame([(float(i),) for i in range(25)], "y double")
    assert len(sizes(labels.quantile_labels(few, "y"), "bin")) == 2
    with pytest.raises(ValueError, match="no quantile bins"):
        labels.quantile_labels(few.limit(8), "y")


def test_labels_and_modes(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("b",)], "c string")
    assert [r["label"] for r in labels.encode_labels(df, "c").collect()] == [1, 0, None, 1]
    with pytest.raises(Exception, match="unseen class label"):
        labels.encode_labels(df, "c", labels=["a", "z"]).collect()
    with pytest.raises(ValueError):
        labels.encode_labels(df.where("c = 'a'"), "c")
    assert labels.target_mode(df, "c") == "categorical"
    assert labels.target_mode(df, "c", "continuous-threshold") == "threshold"
    edges = spark.createDataFrame([(0.75,), (1.25,), (0.7,), (1.3,), (None,)], "y double")
    assert [r["label"] for r in labels.class_from_thresholds(edges, "y", 0.75, 1.25).collect()] == [1, 1, 0, 2, None]


def test_fill_is_the_greedy_step_by_step():
    import random

    draw = random.Random(3)
    for _ in range(200):
        k, size, groups = draw.randint(2, 6), draw.randint(1, 9), draw.randint(1, 40)
        start = [draw.randint(0, 60) for _ in range(k)]
        load, want = list(start), [0] * k
        for _ in range(groups):
            fold = min(range(k), key=lambda f: (load[f], f))
            load[fold], want[fold] = load[fold] + size, want[fold] + 1
        assert sp._fill(start, size, groups) == want
    # A hot group beside a billion small ones takes no more steps.
    assert sum(sp._fill([10**9, 0, 0], 1, 4 * 10**9)) == 4 * 10**9


def test_group_folds_follow_the_sizes(spark):
    """Ties, a hot group, a missing group and texts that look alike; loads are those of the greedy over all groups."""
    names = [None, "", "a", "A", "a "] + [f"g{i}" for i in range(40)]
    counts = [700, 3, 3, 3, 3] + [1 + i % 4 for i in range(40)]
    rows = spark.createDataFrame([(g, j) for g, c in zip(names, counts) for j in range(c)], "grp string, fold_ int")
    got = sp.group_kfold(rows, "grp", 4).groupBy("grp", "fold").count().collect()
    assert len(got) == len(names)
    load = [0] * 4
    for c in sorted(counts, reverse=True):
        load[load.index(min(load))] += c
    assert {f: sum(r["count"] for r in got if r["fold"] == f) for f in range(4)} == dict(enumerate(load))
    again = sp.group_kfold(rows.repartition(5), "grp", 4).groupBy("grp", "fold").count().collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
