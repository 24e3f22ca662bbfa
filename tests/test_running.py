import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from studyframe.functions import running
from studyframe.functions.columns import with_row_id
from studyframe.functions.hashing import hash_cuts, pieces_by_hash
from studyframe.functions.running import average_ranks, exact_quantiles, running_totals


@pytest.fixture(scope="module")
def skewed(spark):
    """Two keys; a third of all rows share one value, the rest is spread out."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": np.where(rng.random(6000) < 0.8, "a", "b"), "v": np.round(rng.lognormal(size=6000), 3)})
    pdf.loc[rng.random(6000) < 0.33, "v"] = 1.0
    pdf.loc[:20, "v"] = np.nan
    return pdf, spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))


def as_dict(df, keys, value):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


@pytest.mark.parametrize("ascending", [True, False])
def test_buckets_do_not_change_totals(skewed, ascending):
    _, df = skewed
    plain = as_dict(running_totals(df, ["k"], "v", ascending=ascending), ["k", "v"], "before_cnt")
    cut = as_dict(running_totals(df, ["k"], "v", ascending=ascending, rows_per_bucket=50), ["k", "v"], "before_cnt")
    assert plain == cut and len(plain) > 100


def test_average_ranks_match_pandas(skewed):
    pdf, df = skewed
    got = as_dict(average_ranks(df, ["k"], "v", rows_per_bucket=100), ["k", "v"], "avg_rank")
    known = pdf.dropna()
    want = known.assign(r=known.groupby("k")["v"].rank()).drop_duplicates(["k", "v"])
    assert got == {(a, b): r for a, b, r in zip(want["k"], want["v"], want["r"])}


@pytest.mark.parametrize("parts", [1, 4, 37])
def test_totals_do_not_depend_on_partitions(skewed, parts):
    _, df = skewed
    want = as_dict(running_totals(df, [], "v", rows_per_bucket=200), ["v"], "before_cnt")
    assert as_dict(running_totals(df.repartition(parts), [], "v", rows_per_bucket=200), ["v"], "before_cnt") == want


def test_rows_are_read_once_however_many_buckets(spark):
    """Counting, cutting and ordering work on the kept distinct values."""
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return (i % 7, float(i % 900))

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(3000), 4).map(seen), "k int, v double")
    lines = running_totals(df, ["k"], "v", rows_per_bucket=20).collect()
    assert read.value == 3000 and sum(r["cnt"] for r in lines) == 3000
    assert all(r["before_cnt"] == sum(o["cnt"] for o in lines if o["k"] == r["k"] and o["v"] < r["v"]) for r in lines if r["k"] == 3)


def test_keys_without_a_drawn_line_are_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(running, "DRAWN_PER_BUCKET", 1)
    df = spark.range(4000).select(F.when(F.col("id") < 3900, "large").when(F.col("id") < 3990, "small").alias("k"), (F.col("id") * 7919 % 4001).cast("double").alias("v"))
    plain = as_dict(running_totals(df, ["k"], "v"), ["k", "v"], "before_cnt")
    assert as_dict(running_totals(df, ["k"], "v", rows_per_bucket=500), ["k", "v"], "before_cnt") == plain and len(plain) == 4000


@pytest.mark.parametrize("limit", [1, 10, 300, None])
def test_narrowed_quantiles_are_exact(skewed, limit):
    pdf, df = skewed
    probs = [0.0, 0.1, 1 / 3, 0.5, 0.75, 1.0]
    rows = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, limit=limit).collect()}
    for key, group in pdf.dropna().groupby("k"):
        assert rows[key]["n"] == len(group)
        assert np.allclose(rows[key]["quantiles"], np.quantile(group["v"], probs), rtol=0, atol=1e-12)


@pytest.mark.parametrize("limit", [1, 7, None])
def test_quantiles_of_odd_values(spark, limit):
    """Zeros, infinities, the smallest and largest numbers, near neighbours, NaN, hot ties, null keys and empty keys."""
    tiny, huge, one = 5e-324, 1.7e308, np.nextafter(1.0, 2.0)
    groups = {
        None: [0.0, -0.0, tiny, -tiny, 2 * tiny, huge, -huge, 1.0, one, -1.0], "hot": [3.5] * 900 + [one, 1.0, 4.0, -2.0], "one": [2.0], "same": [7.25] * 50,
        "near": np.cumsum(np.full(200, np.spacing(1.0))) + 1.0, "ends": [float("-inf"), 1.0, 2.0, float("inf"), float("inf")], "none": [None, None],
    }
    df = spark.createDataFrame([(k, None if x is None else float(x)) for k, v in groups.items() for x in v], "k string, v double")
    probs = [0.0, 0.25, 0.4, 0.5, 1.0]
    rows = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, limit=limit).collect()}
    assert set(rows) == set(groups) - {"none"}
    for k in rows:
        x = np.sort(np.array(groups[k], dtype=float))
        at = np.array(probs) * (len(x) - 1)
        low, high = x[np.floor(at).astype(int)], x[np.ceil(at).astype(int)]
        with np.errstate(invalid="ignore"):
            want = np.where(low == high, low, low + (high - low) * (at - np.floor(at)))
        assert rows[k]["n"] == len(x) and np.array_equal(np.array(rows[k]["quantiles"]), want, equal_nan=True)
    empty = exact_quantiles(df.where("k = 'none'"), [], "v", probs, limit=limit).collect()
    assert [tuple(r) for r in empty] == [(None, 0)]
    nan = spark.createDataFrame([(x,) for x in (1.0, float("nan"), 2.0)], "v double")
    assert np.array_equal(exact_quantiles(nan, [], "v", [0.0, 0.5, 1.0], limit=limit).first()["quantiles"], [1.0, 2.0, np.nan], equal_nan=True)


def test_no_task_orders_more_than_the_limit(spark, monkeypatch):
    """The rows that reach the last window, of ten million numbers, half of them one value."""
    seen, real = [], running._picked

    def watched(lines, counted, keys, order):
        if order == "_v":
            seen.append(counted.groupBy("_start").count().agg(F.max("count")).first()[0])
        return real(lines, counted, keys, order)

    monkeypatch.setattr(running, "_picked", watched)
    df = spark.range(10_000_000).select(F.when(F.col("id") % 2 == 0, 0.25).otherwise((F.col("id") * 7919 % 10_000_019) / 10_000_019).alias("v"))
    got = exact_quantiles(df, [], "v", [0.1, 0.25, 0.5, 0.9], limit=5000).first()
    x = np.sort(np.where(np.arange(10_000_000) % 2 == 0, 0.25, (np.arange(10_000_000) * 7919 % 10_000_019) / 10_000_019))
    assert np.allclose(got["quantiles"], np.quantile(x, [0.1, 0.25, 0.5, 0.9]), rtol=0, atol=1e-15) and seen and seen[0] <= 5000


def test_row_ids_are_unique_with_many_copies(spark, monkeypatch):
    from studyframe.functions import columns

    monkeypatch.setattr(columns, "COPIES_PER_TASK", 7)
    df = spark.range(300).select((F.col("id") % 4).alias("a"), F.when(F.col("id") < 100, 1).otherwise(F.col("id")).alias("b"))
    out = with_row_id(df)
    assert out.count() == 300 and out.select("row_id").distinct().count() == 300
    assert sorted(map(tuple, out.drop("row_id").collect())) == sorted(map(tuple, df.collect()))


def test_only_rows_with_many_copies_move_again(spark, monkeypatch):
    from studyframe.functions import columns

    plan = with_row_id(spark.range(300).select((F.col("id") % 4).alias("a")))._jdf.queryExecution().optimizedPlan().toString()
    moved = re.split(r"RepartitionByExpression", plan)
    assert len(moved) == 2 and re.search(r"Filter .*_copies#\d+L? > 100000", moved[1])
    monkeypatch.setattr(columns, "COPIES_PER_TASK", 7)
    df = spark.range(40).select(F.when(F.col("id") < 20, 0).when(F.col("id") < 27, 1).otherwise(F.when(F.col("id") < 35, 2)).alias("a"))
    ids = [(r["a"], int(r["row_id"].split("#")[1])) for r in with_row_id(df).collect()]
    assert sorted(ids, key=str) == sorted([(a, i + 1) for a, n in ((0, 20), (1, 7), (2, 8), (None, 5)) for i in range(n)], key=str)


def test_hash_cuts_find_the_wanted_ranks(spark):
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    found = {r["g"]: r["cuts"] for r in hash_cuts(df, ["g"], "h", F.array(F.lit(1), F.lit(777), F.col("n"))).collect()}
    for g, group in df.toPandas().groupby("g"):
        ordered = sorted(group["h"])
        assert found[g] == [ordered[0], ordered[776], ordered[-1]]


def test_hash_cuts_descend_into_large_buckets(spark):
    """With 4 rows a task, the third to fifth digits are needed; ranks below 1 and null parts as before."""
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.md5(F.col("id").cast("string")).alias("h"))
    ranks = F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(500), F.col("n"))
    found = {r["g"]: (r["n"], r["cuts"]) for r in hash_cuts(df, ["g"], "h", ranks, digits=1, bound=4).collect()}
    for g in (None, 1, 2):
        ordered = sorted(r["h"] for r in df.where(F.col("g").eqNullSafe(F.lit(g))).collect())
        assert found[g] == (1000, [ordered[0], ordered[1], ordered[499], ordered[-1]])
    plan = hash_cuts(df, ["g"], "h", ranks, digits=1, bound=4)._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"substring\(.*, 1, [3-9]\)", plan)
    assert hash_cuts(df.where("false"), ["g"], "h", ranks).collect() == []


def test_pieces_are_equal_in_size(spark):
    df = spark.range(1001).select(F.md5(F.col("id").cast("string")).alias("h"))
    ranks = F.array(*[F.ceil(F.col("n") * F.lit(i) / F.lit(4)) for i in (1, 2, 3)])
    sizes = [r["count"] for r in pieces_by_hash(df, [], "h", ranks, "p").groupBy("p").count().collect()]
    assert len(sizes) == 4 and max(sizes) - min(sizes) <= 1


def test_many_rows_of_few_values_are_not_narrowed(spark):
    """The sizes and the distinct values: two readings, however many rows a value has."""
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return (i % 2, float(i * i % 97) if i % 2 else float(i % 50))

    df = spark.createDataFrame(spark.sparkContext.parallelize(range(4000), 4).map(seen), "k int, v double")
    found = {r["k"]: r["quantiles"] for r in exact_quantiles(df, ["k"], "v", [0.1, 0.5, 0.77], limit=500).collect()}
    assert read.value == 8000
    for k, group in df.toPandas().groupby("k"):
        assert np.allclose(found[k], np.quantile(group["v"], [0.1, 0.5, 0.77]), rtol=0, atol=1e-12)
