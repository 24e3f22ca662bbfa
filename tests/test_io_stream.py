import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from studyframe.session import scratch_path
from studyframe.sources import delimited, reports, stores
from studyframe.streaming.quality import stream_quality
from studyframe.streaming.runner import run_available


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as handle:
        handle.write(text)


@pytest.mark.parametrize("name,text", [("a.csv", "﻿ ID , PI/FF\n1,2\n"), ("b.tsv", "ID\tPI/FF\n1\t2\n"), ("c.txt", "ID;PI/FF\n1;2\n")])
def test_delimited_headers(spark, tmp_path, name, text):
    path = str(tmp_path / name)
    write(path, text)
    df = delimited.read_delimited(spark, path)
    assert df.columns == ["ID", "PI/FF"] and tuple(df.first()) == ("1", "2")


def test_reports_with_different_columns(spark, tmp_path):
    root = str(tmp_path)
    write(f"{root}/nested_cv/AC/fs1/RF_nested_cv_folds.csv", "outer_fold,outer_r2\n0,0.5\n1,0.6\n")
    write(f"{root}/nested_cv/AC/fs2/DT_nested_cv_folds.csv", "outer_r2,extra\n0.1,x\n")
    rows = {(r["Model"], r["Feature_Set"], r["outer_r2"], r["extra"]) for r in reports.collect_reports(spark, f"{root}/nested_cv").collect()}
    assert rows == {("RF", "fs1", "0.5", None), ("RF", "fs1", "0.6", None), ("DT", "fs2", "0.1", "x")}
    have = {r["analysis"]: r["files_found"] for r in reports.analysis_inventory(spark, root, [("N", "nested_cv", "*_nested_cv_folds.csv"), ("L", "learning_curves", "*.csv")]).collect()}
    assert have == {"N": 2, "L": 0}


def test_importances_take_their_keys_from_the_path(spark, tmp_path):
    write(f"{tmp_path}/x/AC/FS3/rf_permutation_sensitivity.csv", "feature,Mean Importance\nLL,0.2\nPI,-0.1\n")
    write(f"{tmp_path}/x/other/rf_permutation_sensitivity.csv", "feature,Mean Importance\nLL,20\n")
    rows = {(r["model"], r["feature_set"], r["target"], r["feature"], r["importance_pct"]) for r in reports.collect_importances(spark, str(tmp_path), "regression", "GL").collect()}
    assert rows == {("RF", "FS3", "AC", "LL", 20.0), ("RF", "FS3", "AC", "PI", -10.0), ("RF", "UNKNOWN", "UNKNOWN", "LL", 20.0)}


def test_split_store_replaces_only_its_pair(spark):
    root = scratch_path(spark, "store")
    df = spark.range(20).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"), F.when(F.col("id") < 4, "test").otherwise("train").alias("split"))
    stores.write_split(df, root, "y", "fs1", ["x"], "x")
    stores.write_split(df, root, "z", "fs1", ["x"], "x")
    stores.write_split(df.where("row_id < 10"), root, "y", "fs1", ["x"], "x")
    sizes = {(r["target"], r["feature_set"]): (r["n_train"], r["n_test"]) for r in stores.read_manifest(spark, root).collect()}
    assert sizes == {("y", "fs1"): (6, 4), ("z", "fs1"): (16, 4)}
    assert stores.read_split(spark, root, "y", "fs1", "train").count() == 6


def test_fingerprint_ignores_order_but_not_content(spark):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("m"), F.when(F.col("id") > 3, "t").alias("t"))
    one = stores.fingerprint(df).first()
    assert one == stores.fingerprint(df.select("t", "m", "id").repartition(9)).first()
    assert one["xor_hash"] != stores.fingerprint(df.withColumn("m", F.when(F.col("id") == 5, 0).otherwise(F.col("m")))).first()["xor_hash"]


def test_late_rows_are_dropped(spark):
    root = scratch_path(spark, "late")
    base = dt.datetime(2024, 1, 1)
    batches = [[(0, 1.0), (50, -1.0)], [(300, 2.0)], [(10, -5.0), (310, -1.0)], [(900, 1.0)]]
    stream = None
    for i, rows in enumerate(batches):
        part = spark.createDataFrame([(base + dt.timedelta(minutes=m), v) for m, v in rows], "ts timestamp, value double")
        part.coalesce(1).write.mode("append").parquet(f"{root}/in")
        stream = spark.readStream.schema(part.schema).parquet(f"{root}/in")
        out = run_available(stream_quality(stream, {"neg": "value < 0"}, "ts", "1 hour", "10 minutes"), f"{root}/out", f"{root}/state")
    got = sorted((r["window_start"].hour, r["n"], r["neg"]) for r in out.collect())
    # The row at minute 10 came after its window was closed.
    assert got == [(0, 2, 1), (5, 2, 1)]


def test_report_lines_of_many_layouts(spark, tmp_path):
    write(f"{tmp_path}/r/fs1/A_nested_cv_folds.csv", '\n﻿"fold", Outer_R2 \r\n0,"1,5"\r\n1\r\n2,3,surplus\r\n\r\n"fold", Outer_R2 \r\n')
    write(f"{tmp_path}/r/fs1/B_nested_cv_folds.csv", "outer_r2,x,x,\n9,a,b,c\n")
    write(f"{tmp_path}/r/fs2/C_nested_cv_folds.csv", "fold,outer_r2\n")
    write(f"{tmp_path}/r/fs2/D_nested_cv_folds.csv", "")
    write(f"{tmp_path}/r/fs2/other.csv", "fold\n7\n")
    many = "".join(f"{i},{i}.5\n" for i in range(2000))
    write(f"{tmp_path}/r/fs3/E_nested_cv_folds.csv", "outer_r2,fold\n" + many)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        table = reports.collect_reports(spark, str(tmp_path / "r"))
        rows = table.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    small = sorted((r["Model"], r["Feature_Set"], r["fold"], r["Outer_R2"], r["x1"], r["x2"], r["_c3"]) for r in rows if r["Model"] != "E")
    assert [tuple(v or "-" for v in r) for r in sorted(map(lambda r: tuple(v or "" for v in r), small))] == [
        ("A", "fs1", "0", "1,5", "-", "-", "-"), ("A", "fs1", "1", "-", "-", "-", "-"), ("A", "fs1", "2", "3", "-", "-", "-"), ("B", "fs1", "-", "9", "a", "b", "c"),
    ]
    assert {(r["Outer_R2"], r["fold"]) for r in rows if r["Model"] == "E"} == {(str(i), f"{i}.5") for i in range(2000)}
    with pytest.raises(FileNotFoundError):
        reports.collect_reports(spark, str(tmp_path / "r"), "*.none")
