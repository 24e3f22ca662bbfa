"""Nearest neighbours against all distances, recall of the approximate form, pruning."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from studyframe.operators import neighbors as nb


def frame(spark, x, first=0):
    rows = [(first + i, v.tolist() if v is not None else None, i % 3) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, v array<double>, label int")


def brute(x, y, k, p=2, own=False):
    gap = y[:, None] - x[None]
    dist = np.sqrt((gap * gap).sum(2)) if p == 2 else np.abs(gap).sum(2)
    if own:
        np.fill_diagonal(dist, np.inf)
    first = np.argsort(dist, axis=1, kind="stable")[:, :k]
    return {(i, int(j)): dist[i, j] for i in range(len(y)) for j in first[i] if np.isfinite(dist[i, j])}


def pairs(found):
    return {(r["qkey"], r["tkey"]): r["dist"] for r in found.collect()}


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    middles = rng.normal(size=(12, 8)) * 20
    x = np.concatenate([m + rng.normal(size=(25, 8)) for m in middles])
    x[200:240] = x[3]  # a hot vector
    x[5] = np.round(x[5])
    return x[rng.permutation(len(x))]


@pytest.mark.parametrize("p,cells,tile,own", [(2, None, 4000, True), (1, 9, 13, True), (2, 40, 7, False), (2, 1, 50, False)])
def test_pivots_give_the_exact_neighbours(spark, clustered, p, cells, tile, own):
    df = frame(spark, clustered)
    got = pairs(nb.PivotSearch(df, "v", "id", "label", 4, p, own, cells, tile).neighbors(df))
    want = brute(clustered, clustered, 4, p, own)
    assert got.keys() == want.keys() and got == pytest.approx(want)


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("k", [1, 4, 40])
@pytest.mark.parametrize("kind", ["plain", "far off", "wide", "huge", "ties"])
def test_fast_formulas_give_the_nearest_of_a_block(p, k, kind):
    rng = np.random.default_rng(11)
    x, z = rng.normal(size=(30, 6)), rng.normal(size=(37, 6))
    x, z = {"plain": (x, z), "far off": (x + 1e6, z + 1e6), "wide": (np.concatenate([x * 1e-6, x + 1e5])[::2], np.concatenate([z * 1e-6, z + 1e5])), "huge": (x * 1e200, z * 1e200), "ties": (np.round(x), np.round(z))}[kind]
    with np.errstate(over="ignore", invalid="ignore"):
        dist = nb._distances(x, z, p)
        same = rng.random(dist.shape) < 0.1
        want, bound = np.where(same, np.inf, dist), np.where(rng.random(len(x)) < 0.5, np.inf, np.sort(dist, axis=1)[:, 3])
        i, j, found = nb._k_nearest(x, z, k, p, bound, same)
    rows = [(a, b, want[a, b]) for a in range(len(x)) for b in np.argsort(want[a], kind="stable")[:k] if np.isfinite(want[a, b]) and want[a, b] <= bound[a]]
    assert list(zip(i, j, found)) == rows


def test_a_query_travels_once_per_pack(spark, clustered):
    """Small cells are met together, and copies of a key stay rows of their own."""
    assert nb._packs({0: 3, 1: 4, 2: 9, 5: 1, 6: 2}, 7) == {0: 0, 1: 0, 2: 2, 5: 5, 6: 5}
    df = frame(spark, clustered).unionByName(frame(spark, clustered[:9]))
    once = {(r["qkey"], r["tkey"], round(r["dist"], 9)): r["count"] for r in nb.PivotSearch(df, "v", "id", "label", 4, cells=30).neighbors(df).groupBy("qkey", "tkey", "dist").count().collect()}
    alone = {(r["qkey"], r["tkey"], round(r["dist"], 9)): r["count"] for r in nb.PivotSearch(df, "v", "id", "label", 4, cells=30, tile_rows=1).neighbors(df).groupBy("qkey", "tkey", "dist").count().collect()}
    assert once == alone and sum(once.values()) == 4 * len(clustered)


def test_more_neighbours_than_rows(spark):
    x = np.arange(6.0).reshape(3, 2)
    df = frame(spark, x)
    assert pairs(nb.PivotSearch(df, "v", "id", "label", 9, exclude_self=True).neighbors(df)).keys() == {(i, j) for i in range(3) for j in range(3) if i != j}


def test_rows_without_a_vector_and_empty_tables(spark):
    x = [np.array([0.0, 1.0]), None, np.array([np.nan, 1.0]), np.array([0.0, 2.0])]
    df = frame(spark, x)
    assert pairs(nb.PivotSearch(df, "v", "id", "label", 1, exclude_self=True).neighbors(df)).keys() == {(0, 3), (3, 0)}
    none = df.where("id < 0")
    assert nb.knn_predict(none, df, "v", "id", "label").count() == 0 == nb.knn_predict(df, none, "v", "id", "label").count()
    assert nb.knn_predict(none, df, "v", "id", "label", approximate=True).count() == 0


def test_far_cells_are_not_visited(spark, clustered):
    df = frame(spark, clustered)
    cells = nb.PivotSearch(df, "v", "id", "label", 3, exclude_self=True, cells=60).visits(df).toPandas()
    assert cells.n_home.sum() >= len(clustered)
    assert (cells.n_train * (cells.n_home + cells.n_far)).sum() < 0.4 * cells.n_train.sum() * len(clustered)


def test_random_projections_find_most(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([m + rng.normal(size=(60, 16)) * 0.3 for m in rng.normal(size=(40, 16))])
    df = frame(spark, x)
    exact = nb.PivotSearch(df, "v", "id", "label", 5, exclude_self=True).neighbors(df)
    found = nb.nearest_approximate(df, df, "v", "id", "label", 5, exclude_self=True, bucket_rows=100)
    row = nb.recall_of(found, exact).first()
    assert row["n_exact"] == 5 * len(x) and row["recall"] >= 0.9
    assert found.groupBy("qkey").count().where(F.col("count") > 5).count() == 0


def test_l1_in_steps_finds_the_nearest(monkeypatch):
    """Short whole numbers tell which pairs may be nearest; larger ones are not needed on plain vectors."""
    rng = np.random.default_rng(4)
    x, z = rng.normal(size=(60, 64)), rng.normal(size=(4000, 64))
    near, step = nb._in_steps(x, z)
    exact = nb._distances(x, z, 1)
    assert near.dtype == np.int16 and (np.abs(near * step - exact) <= 65 * step).all()
    assert nb._in_steps(np.ones((2, 3)), np.ones((4, 3))) is None and nb._in_steps(x, np.full((1, 64), 1e308) * [[1]]) is not None
    same = np.zeros(exact.shape, bool)
    same[:, :7] = True
    wanted = np.argsort(np.where(same, np.inf, exact), axis=1, kind="stable")[:, :5]
    with monkeypatch.context() as m:
        m.setattr(nb, "_nearly", None)
        for bound in (np.full(60, np.inf), np.sort(np.where(same, np.inf, exact), axis=1)[:, 4]):
            i, j, dist = nb._k_nearest(x, z, 5, 1, bound, same)
            assert (j.reshape(60, 5) == wanted).all() and (dist == exact[i, j]).all()
    z[0] = 1e9  # one outlier makes the steps long
    i, j, _ = nb._k_nearest(x, z, 5, 1, np.full(60, np.inf), same)
    assert (j.reshape(60, 5) == wanted).all()
