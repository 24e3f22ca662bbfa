"""Nearest neighbours: exact with pivots and the triangle inequality, approximate with random projections.

Exact search cuts the train rows into cells around pivots. A query meets its home cells first; the distance of
its k-th neighbour there bounds what other cells could add, and only cells that may hold a nearer row are
visited. Cells and their visitors are compared in blocks of bounded size, so a hot cell is many tasks, and a
task writes at most k candidates per query.

Rows without a whole vector (null, or with a null or NaN component) are neither neighbours nor queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

#: Rows of one side of a block comparison.
TILE_ROWS = 16_000
#: Cells or buckets of one table: the driver holds a pivot and a count for each.
MAX_CELLS = 4_096
#: Relative slack of the bounds, for rounding.
SLACK = 1e-9
#: Numbers of a block of differences, and of one that stays near the processor.
STEP = 4_000_000
CACHED = 32_768
#: Short numbers of a block, of which more stay near; the largest one; levels of a component that are worth a try.
SHORTS, TOP, FEWEST_LEVELS = 262_144, 32_767, 16
#: Of the rows of a block, the part whose k-th distance bounds what is looked at.
PART = 4
#: Pairs per query and neighbour, about, that are worth working out.
FEW = 8


def _distances(x: np.ndarray, z: np.ndarray, p: int) -> np.ndarray:
    out, step = np.empty((len(x), len(z))), max(1, STEP // max(1, z.size))
    for at in range(0, len(x), step):
        gap = x[at : at + step, None, :] - z[None, :, :]
        out[at : at + step] = np.sqrt((gap * gap).sum(axis=2)) if p == 2 else np.abs(gap).sum(axis=2)
    return out


def _nearly(x: np.ndarray, z: np.ndarray, p: int, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all pairs (squared if p = 2) by fast formulas in numbers of a kind, and per row of x how far off they may be."""
    middle = z.mean(axis=0)
    x, z = (x - middle).astype(kind), np.ascontiguousarray((z - middle).astype(kind))
    if p == 2:
        a, b = (x * x).sum(axis=1), (z * z).sum(axis=1)
        out = x @ z.T
        out *= -2
        out += a[:, None]
        out += b
    else:
        a, b = np.abs(x).sum(axis=1), np.abs(z).sum(axis=1)
        out, columns, step = np.zeros((len(x), len(z)), kind), np.ascontiguousarray(z.T), max(1, CACHED // len(z))
        for at in range(0, len(x), step):
            some, part = out[at : at + step], np.empty_like(out[at : at + step])
            for i, column in enumerate(columns):
                np.subtract(x[at : at + step, i, None], column, out=part)
                some += np.abs(part, out=part)
    return out, 2.0 * float(np.finfo(kind).eps) * (x.shape[1] + 10) * (a.astype(float) + float(b.max()))


def _in_steps(x: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, float] | None:
    """L1 distances of all pairs in steps, as short numbers, and the length of a step: each is off by as many steps as there
    are components, at most."""
    d = x.shape[1]
    levels = TOP // max(1, d + 1)
    low, high = min(x.min(), z.min()), max(x.max(), z.max())
    step = (high - low) / levels if levels >= FEWEST_LEVELS else 0.0
    if not (np.isfinite(step) and step > np.finfo(float).tiny * TOP):
        return None
    x, z = (np.minimum(np.rint((v - low) / step), levels).astype(np.int16) for v in (x, z))
    out, columns, rows = np.zeros((len(x), len(z)), np.int16), np.ascontiguousarray(z.T), max(1, SHORTS // len(z))
    for at in range(0, len(x), rows):
        some = out[at : at + rows]
        part = np.empty_like(some)
        for i, column in enumerate(columns):
            np.subtract(x[at : at + rows, i, None], column, out=part)
            some += np.abs(part, out=part)
    return out, float(step)


def _candidates_in_steps(x: np.ndarray, z: np.ndarray, k: int, bound: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray] | None:
    """As `_candidates` for L1, or None if steps do not tell enough pairs apart."""
    found = _in_steps(x, z)
    if found is None:
        return None
    near, step = found
    off = x.shape[1] + 2
    if same is not None:
        near[same] = TOP
    with np.errstate(over="ignore"):
        reach = np.minimum(np.ceil(bound * (1 + SLACK) / step) + off, TOP - 1).astype(np.int16)
    hit = near <= reach[:, None]
    if k < len(z) and np.count_nonzero(hit) > FEW * k * len(x):
        some = max(k, len(z) // PART)
        kth = np.partition(near[:, :some], k - 1, axis=1)[:, k - 1].astype(np.int64)
        hit = near <= np.minimum(reach, np.minimum(kth + 2 * off, TOP - 1)).astype(np.int16)[:, None]
    if np.count_nonzero(hit) <= max(FEW * k * len(x), hit.size // 50):
        return np.nonzero(hit)
    return None


def _candidates(x: np.ndarray, z: np.ndarray, k: int, p: int, bound: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among which are the k nearest of each row of x; numbers of half the size first, if they tell enough pairs apart."""
    if p == 1 and len(x) and len(z) and (found := _candidates_in_steps(x, z, k, bound, same)) is not None:
        return found
    for kind in (np.float32, np.float64):
        with np.errstate(over="ignore", invalid="ignore"):
            near, off = _nearly(x, z, p, kind)
            reach = bound**p * (1 + SLACK) + off
        if not np.isfinite(off).all() or np.isnan(near).any():  # beyond the range of these numbers
            continue
        if same is not None:
            near[same] = np.inf
        up = lambda r: np.nextafter(r.astype(kind), kind(np.inf))[:, None]
        hit = near <= up(reach)
        if k < len(z) and np.count_nonzero(hit) > FEW * k * len(x):
            kth = np.partition(near, k - 1, axis=1)[:, k - 1]
            hit = near <= up(np.minimum(reach, kth + 2 * off))
        hit &= near < np.inf
        if kind is np.float64 or np.count_nonzero(hit) <= max(FEW * k * len(x), hit.size // 50):
            return np.nonzero(hit)
    return np.nonzero(np.ones((len(x), len(z)), bool) if same is None else ~same)


def _k_nearest(x: np.ndarray, z: np.ndarray, k: int, p: int, bound: np.ndarray, same: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x, rows of z and distances of the k nearest within ``bound``; of equal distances the first rows of z; pairs in ``same`` are left out.

    A fast formula with a bound on its error tells which pairs may be among them; only theirs are worked out as in ``_distances``."""
    i, j = _candidates(x, z, k, p, bound, same)
    dist, step = np.empty(len(i)), max(1, STEP // max(1, x.shape[1]))
    for at in range(0, len(i), step):
        gap = x[i[at : at + step]] - z[j[at : at + step]]
        dist[at : at + step] = np.sqrt((gap * gap).sum(axis=1)) if p == 2 else np.abs(gap).sum(axis=1)
    good = np.isfinite(dist) & (dist <= bound[i])
    i, j, dist = i[good], j[good], dist[good]
    order = np.lexsort((j, dist, i))
    i, j, dist = i[order], j[order], dist[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < k], j[place < k], dist[place < k]


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=float) for v in vectors])


def _rows(df: DataFrame, **cols: Column) -> DataFrame:
    vec = next(c for name, c in cols.items() if name.endswith("vec")).cast("array<double>")
    return df.select(*[(vec if name.endswith("vec") else c).alias(name) for name, c in cols.items()]).where(vec.isNotNull() & ~F.exists(vec, lambda v: v.isNull() | F.isnan(v)))


def _with(rows: DataFrame, fields: str, work) -> DataFrame:
    """rows with more columns, which ``work`` makes from the matrix and the frame of a batch."""
    more = T._parse_datatype_string(fields)
    schema = T.StructType([*rows.schema.fields, *more.fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                made = work(_matrix(batch[vec]), batch)
                yield batch.assign(**dict(zip(more.names, made)))

    vec = next(c for c in rows.columns if c.endswith("vec"))
    return rows.mapInPandas(run, schema)


def _train_rows(train: DataFrame, features: str, key: str, label: str, need: int) -> DataFrame:
    """tkey, tvec, tlabel; of equal vectors the ``need`` smallest keys, as no other can be among the nearest."""
    rows = _rows(train, tkey=F.col(key), tvec=F.col(features), tlabel=F.col(label).cast("double"))
    place = F.row_number().over(W.partitionBy("tvec").orderBy("tkey"))
    return rows.withColumn("_place", place).where(F.col("_place") <= need).drop("_place").persist(StorageLevel.MEMORY_AND_DISK)


def _packs(sizes: dict[int, int], tile_rows: int) -> dict[int, int]:
    """Cell -> the first cell of its pack: neighbouring cells that hold at most ``tile_rows`` rows together, or one larger cell."""
    pack, first, held = {}, None, 0
    for cell in sorted(sizes):
        if first is None or held + sizes[cell] > tile_rows:
            first, held = cell, 0
        pack[cell], held = first, held + sizes[cell]
    return pack


def _compare(q: DataFrame, t: DataFrame, k: int, p: int, exclude_self: bool, tile_rows: int, packed: bool = False) -> DataFrame:
    """qkey, tkey, tlabel, dist: at most k candidates per query and block of the ``cells`` that it visits, none beyond its ``bound``.

    With ``packed`` small cells are met together: a query travels once per pack, and is compared with all rows of the
    pack but those of its ``homes``, which it met before."""
    spark = q.sparkSession
    sizes = {r["cell"]: r["count"] for r in t.groupBy("cell").count().collect()}
    pack = _packs(sizes, tile_rows) if packed else {c: c for c in sizes}
    # A line per cell, and the number of cells is bounded.
    into = F.broadcast(spark.createDataFrame(list(pack.items()), "cell int, pack int"))
    lookup = np.full(max(pack, default=0) + 1, -1, dtype=np.int32)
    lookup[list(pack)] = list(pack.values())
    held = spark.sparkContext.broadcast(lookup)

    @F.pandas_udf("array<int>")
    def packs(cells: pd.Series) -> pd.Series:
        table = held.value
        found = ([c for c in np.unique(table[cs[cs < len(table)]]) if c >= 0] for cs in cells)
        return pd.Series([np.array(cs, dtype=np.int32) for cs in found], dtype=object)

    q = q.select("qkey", "qvec", "bound", "homes", F.explode(packs("cells")).alias("pack"))
    t = t.join(into, "cell")
    rows = dict.fromkeys(pack.values(), 0)
    for cell, first in pack.items():
        rows[first] += sizes[cell]
    visits = {r["pack"]: r["count"] for r in q.groupBy("pack").count().collect()}
    blocks = [(c, math.ceil(rows[c] / tile_rows), math.ceil(visits[c] / tile_rows)) for c in rows if c in visits]
    table = F.broadcast(spark.createDataFrame(blocks, "pack int, nt int, nq int"))
    number = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    t = t.join(table, "pack").select("pack", "cell", "tkey", "tvec", "tlabel", number("tkey", "nt").alias("_t"), every("nq").alias("_q"))
    q = q.join(table, "pack").select("pack", "qkey", "qvec", "bound", "homes", number("qkey", "nq").alias("_q"), every("nt").alias("_t"))
    schema = T.StructType([q.schema["qkey"], t.schema["tkey"], T.StructField("tlabel", T.DoubleType()), T.StructField("dist", T.DoubleType())])

    def nearest(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"qkey": [], "tkey": [], "tlabel": [], "dist": []})
        b = b.sort_values("tkey", kind="stable")
        x, z, bound, homes = _matrix(a["qvec"]), _matrix(b["tvec"]), a["bound"].to_numpy(), a["homes"].to_numpy()
        tkeys, tlabels, qkeys, cells = b["tkey"].to_numpy(), b["tlabel"].to_numpy(), a["qkey"].to_numpy(), b["cell"].to_numpy()
        here = set(cells.tolist())
        found, step = [], max(1, STEP // max(1, len(z)))
        for at in range(0, len(x), step):
            own = qkeys[at : at + step]
            same = own[:, None] == tkeys[None, :] if exclude_self else np.zeros((len(own), len(z)), bool)
            for i, met in enumerate(homes[at : at + step]):
                for cell in here.intersection(met):
                    same[i] |= cells == cell
            i, j, dist = _k_nearest(x[at : at + step], z, k, p, bound[at : at + step], same)
            found.append(pd.DataFrame({"qkey": own[i], "tkey": tkeys[j], "tlabel": tlabels[j], "dist": dist}))
        return pd.concat(found)

    keys = ["pack", "_t", "_q"]
    return q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(nearest, schema)


def _best(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("qkey").orderBy("dist", "tkey"))
    return pairs.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


class PivotSearch:
    """Train rows in cells around pivots: ``neighbors`` gives the exact k nearest, ``visits`` what that took.

    ``cells`` defaults to the square root of the train rows, at most MAX_CELLS. Pivots are the train rows with the
    smallest hashes of their keys; they decide what is compared, never the result.
    """

    def __init__(self, train: DataFrame, features: str, key: str, label: str, k: int = 5, p: int = 2, exclude_self: bool = False, cells: int | None = None, tile_rows: int = TILE_ROWS):
        if p not in (1, 2):
            raise ValueError("p is 1 or 2")
        self.features, self.key, self.k, self.p, self.exclude_self, self.tile_rows = features, key, k, p, exclude_self, tile_rows
        self.need = k + int(exclude_self)
        rows = _train_rows(train, features, key, label, self.need)
        wanted = min(MAX_CELLS, cells or math.ceil(math.sqrt(rows.count())))
        picked = rows.orderBy(F.xxhash64("tkey"), "tkey").limit(wanted).select("tvec").collect()
        pivots = np.unique(np.array([r["tvec"] for r in picked], dtype=float), axis=0) if picked else np.zeros((0, 0))
        self.pivots = pivots
        spread, p = train.sparkSession.sparkContext.broadcast(pivots), self.p

        def cell_of(x: np.ndarray, _: pd.DataFrame) -> tuple:
            dist = _distances(x, spread.value, p)
            cell = dist.argmin(axis=1)
            return cell.astype(np.int32), dist[np.arange(len(x)), cell]

        self.rows = _with(rows, "cell int, gap double", cell_of).persist(StorageLevel.MEMORY_AND_DISK)
        found = {r["cell"]: r for r in self.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("gap").alias("lo"), F.max("gap").alias("hi")).collect()}
        take = lambda name, other: np.array([found[i][name] if i in found else other for i in range(len(pivots))])
        self.sizes, self.inner, self.outer = take("n", 0), take("lo", np.inf), take("hi", -np.inf)

    def _queries(self, query: DataFrame) -> DataFrame:
        """Queries with their home cells: the nearest ones that hold k rows together."""
        sent = query.sparkSession.sparkContext.broadcast((self.pivots, self.sizes))
        need, p = self.need, self.p

        def homes(x: np.ndarray, _: pd.DataFrame) -> tuple:
            pivots, sizes = sent.value
            order = np.argsort(_distances(x, pivots, p), axis=1, kind="stable")
            enough = (np.cumsum(sizes[order], axis=1) < need).sum(axis=1) + 1
            return ([o[:n].astype(np.int32) for o, n in zip(order, enough)],)

        return _with(_rows(query, qkey=F.col(self.key), qvec=F.col(self.features)), "homes array<int>", homes)

    def _others(self, queries: DataFrame) -> DataFrame:
        """Queries with ``visits``: cells besides their homes that may hold a row within ``bound``."""
        sent = queries.sparkSession.sparkContext.broadcast((self.pivots, self.sizes, self.inner, self.outer))
        p = self.p

        def visits(x: np.ndarray, batch: pd.DataFrame) -> tuple:
            pivots, sizes, inner, outer = sent.value
            dist = _distances(x, pivots, p)
            own = dist.argmin(axis=1)
            mine = dist[np.arange(len(x)), own][:, None]
            # The rows of a cell lie between two spheres around its pivot, and nearer to it than to any other pivot.
            least = np.maximum(dist - outer, inner - dist)
            if p == 2:
                apart = _distances(pivots[own], pivots, 2)
                with np.errstate(divide="ignore", invalid="ignore"):
                    least = np.fmax(least, np.where(apart > 0, (dist**2 - mine**2) / (2 * apart), -np.inf))
            else:
                least = np.maximum(least, (dist - mine) / 2)
            bound = batch["bound"].to_numpy()[:, None]
            may = (sizes > 0) & (least <= bound + SLACK * (1 + dist + np.where(np.isfinite(bound), bound, 0)))
            return ([np.setdiff1d(np.flatnonzero(m), h).astype(np.int32) for m, h in zip(may, batch["homes"])],)

        return _with(queries, "visits array<int>", visits)

    def _search(self, query: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Candidates of the home cells, queries with bounds and visits, candidates of the visited cells."""
        args = (self.rows.drop("gap"), self.k, self.p, self.exclude_self, self.tile_rows)
        queries = self._queries(query).persist(StorageLevel.MEMORY_AND_DISK)
        at_home = queries.select("qkey", "qvec", F.lit(math.inf).alias("bound"), F.array().cast("array<int>").alias("homes"), F.col("homes").alias("cells"))
        near = _best(_compare(at_home, *args), self.k).persist(StorageLevel.MEMORY_AND_DISK)
        bounds = near.groupBy("qkey").agg(F.max("dist").alias("worst"), F.count(F.lit(1)).alias("n")).withColumnRenamed("qkey", "_key")
        reach = F.when(F.col("n") >= self.k, F.col("worst")).otherwise(F.lit(math.inf))
        bounded = queries.join(bounds, F.col("qkey") == F.col("_key"), "left").select("qkey", "qvec", "homes", reach.alias("bound"))
        bounded = self._others(bounded).persist(StorageLevel.MEMORY_AND_DISK)
        far = _compare(bounded.select("qkey", "qvec", "bound", "homes", F.col("visits").alias("cells")), *args, packed=True)
        return near, bounded, far

    def neighbors(self, query: DataFrame) -> DataFrame:
        """qkey, tkey, tlabel, dist of the k nearest; ties in distance go to the smaller key."""
        if not len(self.pivots):
            q = _rows(query, qkey=F.col(self.key), qvec=F.col(self.features))
            return q.select("qkey", F.lit(None).cast(self.rows.schema["tkey"].dataType).alias("tkey"), F.lit(None).cast("double").alias("tlabel"), F.lit(None).cast("double").alias("dist")).where(F.lit(False))
        near, _, far = self._search(query)
        return _best(near.unionByName(far), self.k)

    def visits(self, query: DataFrame) -> DataFrame:
        """cell, n_train (distinct vectors, copies up to k), n_home and n_far: queries that met the cell as home or later."""
        table = query.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(self.sizes)], "cell int, n_train long")
        if not len(self.pivots):
            return table.select("*", F.lit(0).cast("long").alias("n_home"), F.lit(0).cast("long").alias("n_far"))
        _, bounded, _ = self._search(query)
        count = lambda column, name: bounded.select(F.explode(column).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias(name))
        return table.join(count("homes", "n_home"), "cell", "left").join(count("visits", "n_far"), "cell", "left").na.fill(0, ["n_home", "n_far"])


def nearest_approximate(
    train: DataFrame, query: DataFrame, features: str, key: str, label: str, k: int = 5, p: int = 2, exclude_self: bool = False,
    tables: int = 8, probes: int = 3, bucket_rows: int = 512, seed: int = 42, tile_rows: int = TILE_ROWS,
) -> DataFrame:
    """qkey, tkey, tlabel, dist of k near rows: those that share a bucket of random projections with the query.

    Each of ``tables`` tables names a row by the sides it takes of random planes through the mean, as many planes
    as buckets of about ``bucket_rows`` rows need. A query meets its bucket and, in each table, those across its
    ``probes`` nearest planes. Neighbours elsewhere are missed: ``recall_of`` measures how many. More tables and
    probes find more; rows of a bucket are all compared, whatever its size.
    """
    rows = _train_rows(train, features, key, label, k + int(exclude_self))
    spark = train.sparkSession
    n = rows.count()
    planes = min(max(0, math.ceil(math.log2(max(1, n / bucket_rows)))), int(math.log2(max(1, MAX_CELLS // tables))))
    first = rows.select(F.size("tvec").alias("d")).first()
    d = first["d"] if first else 0
    middle = rows.select(F.posexplode("tvec").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m")).collect()
    mean = np.zeros(d)
    for r in middle:
        mean[r["i"]] = r["m"]
    normal = np.random.default_rng(seed).normal(size=(tables, planes, d))
    normal /= np.maximum(np.linalg.norm(normal, axis=2, keepdims=True), 1e-300)
    sent = spark.sparkContext.broadcast((mean, normal))

    def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, normal = sent.value
        side = np.einsum("nd,tpd->ntp", x - mean, normal)
        weights = 1 << np.arange(planes, dtype=np.int64)
        return side, ((side > 0) * weights).sum(axis=2) + (np.arange(tables) << planes)

    def own(x: np.ndarray, _: pd.DataFrame) -> tuple:
        return (list(codes(x)[1].astype(np.int32)),)

    def probed(x: np.ndarray, _: pd.DataFrame) -> tuple:
        side, code = codes(x)
        turn = np.argsort(np.abs(side), axis=2, kind="stable")[:, :, :probes]
        more = code[:, :, None] ^ (1 << turn)
        return (list(np.concatenate([code, more.reshape(len(x), -1)], axis=1).astype(np.int32)),)

    t = _with(rows, "cells array<int>", own).select("tkey", "tvec", "tlabel", F.explode("cells").alias("cell")).persist(StorageLevel.MEMORY_AND_DISK)
    q = _with(_rows(query, qkey=F.col(key), qvec=F.col(features)).where(F.lit(n > 0)), "cells array<int>", probed)
    q = q.select("qkey", "qvec", F.lit(math.inf).alias("bound"), F.array().cast("array<int>").alias("homes"), "cells").persist(StorageLevel.MEMORY_AND_DISK)
    found = _compare(q, t, k, p, exclude_self, tile_rows)
    return _best(found.dropDuplicates(["qkey", "tkey"]), k)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """n_exact, n_found, recall: how many of the exact neighbours (qkey, tkey) were found."""
    have = found.select("qkey", "tkey", F.lit(1).alias("hit"))
    row = exact.select("qkey", "tkey").join(have, ["qkey", "tkey"], "left").agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found"))
    return row.withColumn("recall", F.col("n_found") / F.col("n_exact"))


def vote(best: DataFrame, key: str, weights: str = "uniform", task: str = "classification") -> DataFrame:
    """``key, prediction`` from the neighbours of each query; ties in votes go to the smaller label."""
    if weights == "distance":
        # A neighbour at distance zero outweighs all others.
        exact = F.max((F.col("dist") == 0).cast("int")).over(W.partitionBy("qkey"))
        weight = F.when(exact == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        weight = F.lit(1.0)
    best = best.withColumn("_w", weight)
    if task == "regression":
        out = best.groupBy("qkey").agg((F.sum(F.col("_w") * F.col("tlabel")) / F.sum("_w")).alias("prediction"))
    else:
        votes = best.groupBy("qkey", "tlabel").agg(F.sum("_w").alias("_v"))
        out = votes.groupBy("qkey").agg(F.min_by("tlabel", F.struct(-F.round("_v", 12), F.col("tlabel"))).alias("prediction"))
    return out.withColumnRenamed("qkey", key)


def knn_predict(
    train: DataFrame, query: DataFrame, features: str, key: str, label: str, k: int = 5, weights: str = "uniform", p: int = 2,
    task: str = "classification", exclude_self: bool = False, tile_rows: int = TILE_ROWS, cells: int | None = None, approximate: bool = False,
) -> DataFrame:
    """k nearest neighbours: ``key, prediction``; exact, or by random projections with ``approximate``.

    Ties in distance are broken by the train key, ties in votes by the smaller label. Queries without a whole
    vector, and all of them if no train row has one, get no line.
    """
    if approximate:
        best = nearest_approximate(train, query, features, key, label, k, p, exclude_self, tile_rows=tile_rows)
    else:
        best = PivotSearch(train, features, key, label, k, p, exclude_self, cells, tile_rows).neighbors(query)
    return vote(best, key, weights, task)
