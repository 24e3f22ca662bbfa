"""Centroid clustering in exact integers, with Orchard's search for the nearest centroid.

Every centroid keeps the others in order of distance. A search begins at centroid 0 and walks the list of the
best centroid found so far; a closer one makes it jump to that one's list. Centroids once visited are passed over,
and the walk stops strictly beyond twice the current distance, where none can be as near. Whole batches of vectors
walk at once. Tasks send one line of sums per centroid, so no cluster is ever gathered, however large.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm.common import written
from studyframe.llm.textkernel import resting

DIMS, SCALE, CENTROIDS, ROUNDS, SEED = 64, 64, 16, 3, 1
#: Integers beyond this would not leave squared distances room in 64 bits.
LARGEST = 1 << 26
#: Vectors that walk at once.
WALK = 4096


def integers(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[pa.Array, np.ndarray]:
    """Ids and floor(scale * x) of the vectors of a batch (id, vector) with `dims` components, none null or non-finite."""
    vectors = batch.column(1)
    whole = pc.fill_null(pc.equal(pc.list_value_length(vectors), dims), False)
    ids, vectors = batch.column(0).filter(whole), vectors.filter(whole)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)
    good = np.isfinite(flat).all(axis=1)
    with np.errstate(over="ignore"):
        scaled = np.floor(flat[good] * scale)
    if len(scaled) and np.abs(scaled).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}: its squared distances do not fit a long")
    return ids.filter(pa.array(good)), scaled.astype(np.int64)


class Centroids:
    """k centroids with, for each, the others by distance (ties by number) and those squared distances."""

    def __init__(self, centroids: list[list[int]], dims: int):
        self.at = np.array(centroids, dtype=np.int64).reshape(-1, dims)
        k = len(self.at)
        self.lists, self.gaps = np.zeros((k, max(k - 1, 0)), dtype=np.int64), np.zeros((k, max(k - 1, 0)), dtype=np.int64)
        for c in range(k):
            gaps = _squares(self.at - self.at[c])
            order = np.argsort(gaps, kind="stable")
            self.lists[c] = order[order != c]
            self.gaps[c] = gaps[self.lists[c]]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid (ties: the smaller one) and the squared distance of each vector."""
        n, others = len(vectors), self.lists.shape[1]
        best, place = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        distance = _squares(vectors - self.at[0])
        visited = np.zeros((n, others + 1), dtype=bool)
        visited[:, 0] = True
        walking = np.arange(n if others else 0)
        while len(walking):
            here = best[walking], place[walking]
            on = self.gaps[here] <= 4 * distance[walking]
            walking, there = walking[on], self.lists[here][on]
            place[walking] += 1
            new = ~visited[walking, there]
            row, there = walking[new], there[new]
            visited[row, there] = True
            found = _squares(vectors[row] - self.at[there])
            closer = (found < distance[row]) | (found == distance[row]) & (there < best[row])
            row = row[closer]
            best[row], distance[row], place[row] = there[closer], found[closer], 0
            walking = walking[place[walking] < others]
        return best, distance


def _squares(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def _vectors(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))


def first_centroids(rows: DataFrame, k: int, dims: int, scale: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:id`, in that order; rows without id come last, equal ids by vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = integers(batch, dims, scale)
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * dims)
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, pa.array(vectors.ravel()))], ["id", "vector"])

    found = rows.mapInArrow(resting(run), "id long, vector array<long>")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r["vector"] for r in found.orderBy(order.asc_nulls_last(), "vector").limit(k).collect()]


def _moved(rows: DataFrame, centroids: list[list[int]], dims: int, scale: int) -> list[list[int]]:
    """Centroids after a round: the floor of the exact mean of their vectors; those without vectors stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Centroids(centroids, dims)
        sums, counts = np.zeros_like(made.at), np.zeros(len(made.at), dtype=np.int64)
        for batch in batches:
            vectors = integers(batch, dims, scale)[1]
            for first in range(0, len(vectors), WALK):
                some = vectors[first : first + WALK]
                best = made.nearest(some)[0]
                order = np.argsort(best, kind="stable")
                numbers, starts = np.unique(best[order], return_index=True)
                sums[numbers] += np.add.reduceat(some[order], starts)
                counts += np.bincount(best, minlength=len(counts))
        used = np.flatnonzero(counts)
        offsets = pa.array(np.arange(len(used) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), pa.ListArray.from_arrays(offsets, pa.array(sums[used].ravel()))], ["cluster", "n", "sums"])

    lines = rows.mapInArrow(resting(run), "cluster long, n long, sums array<long>")
    totals = lines.groupBy("cluster").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(dims)))
    out = list(centroids)
    for r in totals.collect():  # a line per centroid
        out[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return out


def cluster(
    vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, scale: int = SCALE, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) per kept vector, and the final centroids.

    Kept are vectors with exactly `dims` components, none null or non-finite; as integers floor(scale * x).
    Repeated rows each count and each get a line; a null id is an id like others, but begins no cluster as long as
    there are k rows with one. With fewer than k kept vectors there are as many centroids. Equal centroids: the
    smaller number gets the vectors, the other stays where it is. An empty table gives no lines and no centroids.
    Further columns are ignored. A component beyond LARGEST / scale raises. The k centroids are held by the driver
    and every task; nothing else grows there.
    """
    spark = vectors.sparkSession
    rows = _vectors(vectors, id_column, vector_column)
    centroids = first_centroids(rows, k, dims, scale, seed)
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids, dims, scale)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Centroids(centroids, dims)
        for batch in batches:
            ids, found = integers(batch, dims, scale)
            for first in range(0, len(ids), WALK):
                best, distance = made.nearest(found[first : first + WALK])
                yield pa.RecordBatch.from_arrays([ids.slice(first, WALK), pa.array(best.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = written(rows.mapInArrow(resting(run), "vec_id long, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    lines = spark.createDataFrame([(c, s, sum(sums.values())) for c, s in sums.items()], "cluster int, cluster_inertia long, inertia long")
    return assigned.join(F.broadcast(lines), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia"), centroids


def centroid_digests(assigned: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """assigned with centroid_sha256 of each row's centroid: its components in decimal, joined by commas."""
    digests = [(c, hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()) for c, x in enumerate(centroids)]
    lines = assigned.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return assigned.join(F.broadcast(lines), "cluster").select(*assigned.columns, "centroid_sha256")
