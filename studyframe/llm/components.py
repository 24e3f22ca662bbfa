"""Connected components by alternating stars, and bounded work lists over large groups.

Both work on groups of any size: edges stay linear in the nodes, and a group too large for one task is cut into
parts whose pairs are tasks of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm.common import join_groups, written
from studyframe.llm.textkernel import resting


def _to_lowest(pairs: DataFrame, total: int) -> DataFrame:
    """pairs (u, v) with the smallest of u and its partners: u, v, low. u may have a third of all pairs."""
    low = written(pairs.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("low"), F.count(F.lit(1)).alias("n")))
    return join_groups(pairs, low, "u", "n", total, "v").select("u", "v", "low")


#: Up to so many edges are settled by one task, without rounds.
FEW_EDGES = 200_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    nodes = pa.chunked_array([*table["v"].chunks, *table["u"].chunks]).combine_chunks().dictionary_encode()
    names, index = nodes.dictionary, nodes.indices.to_numpy()
    order = np.empty(len(names), dtype=np.int64)
    order[pa.compute.sort_indices(names).to_numpy()] = np.arange(len(names))
    parent = list(range(len(names)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for v, u in zip(index[: table.num_rows].tolist(), index[table.num_rows :].tolist()):
        v, u = find(v), find(u)
        if v != u:
            parent[v if order[v] > order[u] else u] = u if order[v] > order[u] else v
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array([find(x) for x in range(len(names))]))], ["node", "root"])


def connected(edges: DataFrame, rounds: int = 100, few: int = FEW_EDGES) -> DataFrame:
    """node, root for every node of edges (a, b); root is the smallest node of the component.

    Large and small stars in turn: a node links its larger partners, then its smaller ones, to its smallest
    partner, until every node is linked to its root alone. Ids are of any orderable type; edges with a null end
    and edges from a node to itself count for nothing.
    """
    pairs = written(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    kind = pairs.schema["u"].dataType.simpleString()
    if pairs.count() <= few:
        return written(pairs.select("v", "u").repartition(1).mapInArrow(resting(_in_one_task), f"node {kind}, root {kind}"))
    mark = None
    for _ in range(rounds):
        n, check = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if not n or (n, check) == mark:
            break
        mark = n, check
        both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_to_lowest(both, 2 * n).where("v > u").select("v", F.col("low").alias("u")).distinct())
        small = _to_lowest(large.select(F.col("v").alias("u"), F.col("u").alias("v")), n)  # u larger, v smaller
        small = small.select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("low").alias("u")), F.struct("v", F.col("low").alias("u")))).alias("x")).select("x.*")
        pairs = written(small.where("u <> v").distinct())
    else:
        raise RuntimeError("the components did not settle")
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def tasks_of(members: DataFrame, total: int, bound: int) -> DataFrame:
    """Of members (comp, node, weight): node, task, part.

    A component whose weights sum to at most `bound` is one task. A larger one is cut by hash into parts of that
    weight; each pair of parts is a task, and each member is in the tasks of its part. Within a task of two
    parts only pairs across the parts are due. Every pair of the component is due in exactly one task.
    """
    sizes = members.groupBy("comp").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.sum("weight") / bound).cast("int").alias("parts")).where("n > 1")
    found = join_groups(members, sizes, "comp", "n", total, "node").where("parts is not null")
    found = found.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    task = F.xxhash64("comp", F.least("part", "other"), F.greatest("part", "other"))
    return found.select("node", task.alias("task"), "part", F.concat_ws("|", F.col("comp").cast("string"), F.least("part", "other"), F.greatest("part", "other")).alias("task_key"))


def per_task(rows: DataFrame, work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """Run work over the rows of each task_key, which are few enough for memory; small tasks share a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column("task_key")
            cuts = np.flatnonzero(keys.slice(1).to_numpy(zero_copy_only=False) != keys.slice(0, len(keys) - 1).to_numpy(zero_copy_only=False)) + 1
            edges = [0, *cuts.tolist(), batch.num_rows]
            for first, last in zip(edges, edges[1:]):
                if held and held[0].column("task_key")[0] != keys[first]:
                    yield work(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(first, last - first))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition("task_key").sortWithinPartitions("task_key").mapInArrow(resting(run), schema)


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) join two trees not joined before: a mask of a spanning forest."""
    ids, inverse = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent, left, right = list(range(len(ids))), inverse[: len(a)].tolist(), inverse[len(a) :].tolist()
    mask = np.zeros(len(a), dtype=bool)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(left, right)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            mask[i] = True
    return mask
