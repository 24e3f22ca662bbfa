"""Merkle manifest of a dataset: a hash tree per part, a root over the parts, and a proof for every row.

Leaves are ranked within their part by one range-partitioned sort, and every aligned block of 512 keeps its levels
as strings of hex digests: fixed-width substrings of one level hash to the next, and the substrings on both sides of
a node are its siblings. The roots of a part's blocks are the leaves of the next pass, until one block is left; the
parts' roots go the same way. Proofs come down again from block to block. Texts are hashed where they are read; only
digests are shuffled, and a part that holds all rows costs no more than many parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from studyframe.llm.common import written

FAN, HEX = 8, 64
#: Levels within a block, and its leaves.
LEVELS = 3
BLOCK = FAN**LEVELS
RUN = FAN * HEX
PATH = "array<struct<left:string,right:string>>"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """SHA-256, in hex, of the values one after the other: each `-` if null, else its UTF-8 bytes' number, `:`, itself."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def fold(node: Column, path: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(path, node, lambda at, level: F.sha2(F.concat(level["left"], at, level["right"]), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 of all siblings, level by level upwards, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda level: F.concat(level["left"], level["right"])), ""), 256)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with pos (0, 1, ... by `order` within key) and total (rows of the key); rows equal in all of it take any order.

    Partitions are ranges of (key, order), so a hot key is many of them; rows are numbered where they are sorted, and
    each key's first number in a partition, with the rows of the partitions before, turns that into a rank.
    """
    rows = written(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order).withColumn("at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("range", F.shiftright("at", 33))
    runs = rows.groupBy("key", "range").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("key").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("key", "range", (before - F.col("first")).alias("shift"), F.sum("n").over(W.partitionBy("key")).alias("total"))
    return rows.join(runs, ["key", "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "range", "shift")


def _parents(level: Column) -> Column:
    runs = F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / RUN).cast("int"))
    return F.array_join(F.transform(runs, lambda p: F.sha2(F.substring(level, p * RUN + 1, F.lit(RUN)), 256)), "")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Nodes (key, pos, total, digest, ...) as blocks: key, block, total, items, l0 to l2, top.

    A key of at most BLOCK nodes is one block, whose levels end at its root; of larger keys every block, the last one
    too, goes up LEVELS levels, as the tree does."""
    items = F.sort_array(F.collect_list(F.struct("pos", "digest", *carry)))
    out = nodes.groupBy("key", F.floor(F.col("pos") / BLOCK).alias("block"), "total").agg(items.alias("items"))
    out = out.withColumn("l0", F.array_join(F.transform("items", lambda x: x["digest"]), ""))
    for level in range(1, LEVELS + 1):
        out = out.withColumn(f"l{level}", F.when(F.col("total") > FAN ** (level - 1), _parents(F.col(f"l{level - 1}"))))
    return out.withColumn("top", F.coalesce(*(F.col(f"l{level}") for level in range(LEVELS, -1, -1)))).drop(f"l{LEVELS}")


def _grown(nodes: DataFrame, carry: list[str]) -> list[DataFrame]:
    """The passes over nodes (key, pos, total, digest, ...), each BLOCK times shorter; the last has a block per key."""
    passes = [written(_blocks(nodes, carry), "merkle")]
    while (passes[-1].agg(F.max("total")).first()[0] or 0) > BLOCK:
        tops = passes[-1].select("key", F.col("block").alias("pos"), F.ceil(F.col("total") / BLOCK).alias("total"), F.col("top").alias("digest"))
        passes.append(written(_blocks(tops, []), "merkle"))
    return passes


def _siblings(level: Column, node: Column) -> Column:
    run = F.substring(level, F.floor(node / FAN).cast("int") * RUN + 1, F.lit(RUN))
    at = F.pmod(node, F.lit(FAN)).cast("int") * HEX
    return F.struct(F.substring(run, F.lit(1), at).alias("left"), F.substring(run, at + HEX + 1, F.lit(RUN)).alias("right"))


def _descended(passes: list[DataFrame], carry: list[str]) -> DataFrame:
    """The leaves of the passes, whose last one has also path (the block's own, up to the root), subroot and root."""
    above = passes[-1]
    for at in range(len(passes) - 1, -1, -1):
        run = F.explode(F.sequence(F.lit(0), F.floor((F.octet_length("l0") - 1) / RUN).cast("int")))
        nodes = above.withColumn("run", run)
        steps = [F.when(F.col("total") > FAN**level, F.array(_siblings(F.col(f"l{level}"), F.floor(F.col("run") / FAN ** (level - 1)).cast("int")))).otherwise(F.array().cast(PATH)) for level in range(1, LEVELS)]
        nodes = nodes.withColumn("path", F.concat(*steps, F.col("path"))).withColumn("l0", F.substring(F.col("l0"), F.col("run") * RUN + 1, F.lit(RUN)))
        nodes = nodes.select("key", "block", "total", "l0", "path", "subroot", "root", F.posexplode(F.slice("items", F.col("run") * FAN + 1, F.lit(FAN))).alias("place", "item"))
        step = F.when(F.col("total") > 1, F.array(_siblings(F.col("l0"), F.col("place")))).otherwise(F.array().cast(PATH))
        nodes = nodes.select("key", *(F.col("item")[c].alias(c) for c in ("pos", "digest", *(carry if at == 0 else []))), F.concat(step, F.col("path")).alias("path"), "subroot", "root")
        if at == 0:
            return nodes
        above = passes[at - 1].join(nodes.select("key", F.col("pos").alias("block"), "path", "subroot", "root"), ["key", "block"])


def manifest(rows: DataFrame, part: str, order: list[str], digest: str, carry: list[str]) -> DataFrame:
    """A line per row: the columns of `carry`, leaf, subroot, root, and path (left and right siblings, level by level).

    Rows of a part go by `order`, nulls first, then by leaf; rows that agree in all of it are interchangeable. Parts
    go by their names' UTF-8 bytes, the null part first. A part of one row has that leaf as its subroot, and a single
    part's subroot is the root; their paths have no level there. An empty table has no lines and no root. Other
    columns of rows are ignored; those of carry may have any name and type.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(f"`{part}`").cast("string")), F.lit(""))
    order_columns = [F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)]
    carried = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    leaves = _ranked(rows.select(key.alias("key"), *order_columns, F.col(f"`{digest}`").alias("digest"), carried), [*(f"o{i}" for i in range(len(order))), "digest"])
    passes = _grown(leaves.select("key", "pos", "total", "digest", "row"), ["row"])
    tops = passes[-1].select(F.lit("").alias("key"), F.col("key").alias("part"), F.col("top").alias("digest"))
    parts = _grown(_ranked(tops, ["part"]), ["part"])
    none = F.array().cast(PATH)
    parts[-1] = parts[-1].withColumns({"path": none, "subroot": F.col("top"), "root": F.col("top")})
    parts = _descended(parts, ["part"]).select(F.col("part").alias("key"), "path", F.col("digest").alias("subroot"), "root")
    passes[-1] = passes[-1].join(parts, "key")
    return _descended(passes, ["row"]).select(*(F.col("row")[c].alias(c) for c in carry), F.col("digest").alias("leaf"), "subroot", "root", "path")


def document_manifest(docs: DataFrame) -> DataFrame:
    """manifest() of documents by lang and doc_id. Rows may repeat or lack any value; further columns are ignored.

    Columns: doc_id, leaf, subroot, root, path, and tampered_leaf, the leaf with the text's A-Z lower-cased where 3
    divides crc32 of the decimal doc_id (rows without id: never), else the leaf itself.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    folded = F.translate(F.col("text"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    rows = docs.select("doc_id", "lang", leaf(*fields, F.col("text")).alias("digest"), F.when(other, leaf(*fields, folded)).alias("tampered"))
    out = manifest(rows, "lang", ["doc_id"], "digest", ["doc_id", "tampered"])
    return out.withColumn("tampered_leaf", F.coalesce("tampered", "leaf")).drop("tampered")


def verified(proofs: DataFrame, candidate: str = "tampered_leaf") -> DataFrame:
    """proofs with folded_root, recomputed from a candidate leaf and the original siblings, and whether it is the root."""
    folded = proofs.withColumn("folded_root", fold(F.col(candidate), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))
