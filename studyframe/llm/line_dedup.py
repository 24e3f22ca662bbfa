"""Fuzzy line deduplication over a whole corpus.

Lines are normalised (A-Z to a-z, digits to 0, runs of white space to one space, trimmed) and equal ones become
one class. Each class has a 64-bit SimHash of its words. SimHashes within DISTANCE bits of each other agree in all
but DISTANCE of some blocks of bits, so they meet in a join on the remaining blocks. Lines whose SimHashes are
linked this way are candidates; those whose edit similarity is SIMILAR or more are linked, and of each connected
group the first occurrence in the corpus stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from studyframe.llm import textkernel as tk
from studyframe.llm.bits import Filter
from studyframe.llm.common import join_groups, kept, packed, unpacked
from studyframe.llm.components import connected, forest, per_task, tasks_of

#: Lines with fewer words are never removed.
LEAST_WORDS = 3
DISTANCE = 3
SIMILAR = 0.8
#: Characters of a task that settles candidate lines.
TASK_CHARS = 4_000_000

_U = np.uint64
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_BIT = np.arange(64, dtype=_U)
# The bits of a byte, each as a byte of one number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").copy().view("<u8").ravel()


def normalise(line: bytes) -> bytes:
    """The normal form of a line in UTF-8."""
    return b" ".join(_NORMAL[np.frombuffer(line, dtype=np.uint8)].tobytes().split())


class Lines:
    """The \\n-split lines of one text with LEAST_WORDS words: position among all its lines, digest, SimHash, bounds."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, hashed: bool = True):
        start = np.union1d(np.flatnonzero(data == 10) + 1, bounds[:-1])
        text = np.searchsorted(bounds, start, side="right") - 1
        # an empty text begins where the next one does, and a text that ends in \n has an empty last line: neither counts
        number = np.arange(len(start)) - np.searchsorted(start, bounds[text])
        end = np.append(start[1:], len(data))
        words = tk.words_of(_NORMAL[data], np.append(start, len(data)), False)
        n = np.diff(words.offsets)
        use = np.flatnonzero(n >= LEAST_WORDS)
        self.text, self.number, self.start = text[use], number[use], start[use]
        self.end = end[use] - ((end[use] > start[use]) & (data[np.maximum(end[use] - 1, 0)] == 10))
        self.digests, self.simhash = self._marks(words, use, hashed)

    @staticmethod
    def _marks(words: tk.Words, use: np.ndarray, hashed: bool) -> tuple[list[bytes], np.ndarray]:
        first, n = words.offsets[use], np.diff(words.offsets)[use]
        upto, at = np.cumsum(n), 0
        two, simhash = np.zeros((len(use), 2), dtype=_U), np.zeros(len(use), dtype=_U)
        while at < len(use):  # some lines at a time: a word takes 64 votes
            end = max(at + 1, int(np.searchsorted(upto, upto[at] - n[at] + 16_384)))
            count = n[at:end]
            cuts = np.cumsum(count) - count
            place = np.arange(int(count.sum())) - np.repeat(cuts, count)
            h = words.hashes[np.repeat(first[at:end], count) + place]
            if hashed:
                line = np.repeat(np.arange(len(count)), count)
                # ordered by line and the leading bits of the words, and by all of them where those do not tell two words apart
                mark = line.astype(_U) << _U(50) | h >> _U(14)
                order = np.argsort(mark)
                if len(count) > 1 << 14 or bool(((mark[order[1:]] == mark[order[:-1]]) & (h[order[1:]] != h[order[:-1]])).any()):
                    order = np.lexsort((h, line))
                sorted_h, line = h[order], line[order]
                once = np.append(True, (sorted_h[1:] != sorted_h[:-1]) | (line[1:] != line[:-1]))
                voters = np.bincount(line[once], minlength=len(count))
                voting, first_vote = sorted_h[once].astype("<u8").view(np.uint8).reshape(-1, 8), np.cumsum(voters) - voters
                if voters.max() < 256:  # the votes of eight bits at a time, a byte each
                    votes = np.add.reduceat(_LANES[voting], first_vote, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int64)
                else:
                    votes = np.add.reduceat(np.unpackbits(voting, axis=1, bitorder="little").astype(np.int64), first_vote, axis=0)
                more = 2 * votes > voters[:, None]
                simhash[at:end] = np.packbits(more, axis=1, bitorder="little").view("<u8").ravel()
            with np.errstate(over="ignore"):
                for k, seed in enumerate((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)):
                    two[at:end, k] = tk.mix(np.add.reduceat(tk.mix(h + tk.mix(place.astype(_U) + _U(seed))), cuts) + count.astype(_U))
            at = end
        raw = two.astype("<u8").tobytes()
        return [raw[16 * i : 16 * i + 16] for i in range(len(use))], simhash


def line_table(docs: DataFrame) -> DataFrame:
    """doc_id, text_id (hash of the whole text), line (its position), digest, simhash, chars of every line with LEAST_WORDS words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, bounds in tk.texts(batch.column(1)):
                x = Lines(data, bounds)
                ids, texts = (batch.column(c).slice(first, last - first).take(pa.array(x.text)) for c in (0, 2))
                yield pa.RecordBatch.from_arrays([ids, texts, pa.array(x.number.astype(np.int32)), pa.array(x.digests, pa.binary()), pa.array(x.simhash.view(np.int64)), pa.array((x.end - x.start).astype(np.int64))], ["doc_id", "text_id", "line", "digest", "simhash", "chars"])

    rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text", "xxhash64(cast(text as string)) text_id")
    return rows.mapInArrow(tk.resting(run), "doc_id long, text_id long, line int, digest binary, simhash long, chars long")


def block_count(n: int) -> int:
    """Blocks of bits such that n SimHashes spread over the keys: all but DISTANCE of them make a key."""
    return next((b for b in range(DISTANCE + 2, 12) if (b - DISTANCE) * (64 // b) + 4 >= np.log2(max(n, 1))), 12)


def similar_simhashes(hashes: DataFrame, n: int) -> DataFrame:
    """Links a, b among distinct SimHashes (column simhash): of each key's list, a spanning forest of the pairs within DISTANCE."""
    blocks = block_count(n)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - DISTANCE)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        keys.append(F.struct(F.lit(number).alias("table"), F.col("simhash").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)).alias("key")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in [*batches, None]:
            rows = held if batch is None else [np.concatenate(x) for x in zip(held, (batch.column(i).to_numpy() for i in range(3)))]
            table, key, own = rows
            if not len(own):
                continue
            new = np.append(True, (table[1:] != table[:-1]) | (key[1:] != key[:-1]))
            upto = len(own) if batch is None else int(np.flatnonzero(new)[-1])
            run_of, own, found = np.cumsum(new)[:upto], own[:upto], []
            step, at = 1, np.arange(upto - 1)
            while len(at):  # neighbours at ever larger steps, as long as their lists last
                at = at[at + step < upto]
                at = at[run_of[at] == run_of[at + step]]
                near = at[np.bitwise_count(own[at] ^ own[at + step]) <= DISTANCE]
                found.append((own[near], own[near + step]))
                step += 1
            a, b = (np.concatenate(x) for x in zip(*found)) if found else (own[:0], own[:0])
            some = forest(a, b) if len(a) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], ["a", "b"])
            held = [x[upto:] for x in rows]

    spread = hashes.select("simhash", F.explode(F.array(*keys)).alias("k")).select(F.col("k.table").cast("long").alias("table"), F.col("k.key").alias("key"), "simhash")
    return spread.repartition("table", "key").sortWithinPartitions("table", "key").mapInArrow(tk.resting(run), "a long, b long")


def distance_within(a: str, b: str, most: int) -> bool:
    """Whether the Levenshtein distance is `most` or less, by bit-parallel columns over whole numbers."""
    if abs(len(a) - len(b)) > most:
        return False
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << max(len(a) - 1, 0)
    up, down, score = full, 0, len(a)
    if not a:
        return len(b) <= most
    for i, c in enumerate(b):
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right & top) - bool(left & top)
        if score - (len(b) - 1 - i) > most:
            return False
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down = (left | ~(diagonal | right)) & full, right & diagonal
    return score <= most


def similar_lines(a: str, b: str) -> bool:
    longest = max(len(a), len(b))
    return distance_within(a, b, int((1 - SIMILAR) * longest + 1e-9))


def _settle(table: pa.Table) -> pa.RecordBatch:
    """A spanning forest of the links among the lines of a task, tried in order of SimHash distance."""
    simhash, digest = table["simhash"].to_numpy(), table["digest"].to_pylist()
    lines, part = [x.decode("utf-8", "replace") for x in table["text"].to_pylist()], table["part"].to_numpy()
    size, links = np.array([len(x) for x in lines]), []
    root, members = np.arange(len(lines)), {i: [i] for i in range(len(lines))}
    across = len(set(part.tolist())) > 1
    for i in range(1, len(lines)):
        due = (root[:i] != root[i]) & (size[:i] >= SIMILAR * size[i] - 1) & (SIMILAR * size[:i] - 1 <= size[i])
        near = np.flatnonzero(due & (part[:i] != part[i]) if across else due)
        apart = np.bitwise_count(simhash[near] ^ simhash[i])
        for j in near[np.argsort(apart, kind="stable")[: (apart <= DISTANCE).sum()]].tolist():
            if root[i] != root[j] and similar_lines(lines[i], lines[j]):
                keep, gone = sorted((int(root[i]), int(root[j])), key=lambda r: -len(members[r]))
                moved = members.pop(gone)
                root[moved] = keep
                members[keep] += moved
                links.append((digest[i], digest[j]))
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.binary()) for k in (0, 1)], ["a", "b"])


def _line_texts(docs: DataFrame, carriers: Filter) -> DataFrame:
    """digest, text (normalised) of the lines of documents whose id is in carriers; a digest once per task."""
    sent = docs.sparkSession.sparkContext.broadcast(carriers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for _, _, data, bounds in tk.texts(batch.column(1).filter(pa.array(sent.value.has(batch.column(0))))):
                x, got = Lines(data, bounds, hashed=False), {}
                for digest, a, b in zip(x.digests, x.start.tolist(), x.end.tolist()):
                    if digest not in seen:
                        seen.add(digest)
                        got[digest] = normalise(data[a:b].tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], ["digest", "text"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tk.resting(run), "digest binary, text binary")


def removed_lines(docs: DataFrame, task_chars: int = TASK_CHARS) -> DataFrame:
    """doc_id, text_id, line of every line that goes: all of a group of similar lines but the first by (doc_id, line, text_id)."""
    lines = kept(line_table(docs))
    classes = kept(
        lines.groupBy("digest").agg(F.min(F.struct("doc_id", "line", "text_id")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("simhash").alias("simhash"), F.max("chars").alias("weight"))
    )
    hashes = kept(classes.groupBy("simhash").agg(F.count(F.lit(1)).alias("n")))
    groups = connected(similar_simhashes(hashes.select("simhash"), hashes.count()))
    alone = hashes.where("n > 1").select(F.col("simhash").alias("node"), F.col("simhash").alias("root")).join(groups, "node", "left_anti")
    groups = groups.unionByName(alone)
    # SimHashes stand for few lines each, save for degenerate ones: those lines are dealt out by their digest
    found = join_groups(classes, groups.join(hashes, F.col("node") == F.col("simhash")).select("node", "root", "n").withColumnRenamed("node", "simhash"), "simhash", "n", hashes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], "digest")
    members = kept(found.where("root is not null").select(F.col("root").alias("comp"), F.col("digest").alias("node"), "weight", "simhash", F.col("first.doc_id").alias("carrier")))
    tasks = kept(tasks_of(members.select("comp", "node", "weight"), members.count(), task_chars))
    carriers = Filter.of(members.select("carrier"))
    texts = _line_texts(docs, carriers).dropDuplicates(["digest"])
    due = tasks.join(members.select("node", "simhash"), "node").join(texts, F.col("node") == F.col("digest")).select("task_key", "part", "simhash", "digest", "text")
    links = connected(per_task(due, _settle, "a binary, b binary"))
    firsts = classes.join(links, F.col("digest") == F.col("node"))
    group_first = firsts.groupBy("root").agg(F.min("first").alias("stays"), F.count(F.lit(1)).alias("n_classes"))
    linked = join_groups(links, group_first, "root", "n_classes", max(1, links.count()), "node").select(F.col("node").alias("digest"), "stays")
    stays = classes.join(linked, "digest", "left").where("n > 1 or stays is not null").select("digest", "n", F.coalesce("stays", "first").alias("stays"))
    gone = join_groups(lines.select("doc_id", "text_id", "line", "digest"), kept(stays), "digest", "n", lines.count(), "doc_id")
    return gone.where("stays is not null and not struct(doc_id, line, text_id) <=> stays").select("doc_id", "text_id", "line").distinct()


def _cut_lines(text: pd.Series, lines: pd.Series) -> pd.Series:
    def one(t: str | None, gone) -> str | None:
        if t is None or gone is None or not len(gone):
            return t
        gone = set(gone)
        return "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone)

    return pd.Series([one(t, g) for t, g in zip(text, lines)], dtype=object)


# A filter on the new text would be pushed below it and cut the lines a second time, in a second worker beside the first;
# Spark leaves functions that it thinks random where they are.
_without = F.pandas_udf(_cut_lines, StringType()).asNondeterministic()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns and rows, with the removed lines cut out of text, and n_removed behind them.

    Lines with fewer than LEAST_WORDS words stay, null text stays null and an empty one empty; a text that loses
    every line becomes empty. Of occurrences in the same group the one with the smallest (doc_id, line) stays,
    rows without id first; among rows with the same id, that whose text has the smaller hash. Rows with the same id
    and text share their decisions: a line goes from all of them or none.
    Linked are lines whose SimHashes differ in DISTANCE bits at most and whose edit similarity, 1 - Levenshtein
    distance / longer length, is SIMILAR or more. A column n_removed of docs is replaced.
    """
    gone = removed_lines(docs).groupBy("doc_id", "text_id").agg(F.collect_list("line").alias("_gone"))
    rows = packed(docs).withColumn("_text_key", F.xxhash64(F.col("_row")["text"].cast("string")))
    same = F.col("_key").eqNullSafe(F.col("doc_id")) & (F.col("_text_key") == F.col("text_id"))
    out = rows.join(gone, same, "left").withColumn("_text", _without(F.col("_row")["text"].cast("string"), F.col("_gone")))
    out = out.withColumn("_n", F.greatest(F.coalesce(F.size("_gone"), F.lit(0)), F.lit(0)))
    columns = [c for c in docs.columns if c != "n_removed"]
    return unpacked(out, [*columns, "n_removed"], text=F.col("_text"), n_removed=F.col("_n"))
