"""Quality rules: fixed rules on words and lines, and a hashed n-gram logistic regression for the rest.

The model is trained on labelled rows: word and character n-grams are hashed to a fixed number of weights, a
logistic regression is fitted to a bounded sample, Platt scaling on rows left out of the fit turns its score
into a probability, and a fixed threshold decides. Texts are scored in Arrow batches, whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from studyframe.llm import textkernel as tk
from studyframe.llm.common import kept

#: At most so many labelled rows of either class are sampled, half of them to fit and half to calibrate.
SAMPLE_ROWS = 1000
#: Weights of each kind of n-gram.
BUCKETS = 1 << 16
#: Kept from this probability of good quality.
KEEP_FROM = 0.5
# The base rules.
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED = 20, 8, 30
SYMBOLS = b"#*$%&|<>"

FACTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[*SYMBOLS]] = True
_CHAR_SEED = tk.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_U = np.uint64


def _per_text(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[d]:offsets[d + 1]]."""
    total = np.concatenate(([0], np.cumsum(values)))
    return total[offsets[1:]] - total[offsets[:-1]]


def _again(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key was seen earlier in the same owner; the key comes twice or more there."""
    order = np.lexsort((np.arange(len(keys)), keys, owner))
    same = np.zeros(len(keys), dtype=bool)
    same[1:] = (keys[order][1:] == keys[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    earlier, often = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    earlier[order], often[order] = same, twice
    return earlier, often


def _lines(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines of all texts, empty lines left out."""
    start = np.union1d(np.flatnonzero(data == 10) + 1, bounds[:-1])
    start = start[start < len(data)]
    if not len(start):
        return start, start
    end = np.append(start[1:], len(data))
    end = end - (data[end - 1] == 10)
    return start[end > start], end[end > start]


def base_facts(data: np.ndarray, bounds: np.ndarray, words: tk.Words) -> dict[str, np.ndarray]:
    """The base columns of some texts, as arrays with one entry per text."""
    n_words = np.diff(words.offsets)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    start, end = _lines(data, bounds)
    text_of = np.searchsorted(bounds, start, side="right") - 1
    filled = np.concatenate(([0], np.cumsum(~tk.SPACE[data])))
    real = filled[end] > filled[start]
    start, end, text_of = start[real], end[real], text_of[real]
    earlier, _ = _again(_span_hash(data, start, end), text_of)
    dup = np.bincount(text_of[earlier], minlength=len(n_words))
    grams, first = tk.windows(words, REPEAT_WINDOW)
    word_text = np.repeat(np.arange(len(n_words)), n_words)
    _, often = _again(grams, word_text[first])
    mark = np.zeros(len(words.hashes) + 1, dtype=np.int64)
    np.add.at(mark, first[often], 1)
    np.add.at(mark, first[often] + REPEAT_WINDOW, -1)
    return {
        "n_words": n_words,
        "word_chars": _per_text(words.chars.astype(np.int64), words.offsets),
        "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": _per_text((np.cumsum(mark)[:-1] > 0).astype(np.int64), words.offsets),
    }


def _span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of any length, a slice of whole spans at a time."""
    out, at = np.zeros(len(start), dtype=_U), 0
    while at < len(start):
        upto = max(at + 1, int(np.searchsorted(end, start[at] + tk.SLICE_BYTES)))
        lo, hi = start[at], end[upto - 1]
        out[at:upto] = tk.span_hashes(data[lo:hi], start[at:upto] - lo, end[at:upto] - lo, False)
        at = upto
    return out


def _features(data: np.ndarray, bounds: np.ndarray, words: tk.Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Feature blocks as (weight index of each n-gram, offsets per text): words, word pairs, 1, 2 and 4 characters."""
    mask = _U(BUCKETS - 1)
    yield (words.hashes & mask).astype(np.int64), words.offsets
    pair, first = tk.windows(words, 2)
    yield (pair & mask).astype(np.int64) + BUCKETS, np.searchsorted(first, words.offsets)
    with np.errstate(over="ignore"):
        for block, size in enumerate((1, 2, 4), start=2):
            # a gram belongs to the text in which it begins and ends; those over an edge weigh nothing
            n, index = max(0, len(data) - size + 1), np.full(len(data), 5 * BUCKETS)
            if n:
                acc = _CHAR_SEED[data[:n]].copy()
                for j in range(1, size):
                    acc = acc * _U(0x9E3779B97F4A7C15) + _CHAR_SEED[data[j : n + j]]
                index[:n] = ((acc >> _U(40)) & mask).astype(np.int64) + block * BUCKETS
            index[np.arange(len(index)) + size > np.repeat(bounds[1:], np.diff(bounds))] = 5 * BUCKETS
            yield index, bounds


BLOCKS = 5
#: Entries of the sample that one step of the fit works on at once.
RUN = 1 << 20


class Model:
    """Weights (the last is 0), bias, and the two numbers of the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def probabilities(self, data: np.ndarray, bounds: np.ndarray, words: tk.Words) -> np.ndarray:
        score = np.full(len(bounds) - 1, self.bias)
        for index, offsets in _features(data, bounds, words):
            score += _per_text(self.weights[index], offsets) / np.maximum(1, np.diff(offsets))
        return 1 / (1 + np.exp(-np.clip(self.slope * score + self.shift, -50, 50)))


def _rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows of mean counts: row starts, indices, values."""
    starts, cols, vals = [0], [], []
    for _, _, data, bounds in tk.texts(texts, limit=1 << 18):
        blocks = list(_features(data, bounds, tk.words_of(data, bounds, True)))
        for d in range(len(bounds) - 1):
            n = 0
            for index, offsets in blocks:
                own, count = np.unique(index[offsets[d] : offsets[d + 1]], return_counts=True)
                cols.append(own[own < BLOCKS * BUCKETS].astype(np.int32))
                vals.append((count / max(1, offsets[d + 1] - offsets[d]))[own < BLOCKS * BUCKETS].astype(np.float32))
                n += len(cols[-1])
            starts.append(starts[-1] + n)
    return np.array(starts), np.concatenate([*cols, np.zeros(0, np.int32)]), np.concatenate([*vals, np.zeros(0, np.float32)])


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """by, good, cols, vals: the sparse rows of labelled texts (by, good, text)."""
    for batch in batches:
        if batch.num_rows:
            starts, cols, vals = _rows(batch.column(2))
            at = pa.array(starts, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(at, pa.array(cols)), pa.ListArray.from_arrays(at, pa.array(vals))], ["by", "good", "cols", "vals"])


def fit(starts: np.ndarray, cols: np.ndarray, vals: np.ndarray, good: np.ndarray, rounds: int = 150, ridge: float = 1e-5, rate: float = 1.0) -> Model:
    """Fit on the even sparse rows by adaptive gradient steps with class-balanced loss; calibrate on the odd rows."""
    owner = np.repeat(np.arange(len(good), dtype=np.int32), np.diff(starts))
    runs = [slice(a, a + RUN) for a in range(0, len(cols), RUN)]

    def scores() -> np.ndarray:
        out = np.full(len(good), bias)
        for r in runs:
            out += np.bincount(owner[r], weights[cols[r]] * vals[r], minlength=len(good))
        return out

    fitted = np.arange(len(good)) % 2 == 0
    if len(set(good[fitted])) < 2 or len(set(good[~fitted])) < 2:
        fitted[:] = True
    y = good.astype(float)
    balance = np.where(good, 0.5 / max(1, (good & fitted).sum()), 0.5 / max(1, (~good & fitted).sum())) * fitted
    weights, bias, seen, seen_bias = np.zeros(BLOCKS * BUCKETS + 1), 0.0, np.full(BLOCKS * BUCKETS + 1, 1e-10), 1e-10
    for _ in range(rounds):
        score = scores()
        error = balance * (1 / (1 + np.exp(-np.clip(score, -50, 50))) - y)
        slope = ridge * weights
        for r in runs:
            slope += np.bincount(cols[r], error[owner[r]] * vals[r], minlength=len(weights))
        seen += slope * slope
        seen_bias += error.sum() ** 2
        weights -= rate * slope / np.sqrt(seen)
        bias -= 0.1 * rate * error.sum() / np.sqrt(seen_bias)
    score = scores()
    held = ~fitted if not fitted.all() else fitted
    return Model(weights, bias, *_platt(score[held], good[held]))


def _platt(score: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the scores, with Platt's softened targets, classes weighing alike."""
    up, down = good.sum(), (~good).sum()
    target = np.where(good, (up + 1) / (up + 2), 1 / (down + 2))
    weigh = np.where(good, 0.5 / max(1, up), 0.5 / max(1, down))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * score + shift, -50, 50)))
        g = np.array([(weigh * (p - target) * score).sum(), (weigh * (p - target)).sum()])
        v = weigh * p * (1 - p)
        h = np.array([[(v * score * score).sum(), (v * score).sum()], [(v * score).sum(), v.sum()]]) + np.eye(2) * 1e-6
        step = np.linalg.solve(h, g)
        slope, shift = slope - np.clip(step[0], -5, 5), shift - np.clip(step[1], -5, 5)
        if abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """The model from documents with a quality label; None where a class has fewer than two rows.

    The sample is the sample_rows labelled ids of either class, among those that docs has, with the smallest hashes
    (a bounded set, so it is broadcast). Its texts become sparse rows where they are, and the bounded fit over these
    runs in one task. Labels other than 0 and 1, null ids and repeats don't count.
    """
    by = F.md5(F.concat(F.lit("quality|"), F.col("doc_id").cast("string")))
    own = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("quality").cast("int").alias("_good")).where("_id is not null and _good in (0, 1)")
    own = own.groupBy("_id").agg(F.min("_good").alias("_good"), F.max("_good").alias("_most")).where("_good = _most").drop("_most").withColumnRenamed("_id", "doc_id").withColumn("_by", by)
    own = kept(own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"))
    wanted = own.where("_good = 0").orderBy("_by").limit(sample_rows).unionByName(own.where("_good = 1").orderBy("_by").limit(sample_rows))
    wanted = wanted.select(F.col("doc_id").alias("_id"), "_good", "_by")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(wanted), F.col("doc_id") == F.col("_id")).select("_by", "_good", F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        table = pa.Table.from_batches(got)
        good = table["good"].to_numpy() == 1
        order = np.lexsort((table["by"].to_numpy(), good))  # classes alternate between the halves
        good = good[order]
        if min(good.sum(), (~good).sum()) < 2:
            return
        cols, vals = (table[x].combine_chunks().take(pa.array(order)) for x in ("cols", "vals"))
        del table, got
        model = fit(cols.offsets.to_numpy().astype(np.int64), cols.values.to_numpy(), vals.values.to_numpy(), good)
        yield pa.RecordBatch.from_pydict({"weights": [model.weights.astype("<f8").tobytes()], "bias": [model.bias], "slope": [model.slope], "shift": [model.shift]})

    sparse = rows.mapInArrow(tk.resting(_sparse), "by string, good int, cols array<int>, vals array<float>")
    found = sparse.repartition(1).mapInArrow(tk.resting(run), "weights binary, bias double, slope double, shift double").collect()
    return Model(np.frombuffer(bytes(found[0]["weights"]), dtype="<f8"), found[0]["bias"], found[0]["slope"], found[0]["shift"]) if found else None


def quality_rules(docs: DataFrame, model: Model | None, keep_from: float = KEEP_FROM) -> DataFrame:
    """One line per row of docs: the base columns, base_failed, the model's probability of good quality, kept.

    Null text has no words and fails the base rule on words. Without a model every text that passes the base
    rules is kept and probability is null. Rows may repeat or lack an id; further columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, last, data, bounds in tk.texts(batch.column(1)):
                exact = tk.words_of(data, bounds, False)
                facts = base_facts(data, bounds, exact)
                n = facts["n_words"]
                failed = (n < LEAST_WORDS) | (100 * facts["n_repeat_words"] > MOST_REPEATED * n)
                p = model.probabilities(data, bounds, tk.words_of(data, bounds, True)) if model else None
                keep = ~failed & (p >= keep_from) if model else ~failed
                frame = [batch.column(0).slice(first, last - first), *(pa.array(v.astype(np.int64)) for v in facts.values()), pa.array(failed), pa.array(p, pa.float64()) if model else pa.nulls(last - first, pa.float64()), pa.array(keep)]
                yield pa.RecordBatch.from_arrays(frame, ["doc_id", *facts, "base_failed", "probability", "kept"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(tk.resting(run), FACTS)


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs that quality_rules keeps, all columns, judged in place: the texts are not shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            for first, last, data, bounds in tk.texts(batch.column(at).cast(pa.string())):
                facts = base_facts(data, bounds, tk.words_of(data, bounds, False))
                n = facts["n_words"]
                keep = (n >= LEAST_WORDS) & (100 * facts["n_repeat_words"] <= MOST_REPEATED * n)
                if model:
                    keep &= model.probabilities(data, bounds, tk.words_of(data, bounds, True)) >= KEEP_FROM
                del data, facts
                yield batch.slice(first, last - first).filter(pa.array(keep))

    return docs.mapInArrow(tk.resting(run), docs.schema)
