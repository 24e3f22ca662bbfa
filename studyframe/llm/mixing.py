"""Mixing sources to target weights, with DataFrame functions only.

Each source is dealt into blocks of documents by hash. A mix draws whole permutations (epochs) of a source's
blocks as often as its target needs, and of the last permutation a first part. The numbers of drawn blocks are
exact quotas; a splitting tree deals them to the output shards: at every node the left half gets a multivariate
hypergeometric share of the quotas, the right half the rest. A shard then takes its own stretch of each source's
permuted blocks, so shards are disjoint, and orders its copies by hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from studyframe.llm.common import WORD, kept, packed, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
#: Words of a block, about, and the most blocks of a source (so that a hot source's blocks fit a task).
BLOCK_WORDS, MOST_BLOCKS = 5_000, 65_536
LEVELS = 4


def _order(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws("|", *(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts)))


def _unit(key: Column) -> Column:
    """A number in (0, 1) from a hash."""
    return (F.conv(F.substring(key, 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(16**12))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Of rows (source, size): source, source_size, target.

    Sources by code point, null last, get the weights in turn. All targets together are share times all sizes;
    a target stops at most times its source's size and the rest is shared again by weight. That fixed point is
    min(most * size, level * weight) with one level, found over the sources in order of size per weight.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(turn, F.lit(len(weights))) + 1).cast("int"))
    by = W.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    sums = sums.withColumn("weight", weight)
    before = F.coalesce(F.sum("source_size").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing))
    everything = F.sum("source_size").over(W.partitionBy())
    sums = sums.withColumn("level", (everything * F.lit(share) - before * F.lit(most)) / after)
    level = F.max("level").over(W.partitionBy())  # it rises as long as sources stop below it, then falls
    cap = (F.col("source_size") * F.lit(most)).cast("double")
    return sums.withColumn("level", level).select("source", "source_size", F.coalesce(F.least(cap, F.col("level") * F.col("weight")), cap).alias("target"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: inside lambdas the planner shares nothing."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """The number of marked among `drawn` of `total`: the inverse distribution function at u.

    Weights are taken relative to the mode, within ten standard deviations of it, by the ratio of neighbours.
    """

    def bounded(x: Column) -> Column:
        t, m, d = x["t"], x["m"], x["d"]
        low, high = F.greatest(F.lit(0.0), d + m - t), F.least(m, d)
        mode = F.least(high, F.greatest(low, F.floor((d + 1) * (m + 1) / (t + 2)).cast("double")))
        part = m / F.greatest(t, F.lit(1.0))
        sd = F.sqrt(F.greatest(F.lit(0.0), d * part * (1 - part) * (t - d) / F.greatest(t - 1, F.lit(1.0))))
        facts = F.struct(t.alias("t"), m.alias("m"), d.alias("d"), low.alias("low"), high.alias("high"), mode.alias("mode"), (F.ceil(sd * 10) + 2).alias("reach"))
        return _let(facts, weighted)

    def weighted(x: Column) -> Column:
        first = F.greatest(x["low"], x["mode"] - x["reach"]).cast("long")
        last = F.least(x["high"], x["mode"] + x["reach"]).cast("long")
        mode, none = x["mode"].cast("long"), F.array().cast("array<bigint>")

        def climb(k: Column) -> Column:
            """The weight of k + 1 over that of k."""
            return (x["m"] - k) * (x["d"] - k) / ((k + 1) * (x["t"] - x["m"] - x["d"] + k + 1))

        def walk(ks: Column, ratio: Callable[[Column], Column]) -> Column:
            start = F.struct(F.lit(1.0).alias("w"), F.array().cast("array<double>").alias("ws"))
            return F.aggregate(ks, start, lambda s, k: _let(s["w"] * ratio(k.cast("double")), lambda w: F.struct(w.alias("w"), F.concat(s["ws"], F.array(w)).alias("ws"))))["ws"]

        up = walk(F.when(last > mode, F.sequence(mode, last - 1)).otherwise(none), climb)
        down = walk(F.when(first < mode, F.sequence(mode - 1, first, F.lit(-1))).otherwise(none), lambda k: 1 / climb(k))
        weights = F.concat(F.reverse(down), F.array(F.lit(1.0)), up)
        return _let(F.struct(first.alias("first"), last.alias("last"), weights.alias("ws")), chosen)

    def chosen(x: Column) -> Column:
        def passed(aim: Column) -> Column:
            start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(
                x["ws"], start, lambda s, w: _let(s["sum"] + w, lambda upto: F.struct(upto.alias("sum"), (s["n"] + F.when(upto < aim, 1).otherwise(0)).alias("n")))
            )["n"]

        return F.least(x["last"], x["first"] + _let(u * F.aggregate(x["ws"], F.lit(0.0), lambda s, w: s + w), passed))

    return _let(F.struct(total.cast("double").alias("t"), marked.cast("double").alias("m"), drawn.cast("double").alias("d")), bounded)


def splitting_tree(quotas: DataFrame, levels: int, seed: str) -> DataFrame:
    """Of (source, quota): one line per shard (2 ** levels) and source: shard, source, quota.

    One level after the other, each node's quotas go to its two halves. Nodes have one array of quotas, one
    entry per source; the sources are drawn one after the other from what is left, which makes the draw
    multivariate. Quotas of all shards add up to the source's, and shards differ by one block at most per level.
    """
    nodes = quotas.groupBy().agg(F.sort_array(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "quota"))).alias("parts")).select(F.lit(0).cast("long").alias("node"), "parts")
    for level in range(levels):
        total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + p["quota"])
        half = F.floor((F.col("total") + F.pmod(F.col("node"), F.lit(2))) / 2)
        start = F.struct(F.col("total").alias("left"), F.col("half").alias("room"), F.array().cast("array<bigint>").alias("got"))

        def draw(s: Column, p: Column) -> Column:
            u = _unit(_order(seed, "tree", str(level), F.col("node"), F.coalesce(p["source"], F.lit("")), p["last"]))  # noqa: B023
            taken = lambda x: F.struct((s["left"] - p["quota"]).alias("left"), (s["room"] - x).alias("room"), F.concat(s["got"], F.array(x)).alias("got"))
            return _let(_hypergeometric(s["left"], p["quota"], s["room"], u), taken)

        nodes = nodes.withColumn("total", total).withColumn("half", half)
        nodes = nodes.withColumn("got", F.aggregate("parts", start, draw)["got"])
        pair = F.zip_with("parts", "got", lambda p, g: F.struct(p["last"].alias("last"), p["source"].alias("source"), g.alias("quota")))
        rest = F.zip_with("parts", "got", lambda p, g: F.struct(p["last"].alias("last"), p["source"].alias("source"), (p["quota"] - g).alias("quota")))
        nodes = kept(nodes.select(F.explode(F.array(F.struct((F.col("node") * 2).alias("node"), pair.alias("parts")), F.struct((F.col("node") * 2 + 1).alias("node"), rest.alias("parts")))).alias("x")).select("x.*"))
    return nodes.select(F.col("node").alias("shard"), F.inline("parts")).select("shard", "source", "quota")


def _closer(found: DataFrame) -> DataFrame:
    """Bring each source nearer to its target by one document: one more is drawn, or one less, if that helps."""
    gap = F.round(F.first("target") - F.sum(F.col("size") * F.col("copies")), 6)
    gaps = found.groupBy("source").agg(gap.alias("gap"))
    near = found.join(gaps.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    step = F.signum("gap").cast("int")
    fits = (F.col("size") > 0) & (F.when(F.col("gap") > 0, F.col("copies") == F.col("epochs")).otherwise(F.col("copies") > F.col("epochs"))) & (F.col("copies") + step <= MOST)
    left = F.abs(F.abs("gap") - F.col("size"))
    best = near.where(fits & (left < F.abs("gap")) & F.col("doc_id").isNotNull()).groupBy("source").agg(F.min(F.struct(left.alias("left"), "doc_id", step.alias("step"))).alias("best"))
    # one line per source; rows that repeat the id would move the sum more than once, so those ids stay as they are
    single = found.join(best.select(F.col("source").alias("_source"), F.col("best.doc_id").alias("_id")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("doc_id") == F.col("_id"))).groupBy("_source", "_id").count().where("count = 1")
    best = best.join(single.select("_source", F.col("_id")), F.col("source").eqNullSafe(F.col("_source")) & (F.col("best.doc_id") == F.col("_id"))).select(F.col("_source").alias("_s"), F.col("_id").alias("_i"), F.col("best.step").alias("_step"))
    out = found.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("doc_id") == F.col("_i")), "left")
    return out.withColumn("copies", F.col("copies") + F.coalesce("_step", F.lit(0))).drop("_s", "_i", "_step")


def plan_mix(docs: DataFrame, levels: int = LEVELS, seed: str = "mix", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One line per row of docs: doc_id, source, size, source_size, target, taken, draws.

    size counts words (null text: 0). A document is in each whole permutation of its source, and in the first
    part of the last one while the running sum, at the document's middle, is within what the target still
    lacks; then one document more or less is drawn where that comes nearer. A source's taken words miss its
    target by half a document at most. draws has one entry per copy:
    shard, epoch, place. Null sources form one source, the last. Rows without id or that repeat an id are
    documents of their own but share their block and place. Reruns agree: every choice is a hash of seed,
    source and doc_id. Sources without words get target 0 and no copy. Further columns are ignored; an empty
    table gives no lines.
    """
    rows = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")))
    blocks_of = F.greatest(F.lit(1), F.least(F.lit(MOST_BLOCKS), F.ceil(F.col("source_size") / BLOCK_WORDS)))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = source_targets(rows, weights, share, most).withColumn("blocks", blocks_of).withColumn("epochs", F.floor(ratio))
    sources = kept(sources.withColumn("part", F.col("target") - F.col("epochs") * F.col("source_size")))
    name = F.coalesce(F.col("source"), F.lit("")), F.col("source").isNull()
    # the sources' lines are one per source: joined as a small table, where Spark finds it small
    dealt = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    dealt = dealt.withColumn("block", F.pmod(F.conv(F.substring(_order(seed, "block", F.col("doc_id")), 1, 12), 16, 10).cast("long"), F.col("blocks")))
    sums = dealt.groupBy("source", "block").agg(F.sum("size").alias("words"), F.first("part").alias("part"), F.first("epochs").alias("epochs"), F.count(F.lit(1)).alias("docs"))
    by = W.partitionBy("source").orderBy("key", "block")
    rank = lambda epoch: F.row_number().over(W.partitionBy("source").orderBy(_order(seed, "epoch", epoch, *name, F.col("block")), "block")) - 1
    sums = sums.withColumn("key", _order(seed, "epoch", F.col("epochs"), *name, F.col("block")))
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    for epoch in range(most + 1):
        sums = sums.withColumn(f"rank{epoch}", rank(str(epoch)))
    sums = sums.withColumn("drawn", (F.col("part") > 0) & (F.col("before") < F.col("part")))
    sums = kept(sums.drop("key", "part"))
    counts = sums.groupBy("source").agg(F.count(F.lit(1)).alias("filled"), F.sum(F.col("drawn").cast("long")).alias("some"), F.first("epochs").alias("epochs"))
    quotas = counts.select("source", (F.col("epochs") * F.col("filled") + F.col("some")).alias("quota"))
    stretch = splitting_tree(quotas, levels, seed).withColumn("upto", F.sum("quota").over(W.partitionBy("source").orderBy("shard")))
    stretch = stretch.groupBy("source").agg(F.sort_array(F.collect_list(F.struct("shard", "upto"))).alias("stretch"))
    stretch = kept(stretch.join(counts.select(F.col("source").alias("_s"), "filled"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    sums = sums.join(stretch.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source", "epochs")
    found = dealt.join(sums.select(F.col("source").alias("_source"), F.col("block").alias("_block"), "before", "words", "drawn", "stretch", "filled", "docs", *(f"rank{e}" for e in range(most + 1))), F.col("source").eqNullSafe(F.col("_source")) & (F.col("block") == F.col("_block")), "left").drop("_source", "_block")
    # a running sum is needed only inside the block where the part ends
    edge = F.col("drawn") & (F.col("before") + F.col("words") > F.col("part"))
    running = F.coalesce(F.sum("size").over(W.partitionBy("source", "block").orderBy(_order(seed, "place", F.col("doc_id")), "doc_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = found.where(edge).withColumn("running", running)
    outer = found.where(F.coalesce(~edge, F.lit(True))).withColumn("running", F.lit(0).cast("long"))
    found = inner.unionByName(outer)
    edge_again = F.col("drawn") & (F.col("before") + F.col("words") > F.col("part"))
    extra = (F.col("size") > 0) & F.when(edge_again, F.col("before") + F.col("running") + F.col("size") / 2 <= F.col("part")).otherwise(F.col("drawn"))
    copies = F.when(F.col("source_size") > 0, F.col("epochs") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("int")
    ranks = F.array(*(F.col(f"rank{e}") for e in range(most + 1)))

    def copy(epoch: Column) -> Column:
        draw = epoch * F.col("filled") + F.element_at(ranks, (epoch + 1).cast("int"))
        # a document drawn to close a gap may stand behind the quota: it goes with the last blocks
        shard = F.coalesce(F.get(F.filter("stretch", lambda x: x["upto"] > draw), F.lit(0)), F.element_at("stretch", -1))["shard"]
        return F.struct(shard.alias("shard"), epoch.alias("epoch"), _order(seed, "place", epoch, F.col("doc_id")).alias("place"))

    found = _closer(kept(found.withColumn("copies", copies).drop("blocks", "before", "words", "running")))
    draws = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), copy)).otherwise(F.array().cast("array<struct<shard:bigint,epoch:int,place:string>>"))
    return found.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), draws.alias("draws"))


def mix(docs: DataFrame, levels: int = LEVELS, seed: str = "mix", **options) -> DataFrame:
    """The mix itself: the columns of docs, one row per copy, shards one after the other and shuffled inside.

    Documents that repeat an id count as one draw for each of the repeated rows.
    """
    plan = plan_mix(docs, levels, seed, **options).where(F.size("draws") > 0).groupBy("doc_id").agg(F.first("draws").alias("_draws"))
    rows = packed(docs).join(plan, F.col("_key").eqNullSafe(F.col("doc_id"))).select("_row", F.explode("_draws").alias("_draw"))
    placed = rows.repartition(2**levels, F.col("_draw")["shard"]).sortWithinPartitions(F.col("_draw")["shard"], F.col("_draw")["place"], F.col("_draw")["epoch"])
    return unpacked(placed, docs.columns)
