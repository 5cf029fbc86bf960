"""Mixing sources to target weights by a splitting tree over quotas.

Each source's target is a number of words. All targets together are cut into about ``UNITS`` units of
equal size, a source's last one shorter. A binary tree over the output shards splits them: at a node the
units of all sources are ranked by a hash and one half goes to each side, which is a multivariate
hypergeometric draw that keeps the halves exact. A leaf's units of a source are its quota, in words, so the
quotas of a source sum to its target and the shards' sizes are equal but for a few units.

Documents then fill the quotas. A source is cut into blocks by a hash of its rows, about ``BLOCKS`` times the square
root of its number of documents; a pass over it lays its blocks in an order of its own on a line of words, and a
target above the source's size goes on into a second pass. The quotas of the shards are intervals of this line one after
another, so they draw disjoint runs of permuted blocks. A block in one interval goes there whole; in blocks that hold a
cut the documents' places are summed up, and the few documents that hold the cut are divided between its sides by words.
Offsets of blocks are summed in levels of ``FAN_OUT``, so no window holds more rows than that, a block's documents,
or the units and sources. Only DataFrame functions are used.

The tables of sources and units have as many rows as there are sources, and ``UNITS`` more.

Defined results: a null text has size 0 and is never taken; a null source is a source of
its own, the last one; rows that share doc_id and text are in the same block and are each taken
on their own; an empty table gives an empty result; columns other than doc_id, text and
source pass through ``draw`` whatever their names and are not read by ``mix``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, named, written

# Weights of the sources in order, repeating.
WEIGHTS = [3, 1, 2]
#: Units of the tree, blocks of a source by the root of its documents, blocks summed together.
UNITS, BLOCKS, FAN_OUT = 4096, 4, 256
#: The table of blocks (about 40 bytes each) is broadcast up to this many, else joined by a shuffle.
BROADCAST_BLOCKS = 2_000_000
TAKES = "array<struct<pass:int,shard:int,words:bigint,skip:bigint>>"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(facts: DataFrame, share: float = 1.5, cap: float = 2.0, weights=None) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, size). Targets are min(cap * size, rate *
    weight) with the one rate that makes them sum to share * all sizes."""
    weights = weights or WEIGHTS
    sources = facts.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sources.withColumn("weight", F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    everything = Window.partitionBy()
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    total, all_weights = F.sum("source_size").over(everything), F.sum("weight").over(everything)
    rated = sources.withColumn(
        "rate",
        (share * total - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / (all_weights - F.coalesce(F.sum("weight").over(before), F.lit(0))),
    ).withColumn("first_free", F.col("rate") * F.col("weight") <= cap * F.col("source_size"))
    # the first source in this order that stays under its cap sets the rate
    rate = F.max(F.when(F.col("first_free"), F.col("rate"))).over(everything)
    rated = rated.withColumn("rate", F.coalesce(rate, F.lit(float("inf"))))
    return rated.select("source", "source_size", "n_docs", F.least(F.col("rate") * F.col("weight"), cap * F.col("source_size")).alias("target"))


def quotas(targets: DataFrame, n_shards: int = 8, seed: int = 17) -> DataFrame:
    """(source, bounds): the words of each source that shard k gets end at ``bounds[k + 1]`` of the source's line
    and start at ``bounds[k]``; the last bound is the rounded target. ``n_shards`` is a power of two."""
    if n_shards < 1 or n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    whole = targets.select("source", F.round("target").cast("long").alias("words"))
    unit = F.greatest(F.lit(1), F.ceil(F.sum("words").over(Window.partitionBy()) / UNITS)).cast("long")
    units = whole.withColumn("unit", unit).where("words > 0")
    units = units.select("source", F.explode(F.sequence(F.lit(1).cast("long"), F.ceil(F.col("words") / F.col("unit")))).alias("k"), "words", "unit")
    units = units.select("source", "k", F.least("unit", F.col("words") - (F.col("k") - 1) * F.col("unit")).alias("words"), F.lit(1).cast("long").alias("node"))
    for level in range(n_shards.bit_length() - 1):
        at_node = Window.partitionBy("node")
        ranked = at_node.orderBy(F.xxhash64(F.lit(seed + 1 + level), "source", "k"), F.col("source").asc_nulls_last(), "k")
        odd = F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(2))  # which side gets the unit that is over
        left = F.floor((F.count(F.lit(1)).over(at_node) + odd) / 2)
        units = units.withColumns({"rank": F.row_number().over(ranked), "left": left}).withColumn("node", F.col("node") * 2 + F.when(F.col("rank") > F.col("left"), 1).otherwise(0)).drop("rank", "left")
    leaf = units.groupBy("source", (F.col("node") - n_shards).cast("int").alias("shard")).agg(F.sum("words").alias("quota"))
    by_shard = leaf.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("shard", "quota"))).alias("of"))
    sums = F.transform(F.sequence(F.lit(0), F.lit(n_shards)), lambda k: F.aggregate(F.map_entries("of"), F.lit(0).cast("long"), lambda s, e: s + F.when(e["key"] < k, e["value"]).otherwise(F.lit(0))))
    found = by_shard.select(F.col("source").alias("quota_source"), sums.alias("bounds"))
    none = F.array_repeat(F.lit(0).cast("long"), n_shards + 1)
    return targets.select("source").join(found, F.col("source").eqNullSafe(F.col("quota_source")), "left").select("source", F.coalesce("bounds", none).alias("bounds"))


def _sources(facts: DataFrame, n_shards: int, seed: int, share: float, cap: float) -> DataFrame:
    """(sid, mix_source, source_size, target, n_blocks, bounds), a row for each source; ``sid`` numbers them."""
    targets = written(source_targets(facts, share, cap), "mix-targets")
    q = quotas(targets, n_shards, seed).withColumnRenamed("source", "quota_source")
    joined = targets.join(q, targets["source"].eqNullSafe(q["quota_source"])).drop("quota_source")
    sid = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return written(joined.select(sid.alias("sid"), F.col("source").alias("mix_source"), "source_size", "target", F.ceil(BLOCKS * F.sqrt("n_docs")).cast("long").alias("n_blocks"), "bounds"), "mix-sources")


def _placed(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """``rows`` (doc_id, source, size, mark, ...) with their source's columns and ``block``."""
    joined = rows.join(sources, rows["source"].eqNullSafe(sources["mix_source"])).drop("mix_source")
    spread = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mark"), F.lit(1 << 31))
    return joined.withColumn("block", F.shiftright(spread * F.col("n_blocks"), 31)).drop("n_blocks")


def _block_plan(placed: DataFrame, sources: DataFrame, seed: int, cap: float) -> DataFrame:
    """(plan_sid, plan_block, starts, cut) of each block: where it starts on its source's line in each pass, and
    whether a bound lies inside it in any."""
    passes = range(1, math.ceil(cap) + 1)
    blocks = written(placed.groupBy("sid", F.col("block").alias("node")).agg(F.sum("size").alias("words")), "mix-blocks")
    most = sources.agg(F.max("n_blocks")).first()[0] or 1
    levels = [blocks]
    while FAN_OUT ** len(levels) < most:
        levels.append(written(levels[-1].groupBy("sid", F.floor(F.col("node") / FAN_OUT).alias("node")).agg(F.sum("words").alias("words")), "mix-blocks"))
    starts = sources.select(F.col("sid").alias("of"), F.lit(0).cast("long").alias("parent"), F.array(*((p - 1) * F.col("source_size") for p in passes)).alias("base"))
    for number, level in reversed(list(enumerate(levels))):
        inside = level.withColumn("up", F.floor(F.col("node") / FAN_OUT))
        before = [
            F.coalesce(F.sum("words").over(Window.partitionBy("sid", "up").orderBy(F.xxhash64(F.lit(seed), F.lit(p), F.lit(number), "sid", "node"), "node").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
            for p in passes
        ]
        inside = inside.select("sid", "node", "words", "up", F.array(*before).alias("before"))
        joined = inside.join(starts, (inside["sid"] == starts["of"]) & (inside["up"] == starts["parent"]))
        placed_level = joined.select("sid", "node", "words", F.zip_with("base", "before", lambda a, b: a + b).alias("starts"))
        starts = placed_level.select(F.col("sid").alias("of"), F.col("node").alias("parent"), F.col("starts").alias("base"))
    ends = sources.select(F.col("sid").alias("of"), "bounds")
    whole = placed_level.join(ends, placed_level["sid"] == ends["of"])
    cut = F.exists("starts", lambda a: F.exists("bounds", lambda b: (a < b) & (b < a + F.col("words"))))
    return whole.select(F.col("sid").alias("plan_sid"), F.col("node").alias("plan_block"), "starts", cut.alias("cut"))


def _takes(before: Column) -> Column:
    """What each pass and shard takes of a row that has ``before`` words of its block before it."""

    def of_pass(start: Column, p: Column) -> Column:
        a = start + before
        b = a + F.col("size")
        return F.transform(
            F.sequence(F.lit(0), F.size("bounds") - 2),
            lambda k: F.struct(
                (p + 1).cast("int").alias("pass"), k.cast("int").alias("shard"),
                F.greatest(F.lit(0).cast("long"), F.least(b, F.get("bounds", k + 1)) - F.greatest(a, F.get("bounds", k))).alias("words"),
                F.greatest(F.lit(0).cast("long"), F.get("bounds", k) - a).alias("skip"),
            ),
        )

    return F.filter(F.flatten(F.transform("starts", of_pass)), lambda t: t["words"] > 0).cast(TAKES)


def _drawn(placed: DataFrame, sources: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """``placed`` with ``takes`` (pass, shard, words, words skipped). Only rows of blocks with a cut need their
    neighbours; of the others any place in their block gives the same."""
    plan = F.broadcast(plan) if plan.count() <= BROADCAST_BLOCKS else plan
    joined = placed.join(plan, (placed["sid"] == plan["plan_sid"]) & (placed["block"] == plan["plan_block"])).drop("plan_sid", "plan_block")
    within = Window.partitionBy("sid", "block").orderBy(F.xxhash64(F.lit(seed), F.lit("doc"), "doc_id", "mark"), "doc_id", "mark").rowsBetween(Window.unboundedPreceding, -1)
    whole = joined.where("not cut").withColumn("takes", _takes(F.lit(0).cast("long")))
    partly = joined.where("cut").withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0))).withColumn("takes", _takes(F.col("before"))).drop("before")
    return whole.unionByName(partly).drop("starts", "cut")


def _planned(docs: DataFrame, n_shards: int, seed: int, share: float, cap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts of every row of ``docs``, sources, plan of blocks), all written."""
    facts = written(docs.select(*_facts(F.col("doc_id"), F.col("source"), F.col("text"))), "mix-facts")
    sources = _sources(facts, n_shards, seed, share, cap)
    return facts, sources, written(_block_plan(_placed(facts, sources, seed), sources, seed, cap), "mix-plan")


def _facts(doc_id: Column, source: Column, text: Column) -> list[Column]:
    return [doc_id.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), F.xxhash64(text).alias("mark")]


def mix(docs: DataFrame, n_shards: int = 8, seed: int = 17, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard_words) for every row of ``docs``: the words
    that the mix takes of it, in all and for each shard."""
    facts, sources, plan = _planned(docs, n_shards, seed, share, cap)
    drawn = _drawn(_placed(facts, sources, seed), sources, plan, seed)
    words = lambda takes: F.aggregate(takes, F.lit(0).cast("long"), lambda s, t: s + t["words"])
    by_shard = F.transform(F.sequence(F.lit(0), F.lit(n_shards - 1)), lambda k: words(F.filter("takes", lambda t: t["shard"] == k)))
    return drawn.select("doc_id", "size", "source_size", "target", words("takes").alias("taken"), by_shard.alias("shard_words"))


def draw(docs: DataFrame, n_shards: int = 8, seed: int = 17, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mixed corpus, shuffled locally: a row of ``docs`` for each time it is drawn, and last the column ``mix_shard`` (with
    underscores if ``docs`` has one). Of a document that a cut divides each part is a row with its own words."""
    _, sources, plan = _planned(docs, n_shards, seed, share, cap)
    body = F.struct(*named(*docs.columns)).alias("body")
    rows = docs.select(*_facts(F.col("doc_id"), F.col("source"), F.col("text")), body)
    drawn = _drawn(_placed(rows, sources, seed), sources, plan, seed).select("body", "size", "doc_id", "mark", F.explode("takes").alias("take"))
    some = lambda n: F.concat(F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), n.cast("string"), F.lit("}+"))
    text, skip, taken, ends = F.col("body")["text"], F.col("take.skip"), F.col("take.words"), F.col("take.skip") + F.col("take.words")
    head = F.when(ends < F.col("size"), F.call_function("regexp_extract", text, some(ends), F.lit(0))).otherwise(text)
    tail = F.call_function("regexp_replace", head, F.concat(some(skip), F.lit(r"[\x20\x09-\x0D]*+")), F.lit(""))
    text = F.when(taken < F.col("size"), F.when(skip > 0, tail).otherwise(head)).otherwise(text)
    made = {"text": text} | ({"n_chars": F.length(text).cast("long")} if "n_chars" in docs.columns else {})
    columns = [made.get(c, F.col("body").getField(c)).alias(c) for c in docs.columns]
    order = F.xxhash64(F.lit(seed), "take.shard", "take.pass", "doc_id", "mark")
    shard, place = fresh(docs, "mix_shard"), fresh(docs, "mix_order")
    return drawn.select(*columns, F.col("take.shard").alias(shard), order.alias(place)).sortWithinPartitions(place).select(*named(*docs.columns, shard))
