"""Sharding by hierarchical vector bin packing.

Groups of equal texts are the units. A unit is a vector of bytes, tokens and rows and goes
to the bin where the dot product with the bin's residual capacity is highest. Units are
packed in blocks of bounded size (a task each); the bins of many blocks are then packed in
the same way, level by level, until one set of shards is left, so no task ever holds more
than ``units_per_block`` units or ``fan_in`` blocks' bins. Only a group that would be more than half
of a shard is dealt to salted sub-units first; all others stay whole. Rows of large units are numbered in runs, so no task holds all rows of one.

Defined results: a null text counts as empty (size 1, crc 0); a null doc_id is a row like
any other; equal rows get slots of their own; an empty table gives an empty result; columns
other than doc_id and text are not read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, named, other_names, written

#: How much more the byte dimension counts than tokens and rows: the law is on bytes.
BYTE_WEIGHT = 4.0
#: Rows of a unit that are numbered together, and runs of large units at most about.
RUN, MOST_RUNS = 100_000, 4096


def place(vectors: list[tuple[float, ...]], n_bins: int) -> list[int]:
    """The bin of each vector: largest vectors first, each where the dot product with the
    residual capacity is highest (ties: the lowest bin)."""
    dims = range(len(vectors[0])) if vectors else range(0)
    capacity = [sum(v[k] for v in vectors) / n_bins or 1.0 for k in dims]
    weight = [BYTE_WEIGHT] + [1.0] * (len(capacity) - 1)
    scaled = [tuple(weight[k] * v[k] / capacity[k] for k in dims) for v in vectors]
    order = sorted(range(len(vectors)), key=lambda i: (-max(scaled[i]), i))
    residual = [list(weight) for _ in range(n_bins)]
    bins = [0] * len(vectors)
    for i in order:
        v = scaled[i]
        best = max(range(n_bins), key=lambda b: sum(x * r for x, r in zip(v, residual[b], strict=True)))
        bins[i] = best
        for k in dims:
            residual[best][k] -= v[k]
    return bins


def _packer(n_bins: int, keys: list[str]):
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(keys, kind="stable").reset_index(drop=True)
        pdf["bin"] = pd.array(place(list(zip(pdf.n_bytes, pdf.n_tokens, pdf.n_rows, strict=True)), n_bins), dtype="int32")
        pdf["start"] = pdf.groupby("bin")["n_rows"].cumsum() - pdf["n_rows"]
        return pdf

    return pack


def assign_shards(docs: DataFrame, n_shards: int = 8, units_per_block: int = 20_000, fan_in: int = 1_000, hot_split: int = 32) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot, digest) for every row of ``docs``; ``digest`` is the MD5 of the text.

    A group of equal texts with more than half a shard's share of all bytes, tokens
    or rows is salted by doc_id (rows without one by their place in the table) to n_shards * hot_split units; there are at most 6 * n_shards such groups,
    which bounds the broadcast."""
    text = F.coalesce("text", F.lit(""))
    facts = written(
        docs.select(
            "doc_id",
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
            F.crc32(text).alias("text_crc32"),
            F.unhex(F.md5(text)).alias("digest"),
            F.monotonically_increasing_id().alias("row"),  # written with the facts, so it stays the same
        ),
        "shard-facts",
    )
    sums = [F.sum("size").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.count(F.lit(1)).alias("n_rows")]
    total = facts.agg(*sums).first()
    parts = n_shards * hot_split
    hot = (
        facts.groupBy("digest")
        .agg(*sums)
        .where(" or ".join(f"{k} * {2 * n_shards} > {total[k] or 0}" for k in ("n_bytes", "n_tokens", "n_rows")))
        .select("digest", F.lit(parts).alias("salts"))
    )
    salted = facts.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(F.coalesce("doc_id", -1 - F.col("row"))), "salts"), F.lit(0)).cast("int")).drop("salts")
    n_blocks = max(1, math.ceil((total["n_rows"] or 0) / units_per_block))
    units = salted.groupBy("digest", "salt").agg(*sums).withColumn("node", F.pmod(F.xxhash64("digest", "salt"), F.lit(n_blocks)))
    schema = "digest binary, salt int, n_bytes long, n_tokens long, n_rows long, node long, bin int, start long"
    placed = written(units.groupBy("node").applyInPandas(_packer(n_shards, ["digest", "salt"]), schema), "shard-units")

    # bins of blocks -> bins of larger blocks -> ... -> shards; (node, bin) of the lowest level keeps its place
    place_of = placed.groupBy("node", "bin").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_rows").alias("n_rows"))
    if n_blocks > 1:
        level, mapping, nodes = place_of, None, n_blocks
        while nodes > 1:
            level = level.withColumnsRenamed({"node": "child", "bin": "child_bin"}).withColumn("node", F.floor(F.col("child") / fan_in))
            up = "child long, child_bin int, n_bytes long, n_tokens long, n_rows long, node long, bin int, start long"
            up = written(level.groupBy("node").applyInPandas(_packer(n_shards, ["child", "child_bin"]), up), "shard-level")
            step = up.select("child", "child_bin", "node", "bin", F.col("start").alias("offset"))
            if mapping is None:
                mapping = step.withColumnsRenamed({"child": "leaf", "child_bin": "leaf_bin"})
            else:
                lower = mapping.withColumnsRenamed({"node": "child", "bin": "child_bin", "offset": "lower_offset"})
                mapping = lower.join(step, ["child", "child_bin"]).select("leaf", "leaf_bin", "node", "bin", (F.col("offset") + F.col("lower_offset")).alias("offset"))
            level = up.groupBy("node", "bin").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_rows").alias("n_rows"))
            nodes = math.ceil(nodes / fan_in)
        homes = (
            placed.join(mapping, (placed.node == mapping.leaf) & (placed.bin == mapping.leaf_bin))
            .select("digest", "salt", mapping.bin.alias("shard"), (F.col("start") + F.col("offset")).alias("start"))
        )
    else:
        homes = placed.select("digest", "salt", F.col("bin").alias("shard"), "start")
    # a unit's rows in runs of a bounded number, by a hash; one run for nearly all units
    run_rows = max(RUN, (total["n_rows"] or 0) // MOST_RUNS)
    large = placed.where(F.col("n_rows") > run_rows).select("digest", "salt", F.ceil(F.col("n_rows") / run_rows).alias("runs"))  # MOST_RUNS rows at most
    in_run = salted.join(F.broadcast(large), ["digest", "salt"], "left").withColumn("run", F.coalesce(F.pmod(F.xxhash64(F.lit("run"), F.coalesce("doc_id", -1 - F.col("row"))), "runs"), F.lit(0)).cast("int")).drop("runs")
    sizes = in_run.join(F.broadcast(large.select("digest", "salt")), ["digest", "salt"], "left_semi").groupBy("digest", "salt", "run").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("digest", "salt").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # a row a run
    offsets = sizes.select("digest", "salt", "run", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    started = in_run.join(homes, ["digest", "salt"]).join(F.broadcast(offsets), ["digest", "salt", "run"], "left")
    within = Window.partitionBy("digest", "salt", "run").orderBy("doc_id", "row")
    slot = F.col("start") + F.coalesce("before", F.lit(0)) + F.row_number().over(within) - 1
    return started.select("doc_id", "size", "text_crc32", "shard", slot.alias("slot"), "digest")


def copies_numbered(rows: DataFrame, name: str, doc_id: str, mark: str) -> DataFrame:
    """``rows``, a written table, with a column ``name``: 1, 2, ... among the rows of one doc_id and mark. They are numbered within the partitions that it is read in, and
    a partition's numbers start after those before it, so no task gets all rows of a key."""
    part, of_id, of_mark, of_part, start = (fresh(rows, n) for n in ("copy_part", "copy_id", "copy_mark", "copy_of", "copy_start"))
    placed = rows.withColumn(part, F.spark_partition_id())
    counts = placed.groupBy(F.col(f"`{doc_id}`").alias(of_id), F.col(f"`{mark}`").alias(of_mark), F.col(part).alias(of_part)).agg(F.count(F.lit(1)).alias("n"))
    several = counts.join(counts.groupBy(of_id, of_mark).agg(F.count(F.lit(1)).alias("parts")).where("parts > 1").select(F.col(of_id).alias("x"), F.col(of_mark).alias("y")), F.col(of_id).eqNullSafe(F.col("x")) & (F.col(of_mark) == F.col("y")), "left_semi")
    before = Window.partitionBy(of_id, of_mark).orderBy(of_part).rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = several.select(of_id, of_mark, of_part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    within = F.row_number().over(Window.partitionBy(doc_id, mark, part).orderBy(F.lit(0)))
    same = F.col(f"`{doc_id}`").eqNullSafe(F.col(of_id)) & (F.col(f"`{mark}`") == F.col(of_mark)) & (F.col(part) == F.col(of_part))
    return placed.withColumn(name, within).join(starts, same, "left").withColumn(name, F.col(name) + F.coalesce(F.col(start), F.lit(0))).drop(part, of_id, of_mark, of_part, start)


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, **options) -> None:
    """Write every row of ``docs`` as Parquet folders shard=0 .. n_shards-1 by ``assign_shards``; a column ``shard`` of ``docs`` (in
    any case) is left out, as the folders' name takes its place. Rows of one doc_id and text, null or not, are
    alike to the plan and share its places in any order."""
    mark, copy, shard, plan_id, plan_mark, plan_copy = (fresh(docs, n) for n in ("shard_mark", "shard_copy", "shard_of", "plan_id", "plan_mark", "plan_copy"))
    plan = written(assign_shards(docs, n_shards, **options).select("doc_id", "digest", "shard"), "shard-plan")
    plan = plan.select(F.col("doc_id").alias(plan_id), F.col("digest").alias(plan_mark), F.col("shard").alias(shard))
    plan = copies_numbered(plan, plan_copy, plan_id, plan_mark)
    rows = docs.select(*named(*other_names(docs, "shard"))).withColumn(mark, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    rows = copies_numbered(written(rows, "shard-rows"), copy, "doc_id", mark)
    joined = rows.join(plan, F.col("doc_id").eqNullSafe(F.col(plan_id)) & (F.col(mark) == F.col(plan_mark)) & (F.col(copy) == F.col(plan_copy)))
    kept = joined.select(*named(*other_names(docs, "shard")), F.col(shard).alias("shard"), F.pmod(F.xxhash64(mark, copy), F.lit(64)).alias(copy))
    kept.repartition("shard", copy).drop(copy).write.partitionBy("shard").parquet(path)
