"""Average linkage in rounds of joins, without a table of all distances.

The mean cosine distance of two groups follows from the sums of their unit vectors: 1 - (s . t) / (n * m). Groups that are each other's nearest merge, all such
pairs of a round at once; as linkage by averages is reducible, that gives the groups of the sequential algorithm, which merges the one nearest pair again and
again. Distances are compared in parts around pivots; groups nearer than ``eps`` lie within its angle, as means are no longer than units. When few groups are left, one
task ends it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import norm, normalized
from ..plans.materialize import written
from . import regions
from .regions import Regions, angle_of, unit


def merged(ids: np.ndarray, sums: np.ndarray, sizes: np.ndarray, eps: float) -> np.ndarray:
    """The group, named by its smallest id, of each of some groups (ids ascending), merged until none are nearer than ``eps``. Of equally near ones the
    lowest pair goes first."""
    into, alive = np.arange(len(ids)), np.arange(len(ids))
    sums, sizes = sums.astype(np.float64), sizes.astype(np.float64)
    while len(alive) > 1:
        means = sums[alive] / sizes[alive, None]
        near, dist = np.zeros(len(alive), np.int64), np.zeros(len(alive))
        for k in range(0, len(alive), regions.ROWS):
            d = 1.0 - means[k : k + regions.ROWS] @ means.T
            d[np.arange(len(d)), np.arange(k, k + len(d))] = np.inf
            near[k : k + len(d)] = np.argmin(d, axis=1)
            dist[k : k + len(d)] = d.min(axis=1)
        a = np.flatnonzero((near[near] == np.arange(len(alive))) & (np.arange(len(alive)) < near) & (dist < eps))
        if not len(a):
            break
        keep, gone = alive[a], alive[near[a]]
        sums[keep] += sums[gone]
        sizes[keep] += sizes[gone]
        into[gone] = keep
        alive = np.setdiff1d(alive, gone)
    while (into != into[into]).any():
        into = into[into]
    return ids[into]


def _nearest(groups: DataFrame, n: int, eps: float) -> DataFrame:
    """(id, other, dist) of each group's nearest one within ``eps``, the lowest of equal ones."""
    placed = Regions.of(groups.select("id", F.col("sums").alias("embedding"), (norm(F.col("sums")) / F.col("n")).alias("length")), n)
    points = placed.rows.select("id", "embedding", "length")

    def best(some: pa.Table, others: pa.Table) -> pa.Table:
        others = others.sort_by("id")
        ids, there = some.column("id").to_numpy(), others.column("id").to_numpy()
        x, y = (unit(t.column("embedding")) * t.column("length").to_numpy()[:, None] for t in (some, others))
        near, dist = np.zeros(len(ids), np.int64), np.full(len(ids), np.inf)
        for k in range(0, len(ids) if len(there) else 0, regions.ROWS):
            d = 1.0 - x[k : k + regions.ROWS] @ y.T
            d[ids[k : k + len(d), None] == there[None, :]] = np.inf
            near[k : k + len(d)], dist[k : k + len(d)] = np.argmin(d, axis=1), d.min(axis=1)
        found = np.flatnonzero(dist < eps)
        return pa.table({"id": pa.array(ids[found]), "other": pa.array(there[near[found]] if len(there) else ids[found]), "dist": pa.array(dist[found])})

    met = placed.meet(points, angle_of(eps), best, "id long, other long, dist double", rows=placed.rows.select("id", "embedding", "length", "part"))
    return met.groupBy("id").agg(F.min(F.struct("dist", "other")).alias("m")).select("id", "m.other", "m.dist")


def average_linkage(vectors: DataFrame, eps: float) -> DataFrame:
    """(id, label) of ``vectors`` (id, embedding): groups are merged while the least average cosine distance of two is under ``eps``. Labels are
    numbered by the groups' smallest ids; rows with a null id or vector are dropped."""
    rows = vectors.where("id is not null and embedding is not null")
    groups = written(rows.select("id", F.lit(1).cast("long").alias("n"), normalized(F.col("embedding")).alias("sums")), "linkage")
    members = groups.select("id", F.col("id").alias("group"))
    n = groups.count()
    while n > regions.BLOCK:
        near = written(_nearest(groups, n, eps), "linkage-near")
        back = near.select(F.col("id").alias("back"), F.col("other").alias("back_other"))
        pairs = near.join(back, (near["other"] == back["back"]) & (near["id"] == back["back_other"])).where("id < other").select(F.col("id").alias("keep"), F.col("other").alias("gone"))
        pairs = written(pairs, "linkage-pairs")
        n_pairs = pairs.count()
        if not n_pairs:
            break
        gone = groups.join(pairs, groups["id"] == pairs["gone"]).select("keep", F.col("n").alias("more"), F.col("sums").alias("other_sums"))
        left = groups.join(pairs.select(F.col("gone").alias("id")), "id", "left_anti").join(gone, F.col("id") == F.col("keep"), "left")
        sums = F.when(F.col("keep").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "other_sums", lambda a, b: a + b))
        groups = written(left.select("id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), sums.alias("sums")), "linkage")
        members = written(members.join(pairs, members["group"] == pairs["gone"], "left").select("id", F.coalesce("keep", "group").alias("group")), "linkage-members")
        n -= n_pairs
    if n <= regions.BLOCK:

        def last(table: pa.Table) -> pa.Table:
            table = table.sort_by("id")
            ids = table.column("id").to_numpy()
            return pa.table({"group": ids, "root": merged(ids, np.asarray(table.column("sums").to_pylist(), dtype=np.float64), table.column("n").to_numpy(), eps)})

        ends = groups.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(last, "group long, root long")  # BLOCK rows at most
        members = members.join(ends, "group").select("id", F.col("root").alias("group"))
    from .ingest import numbered

    members = written(members, "linkage-members")
    numbers = numbered(members.select("group").distinct(), ["group"], 0).select("group", F.col("id").cast("int").alias("label"))
    return members.join(numbers, "group").select("id", "label")
