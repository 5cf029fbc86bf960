"""Connected components over an edge table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written


def _in_one_task(pdf: pd.DataFrame) -> pd.DataFrame:
    """Union-find over an edge list."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(pdf["u"].tolist(), pdf["v"].tolist(), strict=True):
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    return pd.DataFrame({"node": nodes, "root": [root(x) for x in nodes]}, dtype="int64")


def connected_components(edges: DataFrame, max_rounds: int = 60, small: int = 0) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node of its component.
    Up to ``small`` edges (counted) are joined by one task, which saves the rounds' overhead.

    Alternates the large-star and small-star steps: every node links its larger, then its
    smaller neighbours to the smallest one it knows, until each component is a star around its
    smallest node. Rounds grow with the logarithm of the size, not with a component's diameter;
    each is two aggregations and two equi-joins over the edges and is written, so lineage stays
    short. Loops and repeated edges are allowed; nulls are dropped."""
    links = written(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if small and links.count() <= small:
        return links.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_in_one_task, "node long, root long")
    before = None
    for _ in range(max_rounds):
        # large star: u's larger neighbours go to the smallest of u and its neighbours
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        links = written(small, "links")
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components didn't settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
