"""Density clusters of vectors without the table of all neighbours.

Rows within half the radius' angle of a pivot are all neighbours of each other: such a cell, if it has enough rows, is core
as a whole, by a count, and one node of the graph of clusters. Other rows count their neighbours in their own part first, where a row of a cluster mostly
finds enough; only rows that don't are compared with all parts in their reach, and give a count and, if it stays small, the neighbours. Core rows of a part
are joined there to trees. Trees are joined by their touch of cells' centres, then by a few rows of each that look at all parts, then, branch by bound, rows of the
smaller of two clusters look only at parts that hold rows of a larger one; what is in one cluster already is never compared again. What is written grows with the rows,
not with their pairs."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import written
from . import regions
from .graph import connected_components
from .regions import SLACK, Regions, angle_of, close, unit

#: Rows of a tree that look at all parts, and edges that one task joins.
WITNESSES, ONE_TASK = 8, 1_000_000


def joined(m: np.ndarray, eps: float) -> np.ndarray:
    """For each row the smallest row that it's joined to by steps of neighbours. A row that is reached isn't compared again, so rows near each other cost little."""
    root, left = np.full(len(m), -1), np.arange(len(m))
    while len(left):
        first, front = left[0], left[:1]
        root[first], left = first, left[1:]
        while len(front) and len(left):
            some, front = front[: regions.ROWS], front[regions.ROWS :]
            near = (1.0 - m[some] @ m[left].T <= eps).any(axis=0)
            root[left[near]] = first
            front, left = np.concatenate((front, left[near])), left[~near]
    return root


def labels_here(ids: np.ndarray, m: np.ndarray, eps: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, is_core) of rows that are few enough for a table of all distances."""
    order = np.argsort(ids, kind="stable")
    near = np.zeros((len(m), len(m)), dtype=bool)
    for start, some in close(m[order], m[order], eps):
        near[start : start + len(some)] = some
    np.fill_diagonal(near, True)  # a row is its own neighbour, whatever rounding makes of its distance
    core = near.sum(axis=1) >= least
    at = np.flatnonzero(core)
    roots = joined(m[order][at], eps)
    number = np.full(len(m), len(m))
    number[at] = np.unique(roots, return_inverse=True)[1] if len(at) else []
    border = np.where(near & core[None, :], number[None, :], len(m)).min(axis=1, initial=len(m))
    found = np.where(core, number, np.where(border < len(m), border, -1))
    label, is_core = np.empty(len(m), np.int32), np.empty(len(m), bool)
    label[order], is_core[order] = found, core
    return label, is_core


def _ids(table: pa.Table, column: str = "id") -> np.ndarray:
    return table.column(column).to_numpy()


def _distinct(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Distinct edges between unlike nodes."""
    e = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)))[:, a != b], axis=1) if len(a) else np.zeros((2, 0), np.int64)
    return pa.table({"a": pa.array(e[0], pa.int64()), "b": pa.array(e[1], pa.int64())})


class _Cells:
    """Pivots whose inner rows are enough to be core; arrays by cell, and the cell of each block (-1: none)."""

    def __init__(self, placed: Regions, eps: float, least: int):
        inner = placed.rows.where("inner").groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r"), F.min("id").alias("least")).where(F.col("n") >= least)
        found = sorted(inner.collect())  # a row a pivot at most
        self.block, self.n, self.r, self.least = (np.array([row[k] for row in found], dtype=kind) for k, kind in enumerate((np.int64, np.int64, np.float64, np.int64)))
        self.centre = placed.pivots[self.block] if len(found) else np.zeros((0, placed.pivots.shape[1]))
        self.eps = eps

    def counted(self, m: np.ndarray) -> np.ndarray:
        """How many neighbours in cells each row has at least: all of a cell that lies within the radius, else its centre."""
        if not len(self.n):
            return np.zeros(len(m), np.int64)
        dots = m @ self.centre.T
        whole = np.arccos(np.clip(dots, -1, 1)) + self.r + SLACK <= angle_of(self.eps)
        return np.where(whole, self.n, 1.0 - dots <= self.eps).sum(axis=1)

    def touched(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) where a cell's centre is a neighbour."""
        return np.nonzero(1.0 - m @ self.centre.T <= self.eps) if len(self.n) else (np.zeros(0, np.int64),) * 2

    def rows(self, df: DataFrame) -> DataFrame:
        """``df`` (block, inner) with ``cell``: its number, the cell's smallest row, or null."""
        spark = df.sparkSession
        table = spark.createDataFrame([(int(b), int(c)) for b, c in zip(self.block, self.least, strict=True)], "block int, cell_of long")
        return df.join(F.broadcast(table), "block", "left").withColumn("cell", F.when(F.col("inner"), F.col("cell_of"))).drop("cell_of")


def dbscan(vectors: DataFrame, eps: float, min_samples: int) -> DataFrame:
    """(id, label, is_core) of ``vectors`` (id, embedding): the labels of a sequential DBSCAN over rows in id order. Neighbours are
    rows within cosine distance ``eps``, a row itself among them; clusters are numbered by their smallest core row, a border row takes the smallest label among its core neighbours, noise has -1. Rows with
    a null id or vector are dropped; an id occurs once."""
    vectors = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    n = vectors.count()
    least = max(1, min_samples)
    if n <= regions.BLOCK:
        schema = "id long, label int, is_core boolean"

        def whole(table: pa.Table) -> pa.Table:
            label, core = labels_here(_ids(table), unit(table.column("embedding")), eps, least)
            return pa.table({"id": table.column("id"), "label": label, "is_core": core})

        return vectors.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(whole, schema)  # BLOCK rows at most
    reach = angle_of(eps)
    placed = Regions.of(vectors, n, inner=reach / 2 - SLACK)
    cells = _Cells(placed, eps, least)
    rows = written(cells.rows(placed.rows), "celled")

    # neighbours of single rows in their part and, by count, in cells
    def local(table: pa.Table) -> pa.Table:
        m = unit(table.column("embedding"))
        n = np.concatenate([near.sum(axis=1) for _, near in close(m, m, eps)]) + cells.counted(m)
        return pa.table({"id": table.column("id"), "embedding": table.column("embedding"), "part": table.column("part"), "sure": n >= least})

    singles = written(rows.where("cell is null").select("id", "embedding", "part").groupBy("part").applyInArrow(local, "id long, embedding array<float>, part long, sure boolean"), "singles")

    def neighbours(points: pa.Table, others: pa.Table) -> pa.Table:
        ids, there = _ids(points), _ids(others)
        x, y = unit(points.column("embedding")), unit(others.column("embedding"))
        n, near_by = np.zeros(len(ids), np.int64), []
        for start, near in close(x, y, eps) if len(x) and len(y) else ():
            near &= ids[start : start + len(near), None] != there[None, :]
            n[start : start + len(near)] = near.sum(axis=1)
            near_by += [there[row] if 0 < k < least else [] for row, k in zip(near, n[start : start + len(near)].tolist(), strict=True)]
        found = np.flatnonzero(n)
        return pa.table({"id": pa.array(ids[found], pa.int64()), "n": pa.array(n[found], pa.int64()), "others": pa.array([near_by[i] for i in found.tolist()], pa.list_(pa.int64()))})

    unsure = singles.where("not sure").select("id", "embedding")
    met = written(placed.meet(unsure, reach, neighbours, "id long, n long, others array<bigint>"), "met")
    counted = unsure.select("id").join(met.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").select("id", (F.coalesce("n", F.lit(0)) + 1 >= least).alias("core"))
    decided = written(counted, "decided")
    border = met.join(decided.where("not core").select("id"), "id", "left_semi").select("id", F.explode("others").alias("other"))

    # trees: the core rows of a part that are joined there, or a cell
    def forest(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        ids, root = _ids(table), joined(unit(table.column("embedding")), eps)
        place = np.argsort(root, kind="stable")
        turn = np.empty(len(root), np.int64)
        turn[place] = np.arange(len(root)) - np.searchsorted(root[place], root[place])
        return table.append_column("tree", pa.array(ids[root])).append_column("witness", pa.array(turn < WITNESSES)).append_column("single", pa.array(np.ones(len(ids), bool)))

    core_singles = singles.join(decided.withColumnRenamed("core", "later"), "id", "left").where("sure or later").select("id", "embedding", "part")
    tree_schema = "id long, embedding array<float>, part long, tree long, witness boolean, single boolean"
    cores = written(core_singles.groupBy("part").applyInArrow(forest, tree_schema).unionByName(rows.where("cell is not null").select("id", "embedding", "part", F.col("cell").alias("tree"), F.lit(False).alias("witness"), F.lit(False).alias("single"))), "cores")

    def touching(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, cell = cells.touched(unit(batch.column(0)))
            yield from _distinct(batch.column(1).to_numpy()[row], cells.least[cell]).to_batches()

    def linked(points: pa.Table, others: pa.Table) -> pa.Table:
        """Edges between clusters of points and rows that are neighbours, each once."""
        x, y, a, b = unit(points.column("embedding")), unit(others.column("embedding")), _ids(points, "tree"), _ids(others, "tree")
        names, at = np.unique(b, return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(names)))
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for start, near in close(x, y[order], eps) if len(x) and len(y) else ():
            row, tree = np.nonzero(np.logical_or.reduceat(near, starts, axis=1))
            found.append((a[start + row], names[tree]))
        return _distinct(*map(np.concatenate, zip(*found, strict=True)))

    edge = "a long, b long"
    edges = cores.where("single").select("embedding", "tree").mapInArrow(touching, edge)
    between = joined(cells.centre, eps)
    edges = edges.unionByName(vectors.sparkSession.createDataFrame([(int(cells.least[r]), int(c)) for r, c in zip(between, cells.least, strict=True)], edge))
    seen = placed.meet(cores.where("witness").select("id", "embedding", "tree"), reach, linked, edge, rows=cores.select("id", "embedding", "part", "tree"))
    first = connected_components(written(edges.unionByName(seen), "edges"), small=ONE_TASK)

    # clusters so far; rows of the smaller of two look at parts that hold rows of a larger one
    named = cores.select("id", "embedding", "part", "tree").join(first.withColumnRenamed("node", "tree"), "tree", "left").select("id", "embedding", "part", F.coalesce("root", "tree").alias("tree"))
    clusters = named.groupBy("tree").agg(F.count(F.lit(1)).alias("size"))
    sized = written(named.join(clusters, "tree").select("id", "embedding", "part", "tree", "size"), "clusters")
    largest = {r["part"]: (r["m"]["size"], r["m"]["tree"]) for r in sized.groupBy("part").agg(F.max(F.struct("size", "tree")).alias("m")).collect()}  # a row a part
    top_size, top_tree = (np.array([largest.get(p, (-1, -1))[k] for p in placed.part.tolist()], dtype=np.int64) for k in (0, 1))

    def smaller(batch: pa.RecordBatch) -> np.ndarray:
        tree, size = batch.column(2).to_numpy()[:, None], batch.column(3).to_numpy()[:, None]
        return (top_size[None, :] > size) | ((top_size[None, :] == size) & (top_tree[None, :] > tree))

    last = placed.meet(sized.select("id", "embedding", "tree", "size"), reach, linked, edge, fits=smaller, rows=sized.select("id", "embedding", "part", "tree"))
    final = connected_components(written(last, "last-edges"), small=ONE_TASK)
    rooted = written(sized.select("id", "tree").join(final.withColumnRenamed("node", "tree"), "tree", "left").select("id", F.coalesce("root", "tree").alias("root")), "rooted")
    return numbered_labels(vectors.select("id"), rooted, border)


def density_labels(nodes: DataFrame, links: DataFrame, min_samples: int) -> DataFrame:
    """(id, label, is_core) of ``nodes`` (id, weight, least): a node stands for ``weight`` equal rows, ``least`` is the smallest of them. ``links`` (a, b) are
    all pairs of neighbouring nodes, a < b. A node counts itself and its neighbours by weight."""
    links = written(links.select("a", "b"), "links")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    around = both.join(nodes.select(F.col("id").alias("b"), "weight"), "b").groupBy("a").agg(F.sum("weight").alias("n"))
    cores = written(nodes.join(around, nodes["id"] == around["a"], "left").where(F.col("weight") + F.coalesce("n", F.lit(0)) >= min_samples).select("id", "least"), "cores")
    core = cores.select("id")
    roots = connected_components(links.join(core.toDF("a"), "a", "left_semi").join(core.toDF("b"), "b", "left_semi"), small=ONE_TASK)
    named = cores.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "least", F.coalesce("root", "id").alias("tree"))
    rooted = written(named.join(named.groupBy("tree").agg(F.min("least").alias("root")), "tree").select("id", "root"), "rooted")
    border = both.join(core.toDF("a"), "a", "left_anti").select(F.col("a").alias("id"), F.col("b").alias("other"))
    return numbered_labels(nodes.select("id"), rooted, border)


def numbered_labels(ids: DataFrame, rooted: DataFrame, border: DataFrame) -> DataFrame:
    """(id, label, is_core) from the core rows' clusters (id, root) and neighbours (id, other) of rows that aren't core. Clusters are numbered by their roots."""
    from .ingest import numbered

    numbers = numbered(rooted.select("root").distinct(), ["root"], 0).select("root", F.col("id").alias("label"))
    core_labels = written(rooted.join(numbers, "root").select("id", "label"), "core-labels")
    edge_labels = border.join(core_labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("border"))
    labelled = ids.select("id").join(core_labels, "id", "left").join(edge_labels, "id", "left")
    return labelled.select("id", F.coalesce("label", "border", F.lit(-1)).cast("int").alias("label"), F.col("label").isNotNull().alias("is_core"))
