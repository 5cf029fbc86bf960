"""Vectors in parts that a pivot and two angles bound, and the meeting of points with the parts in their reach.

Each vector goes to its nearest pivot. Around a pivot rows are ordered by their angle to it, so a part is a shell between two
angles; by the triangle inequality a point at angle t from the pivot reaches rows at angles from t - reach to t + reach only. A part has about BLOCK
rows (more when MOST_PARTS of them wouldn't do), however many rows a pivot attracts, and so many points that meet it in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import FLOOR
from ..plans.materialize import written

#: Rows of a part about, pivots and parts at most (the driver and each task hold their bounds), points that meet a part in one task.
BLOCK, MOST_BLOCKS, MOST_PARTS, POINTS = 2048, 4096, 65_536, 8192
#: What angles may be wrong by: they decide only what is compared, distances are compared as they are.
SLACK = 1e-6
#: Rows of a table of angles that a task holds at a time.
ROWS = 512


def unit(rows) -> np.ndarray:
    """Rows of an Arrow list column or of a sequence as unit vectors."""
    if isinstance(rows, pa.ChunkedArray):
        rows = rows.combine_chunks()
    if isinstance(rows, pa.Array):
        n = len(rows)
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        if n and len(flat) % n == 0 and len(pc.unique(pc.list_value_length(rows))) == 1:
            m = flat.reshape(n, -1).astype(np.float64)
        else:
            m = np.asarray(rows.to_pylist(), dtype=np.float64)
    else:
        m = np.asarray(list(rows), dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR) if len(m) else m.reshape(0, 0)


def angle(dots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(dots, -1, 1))


def angle_of(eps: float) -> float:
    """The angle of a cosine distance."""
    return float(angle(np.array(1 - eps)))


@dataclass
class Regions:
    """``rows`` (id, embedding, block, angle, inner, part): a written table; the bounds of its parts as arrays."""

    rows: DataFrame
    pivots: np.ndarray
    part: np.ndarray
    block: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, vectors: DataFrame, n: int, inner: float = -1.0) -> Regions:
        """Parts of ``n`` rows ``vectors`` (id, embedding, and other columns, which stay). Rows up to ``inner`` from their pivot lie in parts of their own."""
        pivots = unit(r[0] for r in vectors.orderBy(F.xxhash64("id"), "id").select("embedding").limit(min(MOST_BLOCKS, max(1, -(-n // BLOCK)))).collect())
        others = [c for c in vectors.columns if c not in ("id", "embedding")]
        schema = vectors.select("id", "embedding", *others).schema.add("block", "integer").add("angle", "double")

        def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                m = unit(batch.column(1))
                dots = m @ pivots.T if len(m) else np.zeros((0, len(pivots)))
                at = np.argmax(dots, axis=1) if len(m) else np.zeros(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(angle(dots[np.arange(len(m)), at]))], names=schema.names)

        placed = written(vectors.select("id", "embedding", *others).mapInArrow(near, schema), "vectors").withColumn("inner", F.col("angle") <= inner)
        n_parts = -(-n // max(BLOCK, -(-n // MOST_PARTS)))
        key = (F.col("block").cast("long") * 2 + F.col("inner").cast("long")) * (1 << 32) + F.spark_partition_id()
        rows = written(placed.repartitionByRange(n_parts, "block", "inner", "angle", "id").withColumn("part", key), "parts")
        found = sorted(rows.groupBy("part").agg(F.first("block"), F.min("angle"), F.max("angle"), F.count(F.lit(1))).collect())  # MOST_PARTS + 2 * MOST_BLOCKS rows at most
        part, block, low, high, size = (np.array(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 5
        return cls(rows, pivots, part, block, low, high, size)

    def reached(self, m: np.ndarray, reach: float | None, fits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(row of ``m``, part's place) of all parts that may hold a row within ``reach`` of it (None: as near as the nearest pivot). ``fits``: rows by parts,
        those to look at."""
        to = angle(m @ self.pivots.T)
        reach = to.min(axis=1, keepdims=True, initial=np.pi) if reach is None else reach
        to = to[:, self.block]
        near = (to >= self.low - reach - SLACK) & (to <= self.high + reach + SLACK)
        return np.nonzero(near if fits is None else near & fits)

    def meet(
        self, points: DataFrame, reach: float | None, body: Callable[[pa.Table, pa.Table], pa.Table], schema: str, fits: Callable[[pa.RecordBatch], np.ndarray] | None = None, rows: DataFrame | None = None
    ) -> DataFrame:
        """``body(points, rows)`` of all points (id, embedding, other columns) with the rows of each part in their reach, so many at a time. ``rows``: instead of
        all rows some of them, with part and other columns. ``fits``: for a batch of points a table, points by parts, of the parts they ask for."""
        rows = self.rows if rows is None else rows
        names, spark, part = points.columns, points.sparkSession, self.part
        bounds = Regions(None, self.pivots, part, self.block, self.low, self.high, self.size)  # what tasks need

        def slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
            for start in range(0, batch.num_rows, ROWS):
                some = batch.slice(start, ROWS)
                yield some, *bounds.reached(unit(some.column(names.index("embedding"))), reach, None if fits is None else fits(some))

        def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            met = np.zeros(len(part), dtype=np.int64)
            for batch in batches:
                for _, _, at in slices(batch):
                    met += np.bincount(at, minlength=len(part))
            seen = np.flatnonzero(met)
            yield pa.RecordBatch.from_arrays([pa.array(part[seen]), pa.array(met[seen])], names=["part", "n"])

        met = points.mapInArrow(count, "part long, n long").groupBy("part").agg(F.ceil(F.sum("n") / POINTS).cast("int").alias("tasks"))
        tasks = {r["part"]: r["tasks"] for r in met.collect()}  # a row a part at most
        n_tasks = np.array([tasks.get(p, 1) for p in part.tolist()], dtype=np.int64)

        def send(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for some, row, at in slices(batch):
                    ids = some.column(names.index("id")).to_numpy()[row]
                    turn = (ids * 0x9E3779B1 >> 7) % n_tasks[at]
                    yield pa.RecordBatch.from_arrays([pa.array(part[at]), pa.array(turn.astype(np.int32)), *some.take(pa.array(row)).columns], names=["to", "turn", *names])

        sent = points.mapInArrow(send, "`to` long, turn int, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema))
        asked = spark.createDataFrame(list(tasks.items()), "part long, tasks int")
        held = rows.join(F.broadcast(asked), "part").withColumns({"to": F.col("part"), "turn": F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))}).drop("tasks")
        return sent.groupBy("to", "turn").cogroup(held.groupBy("to", "turn")).applyInArrow(body, schema)


def close(x: np.ndarray, y: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, table of distances <= eps) of rows of ``x`` with all of ``y``, so many rows at a time."""
    for start in range(0, len(x), ROWS):
        yield start, 1.0 - x[start : start + ROWS] @ y.T <= eps
