"""Neighbour joins: vectors within a radius, hashes within a Hamming distance, nearest centroid."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashes import hamming
from ..plans.materialize import written
from . import regions
from .regions import unit

#: Centroids that all tasks hold.
CENTROIDS = 4096
#: Bands of bits whose values are probed within this many bits at most.
LEAST_BANDS, PROBED = 4, 2


def radius_join(vectors: DataFrame, eps: float) -> DataFrame:
    """All pairs (a, b, dist), a < b, of rows of ``vectors`` (id, embedding) with cosine distance <= eps.

    Exact. Rows lie in parts that a pivot and two angles bound; each row meets the parts in its reach that come after its own, and its
    own one, so a pair is compared once. Rows of null vectors are dropped."""
    vectors = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    n = vectors.count()
    schema = "a long, b long, dist double"

    def pairs(points: pa.Table, others: pa.Table) -> pa.Table:
        a, b = (t.column("id").to_numpy() for t in (points, others))
        x, y = unit(points.column("embedding")), unit(others.column("embedding"))
        own = points.column("part").to_numpy()[:, None] == others.column("part").to_numpy()[:1]
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for k in range(0, len(a) if len(b) else 0, regions.ROWS):
            dist = 1.0 - x[k : k + regions.ROWS] @ y.T
            r, c = np.nonzero((dist <= eps) & (~own[k : k + regions.ROWS] | (a[k : k + regions.ROWS, None] < b[None, :])))
            out.append((np.minimum(a[k + r], b[c]), np.maximum(a[k + r], b[c]), dist[r, c]))
        return pa.table(dict(zip(("a", "b", "dist"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    if n <= regions.BLOCK:
        return vectors.withColumn("part", F.lit(0)).groupBy("part").applyInArrow(lambda t: pairs(t, t), schema)  # BLOCK rows at most
    placed = regions.Regions.of(vectors, n)
    part = placed.part
    later = lambda batch: part[None, :] >= batch.column(2).to_numpy()[:, None]
    points = placed.rows.select("id", "embedding", "part")
    return placed.meet(points, regions.angle_of(eps), pairs, schema, fits=later, rows=points)


def nearest_centroid(vectors: DataFrame, centroids: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(id, key, dist) for each row of ``vectors`` (id, embedding): the centroid (key, centroid) of the least
    cosine distance, the lowest key of equal ones; no row if there are no centroids. An id occurs once.

    Up to CENTROIDS of them go to all tasks. More are an index: parts around pivots, which are centroids themselves, so the nearest pivot bounds the
    distance, and a vector is sent only to the parts that may hold a nearer one, in one pass whatever their number. Equal centroids are one, of the lowest key."""
    once = written(centroids.where(F.col(key).isNotNull() & F.col("centroid").isNotNull()).groupBy(F.col("centroid").alias("embedding")).agg(F.min(key).alias("id")).select("id", "embedding"), "centroids")
    n = once.count()
    some = vectors.where("id is not null and embedding is not null").select("id", "embedding")
    schema = f"id long, {key} long, dist double"

    def nearest(ids: pa.Array, m: np.ndarray, keys: np.ndarray, matrix: np.ndarray) -> pa.Table:
        at, dist = np.zeros(len(m), np.int64), np.zeros(len(m))
        for k in range(0, len(m), regions.ROWS):
            dots = m[k : k + regions.ROWS] @ matrix.T
            at[k : k + len(dots)] = np.argmax(dots, axis=1)
            dist[k : k + len(dots)] = 1.0 - dots[np.arange(len(dots)), at[k : k + len(dots)]]
        return pa.table([ids, pa.array(keys[at]), pa.array(dist)], names=["id", key, "dist"])

    if n <= CENTROIDS:
        if not n:
            return vectors.select("id", F.lit(None).cast("long").alias(key), F.lit(None).cast("double").alias("dist")).where(F.lit(False))
        rows = sorted(once.collect())  # CENTROIDS rows at most
        keys, matrix = np.array([r[0] for r in rows], dtype=np.int64), np.asarray([r[1] for r in rows], dtype=np.float64)

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield from nearest(batch.column(0), unit(batch.column(1)), keys, matrix).to_batches()

        return some.mapInArrow(best, schema)
    index = regions.Regions.of(once, n)

    def best_of_part(points: pa.Table, others: pa.Table) -> pa.Table:
        if not len(others):
            return pa.table([points.column("id").slice(0, 0), pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", key, "dist"])
        others = others.sort_by("id")
        return nearest(points.column("id"), unit(points.column("embedding")), others.column("id").to_numpy(), np.asarray(others.column("embedding").to_pylist(), dtype=np.float64))

    found = index.meet(some, None, best_of_part, schema)
    return found.groupBy("id").agg(F.min(F.struct("dist", key)).alias("m")).select("id", f"m.{key}", "m.dist")


def _masks(width: int, radius: int) -> list[int]:
    """All values of ``width`` bits with at most ``radius`` bits set."""
    return [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(width), r)]


def _bands(most: int) -> tuple[list[int], list[int], int]:
    """(where bands of bits begin, their widths, how far a value in one may be off): of m bands one differs in at most most // m bits."""
    if most >= 64:  # any two
        bands, radius = 1, 64
    else:
        bands = most + 1 if most < LEAST_BANDS else max(LEAST_BANDS, -(-(most + 1) // (PROBED + 1)))
        radius = most // bands
    cuts = [64 * k // bands for k in range(bands + 1)]
    return cuts, [b - a for a, b in zip(cuts, cuts[1:], strict=False)], radius


def _part(h, cut: int, width: int):
    return F.shiftrightunsigned(h, cut).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))


def _entry(k: int, bits):
    return F.struct(F.lit(k).alias("band"), bits.alias("bits"))


def band_entries(hashes: DataFrame, most: int) -> DataFrame:
    """(hash, band, bits): each hash under the values of its bands; one key where the threshold tells nothing."""
    cuts, widths, radius = _bands(most)
    keys = [_entry(0, F.lit(0).cast("long"))] if radius > PROBED else [_entry(k, _part(F.col("hash"), cuts[k], w)) for k, w in enumerate(widths)]
    return hashes.select("hash", F.inline(F.array(*keys)))


def band_probes(hashes: DataFrame, most: int) -> DataFrame:
    """(other, band, bits): each hash as ``other`` under all values that an entry of a hash near it may have in a band."""
    cuts, widths, radius = _bands(most)
    if radius > PROBED:
        return hashes.select(F.col("hash").alias("other"), F.inline(F.array(_entry(0, F.lit(0).cast("long")))))

    def probes(k: int):
        near_by = F.array(*(F.lit(m).cast("long") for m in _masks(widths[k], radius)))
        return F.transform(near_by, lambda m: _entry(k, _part(F.col("hash"), cuts[k], widths[k]).bitwiseXOR(m)))

    return hashes.select(F.col("hash").alias("other"), F.inline(F.concat(*map(probes, range(len(widths))))))


def near_hashes(distinct: DataFrame, most: int) -> DataFrame:
    """All pairs (h1, h2, bits), h1 < h2, of ``distinct`` (hash long) that differ in at most ``most`` bits.

    Exact: of m bands of bits one differs in at most most // m, 2 at most (4 bands of 16 bits up to 11 bits). In a band each hash meets those with its own
    value and, as one side, those one bit off; for two bits both sides change one, the left side the lower, so a hash has 50 rows a band and not the
    137 of all values within two bits. A pair is made in the first band that shows it only, so nothing is made twice. Both sides are many times
    larger than the planner can tell from the table of hashes, so they are merged, never broadcast."""
    cuts, widths, radius = _bands(most)
    bits = hamming(F.col("x.hash"), F.col("y.other"))
    n_tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hashes = distinct.select("hash").repartition(n_tasks, "hash")  # a small file would be one task for all rows that come of it
    if radius > PROBED:
        x, y, first = band_entries(hashes, most), band_probes(hashes, most), F.lit(True)
        x, y = (df.withColumn("flip", F.lit(place)) for df, place in ((x, 0), (y, 1)))
    else:

        def rows(name: str, near_by: bool) -> DataFrame:
            """(name, band, bits, flip): under an even number a band's value, with ``near_by`` those one bit off; under an odd one the values with bit ``flip`` changed."""

            def of(k: int):
                value = _part(F.col("hash"), cuts[k], widths[k])
                row = lambda band, mask, flip: F.struct(F.lit(band).alias("band"), value.bitwiseXOR(mask).alias("bits"), flip.alias("flip"))
                flipped = lambda band, flip: F.transform(F.sequence(F.lit(0), F.lit(widths[k] - 1)), lambda b: row(band, F.call_function("shiftleft", F.lit(1).cast("long"), b), flip(b)))
                own = F.array(row(2 * k, F.lit(0).cast("long"), F.lit(int(near_by))))
                return [own] + [flipped(2 * k, lambda _: F.lit(1))] * (near_by and radius > 0) + [flipped(2 * k + 1, lambda b: b)] * (radius > 1)

            return hashes.select("hash", F.inline(F.concat(*(part for k in range(len(widths)) for part in of(k))))).withColumnRenamed("hash", name)

        x, y = rows("hash", False), rows("other", True)
        shown = lambda k: F.bit_count(_part(F.col("x.hash").bitwiseXOR(F.col("y.other")), cuts[k], widths[k])) <= radius
        first = reduce(lambda a, b: a & b, (((F.col("x.band") < 2 * k + 2) | ~shown(k)) for k in range(len(widths) - 1)), F.lit(True))
    x, y = x.hint("merge").alias("x"), y.alias("y")
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.bits") == F.col("y.bits")) & (F.col("x.flip") < F.col("y.flip")) & (F.col("x.hash") < F.col("y.other"))
    return x.join(y, met & (bits <= most) & first).select(F.col("x.hash").alias("h1"), F.col("y.other").alias("h2"), bits.alias("bits"))


def hamming_join(hashes: DataFrame, most: int) -> DataFrame:
    """All pairs (a, b, bits), a < b, of rows of ``hashes`` (id, hash long) that differ in at most ``most`` bits. Pairs of equal hashes are made only here;
    groups of near hashes (``duplicates``) need none."""
    hashes = written(hashes.where("id is not null and hash is not null").select("id", "hash"), "hashes")
    distinct = written(hashes.select("hash").distinct(), "distinct-hashes")
    near = near_hashes(distinct, most).unionByName(distinct.select(F.col("hash").alias("h1"), F.col("hash").alias("h2"), F.lit(0).alias("bits")))
    p = near.join(hashes.toDF("a", "h1"), "h1").join(hashes.toDF("b", "h2"), "h2").where("h1 <> h2 or a < b")
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")
