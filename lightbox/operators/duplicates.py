"""Groups of near-duplicate pictures by 64-bit hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.hashes import from_hex
from ..plans.materialize import written
from .density import density_labels
from .neighbors import near_hashes

# Defaults of the catalog's tools.
BITS, LEAST_GROUP = 10, 2


def duplicate_labels(hashes: DataFrame, bits: int = BITS, least: int = LEAST_GROUP) -> DataFrame:
    """(id, label) of ``hashes`` (id, hash long): density clustering on Hamming distance; -1 for singles.

    Distinct hashes are clustered, each counting as often as it occurs, and rows get their hash's label, so no pair of equal hashes is ever made."""
    hashes = hashes.where("id is not null and hash is not null").select("id", "hash")
    distinct = written(hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")), "distinct-hashes")
    links = near_hashes(distinct.select("hash"), bits).select(F.col("h1").alias("a"), F.col("h2").alias("b"))
    labels = density_labels(distinct.withColumnRenamed("hash", "id"), links, least)
    return hashes.join(labels.select(F.col("id").alias("hash"), "label"), "hash").select("id", "label")


def detect_duplicates(catalog: Catalog, bits: int = BITS, least: int = LEAST_GROUP) -> tuple[Catalog, int]:
    """Old groups go; photos whose hashes are near each other get a group; (catalog, number of groups)."""
    hashed = written(catalog.photos.select("id", from_hex(F.col("phash")).alias("hash")).where("hash is not null"), "hashes")  # read by several joins
    cleared = catalog.to(photos=catalog.photos.withColumn("duplicate_group_id", F.lit(None).cast("long")), duplicate_groups=catalog.duplicate_groups.where(F.lit(False)))
    if hashed.limit(least).count() < least:
        return cleared, 0
    labels = written(duplicate_labels(hashed, bits, least).where("label >= 0"), "duplicates")
    first = (catalog.duplicate_groups.agg(F.max("id")).first()[0] or 0) + 1
    groups = labels.select((F.col("label") + first).cast("long").alias("id")).distinct().withColumn("created_at", F.lit(None).cast("string"))
    photos = cleared.photos.drop("duplicate_group_id").join(labels.select("id", (F.col("label") + first).cast("long").alias("duplicate_group_id")), "id", "left")
    return cleared.to(photos=photos.select(*catalog.photos.columns), duplicate_groups=groups), groups.count()
