"""The catalog's state: four relations and the highest automatic number given so far."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema
from .plans.materialize import written


@dataclass(frozen=True)
class Catalog:
    """Immutable; every action returns another one."""

    photos: DataFrame
    faces: DataFrame
    clusters: DataFrame
    duplicate_groups: DataFrame
    last_auto: int = 0

    @classmethod
    def empty(cls, spark: SparkSession) -> Catalog:
        return cls(**{t: schema.empty(spark, t) for t in schema.TABLES})

    @classmethod
    def of(cls, spark: SparkSession, **tables: DataFrame) -> Catalog:
        """A catalog of the given tables, brought to the full schema; others are empty."""
        return cls(**{t: schema.conform(tables[t], s) if t in tables else schema.empty(spark, t) for t, s in schema.TABLES.items()})

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Catalog:
        meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta").collect()))
        known = lambda t: spark.read.schema(schema.TABLES[t]) if "buckets" in meta else spark.read  # noqa: E731  an empty table in buckets has no files
        tables = {t: known(t).parquet(f"{path}/{t}") for t in schema.TABLES if t in meta["tables"]}
        return cls(**schema.migrate(tables, meta["version"]), last_auto=meta["last_auto"])

    def save(self, path: str) -> None:
        """Tables as Parquet. ``path`` must not be where the catalog is read from."""
        spark = self.photos.sparkSession
        for t in schema.TABLES:
            getattr(self, t).write.mode("overwrite").parquet(f"{path}/{t}")
        meta = {"version": schema.SCHEMA_VERSION, "last_auto": self.last_auto, "tables": list(schema.TABLES)}
        spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")

    def to(self, **changes) -> Catalog:
        return replace(self, **changes)

    def settled(self) -> Catalog:
        """The same with lineage cut: tables written to the shared folder and read again."""
        return self.to(**{t: written(getattr(self, t), t) for t in schema.TABLES})

    @cached_property
    def active(self) -> DataFrame:
        return self.faces.where("dismissed = 0")

    def problems(self) -> DataFrame:
        """(invariant, id): dismissed faces with a cluster, faces without their photo or cluster,
        photos without their duplicate group, groups of fewer than two photos."""
        f, p, g = self.faces, self.photos, self.duplicate_groups
        named = lambda df, what: df.select(F.lit(what).alias("invariant"), F.col("id"))
        sizes = p.where("duplicate_group_id is not null").groupBy(F.col("duplicate_group_id").alias("id")).count()
        return (
            named(f.where("dismissed = 1 and cluster_id is not null"), "dismissed face in a cluster")
            .unionByName(named(f.join(p.select(F.col("id").alias("photo_id")), "photo_id", "left_anti"), "face without photo"))
            .unionByName(named(f.where("cluster_id is not null").join(self.clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_anti"), "face without cluster"))
            .unionByName(named(p.where("duplicate_group_id is not null").join(g.select(F.col("id").alias("duplicate_group_id")), "duplicate_group_id", "left_anti"), "photo without duplicate group"))
            .unionByName(named(g.join(sizes, "id", "left").where("coalesce(count, 0) < 2"), "small duplicate group"))
        )
