"""A catalog kept in buckets of ids: a change writes the buckets it touches, and counts follow by signed rows.

Which buckets an action touched is found without its help: a table that is the same object before and after is untouched, and of others each bucket's
checksums are compared, sums over hashes of rows without their vectors, which no action changes. The new rows of touched buckets are written beside the tables first, with a
note of what is to be done; only then buckets are overwritten, and a store that is opened with such a note ends what it says, so a crash leaves the state before or
after. Counts (faces and photos by cluster, faces by day, totals) are kept in buckets too: rows of touched buckets count as less one before and one more after, sums are merged into the
buckets of their keys, and what sums to nothing goes."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from ..functions.times import day
from .materialize import remove, written

#: Rows of a bucket about, and buckets at least and at most.
ROWS, LEAST, MOST = 100_000, 2, 4096
PENDING, META = "_pending", "meta"


def bucket(key: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


# ---------------------------------------------------------------- counts as signed rows


def _face_rows(c: Catalog, faces: DataFrame) -> dict[str, DataFrame]:
    """Rows (key, n) that each count adds up, of ``faces`` of a catalog."""
    active = faces.where("dismissed = 0")
    one = F.lit(1).cast("long").alias("n")
    in_cluster = faces.where("cluster_id is not null")
    state = F.when(F.col("dismissed") == 1, "dismissed_faces").when(F.col("cluster_id").isNull(), "unclustered_faces").otherwise("clustered_faces")
    dated = active.select(F.col("photo_id").alias("id")).join(c.photos.where("exif_date is not null").select("id", "exif_date"), "id")
    return {
        "faces_by_cluster": active.where("cluster_id is not null").select(F.col("cluster_id").cast("string").alias("key"), one),
        "photos_by_cluster": in_cluster.select(F.concat_ws("/", "cluster_id", "photo_id").alias("key"), one),  # counted pairs: distinct photos are those that are left
        "faces_by_day": dated.select(day(F.col("exif_date")).alias("key"), one),
        "totals": faces.select(state.alias("key"), one),
    }


COUNTS = ("faces_by_cluster", "photos_by_cluster", "faces_by_day", "totals")


def _totals(table: str, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(table).alias("key"), F.lit(1).cast("long").alias("n"))


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 0")


def _negative(rows: DataFrame) -> DataFrame:
    return rows.select("key", (-F.col("n")).alias("n"))


# ---------------------------------------------------------------- the store


@dataclass
class Store:
    spark: SparkSession
    path: str
    buckets: dict[str, int]

    @classmethod
    def create(cls, catalog: Catalog, path: str, buckets: int | None = None) -> Store:
        """Writes a whole catalog and its counts."""
        spark = catalog.photos.sparkSession
        number = {t: buckets or min(MOST, max(LEAST, -(-getattr(catalog, t).count() // ROWS))) for t in schema.TABLES} | dict.fromkeys((f"counts/{c}" for c in COUNTS), buckets or LEAST)
        store = cls(spark, path, number)
        for t in schema.TABLES:
            store._write(t, getattr(catalog, t), "id")
        rows = _face_rows(catalog, catalog.faces)
        rows["totals"] = rows["totals"].unionByName(_totals("photos", catalog.photos)).unionByName(_totals("clusters", catalog.clusters))
        for name in COUNTS:
            store._write(f"counts/{name}", _summed(rows[name]), "key")
        store._note(META, {"version": schema.SCHEMA_VERSION, "last_auto": catalog.last_auto, "tables": list(schema.TABLES), "buckets": number})
        return store

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        """The store at ``path``; what a crash left undone is done first."""
        meta = json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/{META}").collect()))
        store = cls(spark, path, meta["buckets"])
        store._finish()
        return store

    def load(self) -> Catalog:
        return Catalog.load(self.spark, self.path)

    def _write(self, table: str, rows: DataFrame, key: str, only: bool = False) -> None:
        kept = rows.withColumn("bucket", bucket(F.col(key), self.buckets[table])).repartition("bucket")
        writer = kept.write.mode("overwrite").partitionBy("bucket")
        (writer.option("partitionOverwriteMode", "dynamic") if only else writer).parquet(f"{self.path}/{table}")

    def _note(self, name: str, what: dict) -> None:
        self.spark.createDataFrame([(json.dumps(what),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/{name}")

    def _there(self, name: str) -> bool:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found)

    def _finish(self) -> None:
        if self._there(f"{PENDING}/ready/_SUCCESS"):
            todo = json.loads(self.spark.read.text(f"{self.path}/{PENDING}/ready").collect()[0][0])
            for table, touched in todo["touched"].items():
                rows = self.spark.read.parquet(f"{self.path}/{PENDING}/{table}")
                left = {r[0] for r in rows.select("bucket").distinct().collect()}
                self._write(table, rows.drop("bucket"), "key" if table.startswith("counts/") else "id", only=True)
                for k in touched:
                    if k not in left:
                        remove(self.spark, f"{self.path}/{table}/bucket={k}")
            self._note(META, todo["meta"])
        if self._there(PENDING):
            remove(self.spark, f"{self.path}/{PENDING}")

    def _stage(self, table: str, rows: DataFrame, key: str) -> None:
        rows.withColumn("bucket", bucket(F.col(key), self.buckets[table])).write.mode("overwrite").parquet(f"{self.path}/{PENDING}/{table}")

    def touched(self, table: str, before: DataFrame, after: DataFrame) -> list[int]:
        """Buckets of a table whose rows differ."""
        n = self.buckets[table]

        def sums(df: DataFrame) -> dict[int, tuple]:
            plain = [c for c, kind in df.dtypes if not kind.startswith("array")]
            rows = df.select(bucket(F.col("id"), n).alias("bucket"), F.xxhash64(*plain).alias("h"))
            return {r[0]: (r[1], r[2]) for r in rows.groupBy("bucket").agg(F.count(F.lit(1)), F.sum(F.col("h").cast("decimal(38,0)"))).collect()}  # a row a bucket

        old, new = sums(before), sums(after)
        return sorted(k for k in old.keys() | new.keys() if old.get(k) != new.get(k))

    def apply(self, before: Catalog, after: Catalog) -> dict[str, list[int]]:
        """Brings the store from ``before``, as it was loaded, to ``after``; the buckets written of each table, counts among them."""
        found: dict[str, list[int]] = {}
        for t in schema.TABLES:
            old, new = getattr(before, t), getattr(after, t)
            if new is not old and (some := self.touched(t, old, new)):
                found[t] = some
                self._stage(t, new.where(bucket(F.col("id"), self.buckets[t]).isin(some)), "id")
        part = lambda c, t: getattr(c, t).where(bucket(F.col("id"), self.buckets[t]).isin(found[t]))
        deltas: dict[str, DataFrame] = {}
        if "faces" in found:
            old, new = _face_rows(before, part(before, "faces")), _face_rows(after, part(after, "faces"))
            deltas = {name: new[name].unionByName(_negative(old[name])) for name in COUNTS}
        for t in {"photos", "clusters"} & set(found):
            rows = _totals(t, part(after, t)).unionByName(_negative(_totals(t, part(before, t))))
            deltas["totals"] = deltas["totals"].unionByName(rows) if "totals" in deltas else rows
        for name, rows in deltas.items():
            table = f"counts/{name}"
            delta = written(_summed(rows).withColumn("bucket", bucket(F.col("key"), self.buckets[table])), "count-deltas")
            some = sorted(r[0] for r in delta.select("bucket").distinct().collect())  # a row a bucket
            if some:
                found[table] = some
                old = self.spark.read.parquet(f"{self.path}/{table}").where(F.col("bucket").isin(some)).select("key", "n")
                self._stage(table, _summed(old.unionByName(delta.select("key", "n"))), "key")
        meta = {"version": schema.SCHEMA_VERSION, "last_auto": after.last_auto, "tables": list(schema.TABLES), "buckets": self.buckets}
        if found or after.last_auto != before.last_auto:
            self._note(f"{PENDING}/ready", {"touched": found, "meta": meta})
            self._finish()
        return found

    # ---------------------------------------------------------------- what counts tell

    def count(self, name: str) -> DataFrame:
        """(key, n) of a kept count."""
        return self.spark.read.schema("key string, n long, bucket int").parquet(f"{self.path}/counts/{name}").select("key", "n")

    def clusters_with_counts(self) -> DataFrame:
        """(id, name, face_count) with empty clusters."""
        n = self.count("faces_by_cluster").select(F.col("key").cast("long").alias("id"), F.col("n").alias("face_count"))
        return self.load().clusters.select("id", "name").join(n, "id", "left").select("id", "name", F.coalesce("face_count", F.lit(0)).cast("long").alias("face_count"))

    def photo_counts(self) -> DataFrame:
        """(cluster_id, photos): distinct photos of each existing cluster."""
        pairs = self.count("photos_by_cluster").groupBy(F.substring_index("key", "/", 1).cast("long").alias("cluster_id")).agg(F.count(F.lit(1)).alias("photos"))
        return self.load().clusters.select(F.col("id").alias("cluster_id")).join(pairs, "cluster_id", "left").select("cluster_id", F.coalesce("photos", F.lit(0)).alias("photos"))

    def day_counts(self) -> DataFrame:
        return self.count("faces_by_day").select(F.col("key").alias("day"), F.col("n").alias("faces"))

    def stats(self) -> DataFrame:
        """One row, as the catalog's own."""
        of = lambda *keys: F.coalesce(F.sum(F.when(F.col("key").isin(*keys), F.col("n"))), F.lit(0)).cast("long")
        return self.count("totals").agg(of("photos").alias("photos"), of("clusters").alias("clusters"), of("clustered_faces", "unclustered_faces").alias("faces"), of("unclustered_faces").alias("unclustered_faces"), of("dismissed_faces").alias("dismissed_faces"))
