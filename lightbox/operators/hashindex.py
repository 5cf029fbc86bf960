"""Near-duplicate groups that are kept: photos added by a scan meet old ones by their own band values only.

Tables in buckets: each distinct hash under the values of its bands, and with the root of its group and how often it occurs. What is added looks up the values
near its own in the buckets of band values, so these aren't shuffled, only the new side is; its links, and those among the new ones, join new hashes and roots of old groups to
components, and where old groups meet, a small table says which root moved where. Rows have the number of the batch that brought them; a batch counts once its number is
noted, so one that broke off is as if it hadn't been, and is brought again under the same number.

Groups are those of two photos or more, where any neighbour and any copy makes a hash core: the components of near hashes."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.materialize import remove, written
from .graph import connected_components
from .neighbors import band_entries, band_probes, near_hashes

BITS, ONE_TASK = 10, 1_000_000
KINDS = {"bands": ("band int, bits long, hash long, batch int", ("band", "bits")), "hashes": ("hash long, weight long, least long, root long, batch int", ("hash",)), "moves": ("root long, moved long, batch int", None)}


@dataclass
class HashIndex:
    """``path``: a folder that driver and executors share. Bands of ``bits``; buckets as many as a join's tasks."""

    spark: SparkSession
    path: str
    bits: int = BITS
    buckets: int = 0
    _names: dict[str, str] = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self) -> None:
        found = self._meta()
        self.buckets = found.get("buckets") or self.buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.bits = found.get("bits", self.bits)
        for table, (columns, keys) in KINDS.items():  # the session's names for what lies in the folder
            name = f"lightbox_{table}_{uuid.uuid4().hex}"
            clustered = f"CLUSTERED BY ({', '.join(keys)}) INTO {self.buckets} BUCKETS" if keys else ""
            self.spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {clustered} LOCATION '{self.path}/{table}'")
            self._names[table] = name

    def close(self) -> None:
        for name in self._names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def _meta(self) -> dict:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/meta/_SUCCESS")
        if not found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(found):
            return {}
        return json.loads(self.spark.read.text(f"{self.path}/meta").collect()[0][0])

    @property
    def batch(self) -> int:
        """The last batch that is noted."""
        return self._meta().get("batch", 0)

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self._names[name]).where(F.col("batch") <= self.batch)

    def _append(self, name: str, rows: DataFrame, batch: int) -> None:
        columns = [c.split()[0] for c in KINDS[name][0].split(", ")]
        self.spark.sql(f"REFRESH TABLE {self._names[name]}")
        rows.withColumn("batch", F.lit(batch)).select(*columns).write.insertInto(self._names[name])
        self.spark.sql(f"REFRESH TABLE {self._names[name]}")

    def _moved(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``root`` as it is now: moves are kept so that one step is enough, the last one of a root counts."""
        moves = self.table("moves").groupBy("root").agg(F.max_by("moved", "batch").alias("moved"))
        return rows.join(moves, "root", "left").withColumn("root", F.coalesce("moved", "root")).drop("moved")

    def add(self, photos: DataFrame) -> int:
        """Photos (id, hash long) that aren't in the index; the batch's number. A batch that broke off left rows of the number that is given again, which
        can't be told apart, so they are taken out first."""
        batch = self.batch + 1
        self._clean(batch)
        new = written(photos.where("id is not null and hash is not null").groupBy("hash").agg(F.count(F.lit(1)).alias("weight"), F.min("id").alias("least")), "index-new")
        known = self.table("hashes").select("hash").distinct()
        fresh = written(new.select("hash").join(known, "hash", "left_anti"), "index-fresh")
        met = band_probes(fresh, self.bits).hint("merge").join(self.table("bands").select("band", "bits", "hash"), ["band", "bits"]).select("other", "hash").distinct()
        met = met.where(F.bit_count(F.col("other").bitwiseXOR(F.col("hash"))) <= self.bits)
        roots = self._moved(self.table("hashes").where("root is not null").select("hash", "root"))
        old = met.join(roots, "hash").select(F.col("other").alias("a"), F.col("root").alias("b"))
        own = near_hashes(fresh, self.bits).select(F.col("h1").alias("a"), F.col("h2").alias("b"))
        links = written((old.unionByName(own) if batch > 1 else own).distinct(), "index-links")  # the first batch meets nothing old
        found = written(connected_components(links, small=ONE_TASK), "index-components")
        rooted = fresh.join(found, fresh["hash"] == found["node"], "left").select("hash", F.coalesce("root", "hash").alias("root"))
        counts = new.join(rooted, "hash", "left").select("hash", "weight", "least", "root")  # rows that add to a known hash have no root of their own
        # old roots that moved now, and earlier moves to them
        now = written(found.join(fresh, found["node"] == fresh["hash"], "left_anti").where("node <> root").select(F.col("node").alias("root"), F.col("root").alias("moved")), "index-moves")
        earlier = self.table("moves").groupBy(F.col("root").alias("first")).agg(F.max_by("moved", "batch").alias("root"))
        moves = now.unionByName(earlier.join(now, "root").select(F.col("first").alias("root"), "moved"))
        self._append("bands", band_entries(fresh, self.bits), batch)
        self._append("hashes", counts, batch)
        self._append("moves", moves, batch)
        note = json.dumps({"batch": batch, "bits": self.bits, "buckets": self.buckets})
        self.spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/meta")
        return batch

    def _clean(self, batch: int) -> None:
        """Takes out rows of a batch that broke off."""
        for table, (columns, _) in KINDS.items():
            whole = self.spark.table(self._names[table])
            if whole.where(F.col("batch") >= batch).limit(1).count():
                kept = written(whole.where(F.col("batch") < batch), "index-kept")
                remove(self.spark, f"{self.path}/{table}")
                self.spark.sql(f"REFRESH TABLE {self._names[table]}")
                kept.select(*(c.split()[0] for c in columns.split(", "))).write.insertInto(self._names[table])
                self.spark.sql(f"REFRESH TABLE {self._names[table]}")

    def groups(self) -> DataFrame:
        """(hash, label) of the hashes in groups of two photos or more, numbered by the groups' smallest ids, from 0."""
        from .ingest import numbered

        each = self.table("hashes").groupBy("hash").agg(F.sum("weight").alias("weight"), F.min("least").alias("least"), F.max("root").alias("root"))
        each = written(self._moved(each), "index-hashes")
        sizes = each.groupBy("root").agg(F.sum("weight").alias("size"), F.min("least").alias("first")).where("size > 1")
        labels = numbered(sizes.select("root", "first"), ["first"], 0).select("root", F.col("id").cast("int").alias("label"))
        return each.join(labels, "root").select("hash", "label")

    def labels(self, photos: DataFrame) -> DataFrame:
        """(id, label) of photos (id, hash) that are in groups."""
        return photos.where("hash is not null").join(self.groups(), "hash").select("id", "label")
