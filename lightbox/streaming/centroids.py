"""Streaming assignment to centroids that move: sums and counts by cluster as state, and a buffer of vectors that wait for a cluster.

The state after batch n is a folder of its own, made from that after batch n - 1 and the batch alone, so a batch that runs again after a failure gives the same state and
the same rows. A batch's vectors and those that wait go to the nearest centroid as it is now; what is left is clustered by density, so vectors that come one by one become a cluster
when enough are near each other; those that have waited for so many batches leave the buffer. Sums are merged, nothing is read again but the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.vectors import FLOOR, norm, normalized
from ..operators.density import dbscan
from ..operators.neighbors import nearest_centroid
from ..plans.materialize import remove, written
from .ingest import centroid_sums, merged_sums

SUMS, WAITING = "cluster_id long, n long, sums array<double>", "id long, embedding array<float>, since long"


def centroids_of(sums: DataFrame) -> DataFrame:
    """(cluster_id, centroid) of sums: unit length unless (nearly) zero."""
    mean = sums.select("cluster_id", F.transform("sums", lambda x: x / F.col("n")).alias("m"))
    return mean.select("cluster_id", F.when(norm(F.col("m")) > FLOOR, normalized(F.col("m"))).otherwise(F.col("m")).alias("centroid"))


class GrowingClusters:
    """``path``: a shared folder for state and output. ``keep``: batches that a vector waits; states of batches before the last two are removed."""

    def __init__(self, spark: SparkSession, path: str, eps: float, least: int, keep: int = 10):
        self.spark, self.path, self.eps, self.least, self.keep = spark, path, eps, least, keep

    def start(self, vectors: DataFrame) -> None:
        """The state before the first batch, from vectors (cluster_id, embedding) of known clusters."""
        self._put(-1, centroid_sums(vectors), self.spark.createDataFrame([], WAITING))

    def _put(self, number: int, sums: DataFrame, waiting: DataFrame) -> None:
        sums.select("cluster_id", F.col("n").cast("long").alias("n"), "sums").write.mode("overwrite").parquet(f"{self.path}/state-{number}/sums")
        waiting.write.mode("overwrite").parquet(f"{self.path}/state-{number}/waiting")

    def sums(self, number: int) -> DataFrame:
        return self.spark.read.schema(SUMS).parquet(f"{self.path}/state-{number}/sums")

    def waiting(self, number: int) -> DataFrame:
        return self.spark.read.schema(WAITING).parquet(f"{self.path}/state-{number}/waiting")

    def step(self, batch: DataFrame, number: int) -> None:
        """Takes a batch (id, embedding); an id within a batch counts once, the least vector of those that have it."""
        sums, waiting = self.sums(number - 1), self.waiting(number - 1)
        new = batch.where("id is not null and embedding is not null").groupBy("id").agg(F.min("embedding").alias("embedding")).withColumn("since", F.lit(number).cast("long"))
        seen = written(waiting.join(new.select("id"), "id", "left_anti").unionByName(new), "stream-seen")
        near = written(nearest_centroid(seen, centroids_of(sums)).where(F.col("dist") <= self.eps), "stream-near")
        rest = written(seen.join(near.select("id"), "id", "left_anti"), "stream-rest")
        labels = written(dbscan(rest, self.eps, self.least).where("label >= 0").select("id", "label"), "stream-labels")
        first = (sums.agg(F.max("cluster_id")).first()[0] or 0) + 1
        found = near.select("id", F.col("cluster_id").cast("long").alias("cluster_id"), "dist").unionByName(labels.select("id", (F.col("label") + first).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("dist")))
        left = rest.join(labels.select("id"), "id", "left_anti")
        gone = left.where(F.col("since") <= number - self.keep).select("id", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("double").alias("dist"))
        placed = written(found.unionByName(gone), "stream-placed")
        placed.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")
        members = placed.where("cluster_id is not null").join(seen.select("id", "embedding"), "id").select("cluster_id", "embedding")
        self._put(number, merged_sums(sums, centroid_sums(members).select("cluster_id", F.col("n").cast("long").alias("n"), "sums")), left.where(F.col("since") > number - self.keep).select("id", "embedding", "since"))
        remove(self.spark, f"{self.path}/state-{number - 3}")

    def placed(self) -> DataFrame:
        """(id, cluster_id, dist, batch): rows that got a cluster, or waited in vain."""
        return self.spark.read.schema("id long, cluster_id long, dist double, batch int").parquet(f"{self.path}/out")

    def run(self, source: DataFrame, checkpoint: str) -> StreamingQuery:
        """Takes a stream (id, embedding) up to what is there now."""
        return source.writeStream.foreachBatch(self.step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
