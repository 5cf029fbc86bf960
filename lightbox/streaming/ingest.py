"""Streaming ingestion of new vectors: micro-batches against frozen centroids, exactly-once by batch id."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.neighbors import nearest_centroid


def assign_stream(source: DataFrame, centroids: DataFrame, eps: float, output: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch of ``source`` (id, embedding; streaming) goes to the nearest of ``centroids`` within eps,
    or to none, as rows (id, cluster_id, dist) in ``output``/batch=<n>. A batch that runs again after
    a failure overwrites its own folder only. Duplicate ids within a batch are taken once."""

    def store(batch: DataFrame, number: int) -> None:
        once = batch.dropDuplicates(["id"])
        near = nearest_centroid(once, centroids).where(F.col("dist") <= eps)
        once.select("id").join(near, "id", "left").write.mode("overwrite").parquet(f"{output}/batch={number}")

    writer = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def vector_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 50) -> DataFrame:
    """New Parquet files of vectors as a stream, so many files a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def centroid_sums(vectors: DataFrame) -> DataFrame:
    """(cluster_id, n, sums) of (cluster_id, embedding): mergeable, so that centroids can be kept up to date
    by adding a batch's sums to the stored ones."""
    each = vectors.where("cluster_id is not null").select("cluster_id", F.posexplode("embedding").alias("pos", "x"))
    sums = each.groupBy("cluster_id", "pos").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    return sums.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sums"))


def merged_sums(stored: DataFrame, new: DataFrame) -> DataFrame:
    s = stored.unionByName(new)
    each = s.select("cluster_id", "n", F.posexplode("sums").alias("pos", "s")).groupBy("cluster_id", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    return each.groupBy("cluster_id").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "s"))), lambda p: p["s"]).alias("sums"))
