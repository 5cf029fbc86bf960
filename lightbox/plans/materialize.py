"""Intermediate tables, written where driver and executors can both reach them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset a local session gets a
    folder of its own (as in tests); on a cluster that folder would be another one on each machine, so it is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lightbox-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """The folder in ``shared_dir`` that holds all tables this application writes."""
    return f"{shared_dir(spark)}/lightbox-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet in the shared folder and read it again, so
    that lost executors never make earlier steps run twice and plans see true sizes. The tables stay until ``discard``."""
    path = f"{run_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder wherever Spark can write, if it is there."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)


def discard(spark: SparkSession) -> None:
    """Removes all tables that this application has written. Results that still read them must be stored before."""
    remove(spark, run_dir(spark))
