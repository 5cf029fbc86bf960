"""A scan that goes on: pictures of a folder as a stream, in lots by trigger, stored once at the end."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..catalog import Catalog
from ..operators.ingest import COMMIT, Analyser, fold_journal, write_lot
from ..plans.materialize import remove
from ..sources import pictures


def scan_stream(
    spark: SparkSession, folder: str, journal: str, checkpoint: str, scanned_at: Callable[[], str], factory: Callable[[], Analyser] | None = None, recursive: bool = True,
    files_per_trigger: int = COMMIT, hashed: bool = True, on_lot: Callable[[int, int, int], None] | None = None, seconds: float = 0,
) -> StreamingQuery:
    """New and changed pictures of ``folder``, about ``files_per_trigger`` of them a batch, each as a lot of ``journal``; ``checkpoint`` holds how far it
    is. A batch that runs again after a failure finds the same stretch of changes and overwrites its own lot, so nothing is lost or there twice; a file that changed
    meanwhile comes again in a later lot, which counts. ``on_lot``: gets number, pictures stored and boxes of each lot."""
    pictures.register(spark)
    source = spark.readStream.format(pictures.FORMAT).option("recursive", str(recursive)).option("headers", "false")
    found = source.option("maxFilesPerTrigger", files_per_trigger).option("progress", f"{checkpoint}/pictures").load(folder)

    def lot(batch: DataFrame, number: int) -> None:
        good, boxes = write_lot(spark, journal, number, batch.select("path"), scanned_at(), factory, hashed)
        if on_lot:
            on_lot(number, good, boxes)

    return found.writeStream.foreachBatch(lot).option("checkpointLocation", checkpoint).trigger(processingTime=f"{seconds} seconds").start()


def scan_what_changed(catalog: Catalog, folder: str, journal: str, checkpoint: str, scanned_at: Callable[[], str], **options) -> Catalog:
    """All lots up to now, folded into the catalog at once; lots that an earlier run left are among them. The next run begins where this one ended."""
    spark = catalog.photos.sparkSession
    query = scan_stream(spark, folder, journal, checkpoint, scanned_at, **options)
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    state = fold_journal(catalog, journal)
    remove(spark, journal)
    return state


def pending(spark: SparkSession, journal: str) -> DataFrame:
    """(lot, pictures, errors) of the lots that aren't in the catalog yet."""
    lots = spark.read.option("basePath", journal).parquet(f"{journal}/lot-*")
    return lots.groupBy("lot").agg(F.count_if(F.col("error").isNull()).alias("pictures"), F.count_if(F.col("error").isNotNull()).alias("errors"))
