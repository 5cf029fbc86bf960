"""Pages of a sorted view that are read by their number: a sorted layout with a small table of where page groups begin.

``offset`` sorts all rows and passes over those before a page, for each page again. Here rows are numbered in order once, without one task, and written in order in folders of
some pages each, so a page is a stretch of numbers in one folder, found by the numbers' bounds in the files' footers; a page that begins at a key is found by the
table of bounds first."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import numbered

#: Rows of a page, pages of a folder.
PAGE, FOLDER = 200, 500


@dataclass
class Pages:
    """``path``: what ``write_pages`` wrote; ``keys``: the columns of the order."""

    spark: SparkSession
    path: str
    keys: list[str]
    page_size: int = PAGE
    folder: int = FOLDER

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def bounds(self) -> DataFrame:
        """(folder, first, keys): of each folder its first row's number and keys, a row for each ``folder`` pages."""
        return self.spark.read.parquet(f"{self.path}/bounds")

    def page(self, number: int) -> DataFrame:
        """A page's rows in order; none past the end."""
        start = number * self.page_size
        rows = self._rows().where((F.col("folder") == number // self.folder) & (F.col("place") >= start) & (F.col("place") < start + self.page_size))
        return rows.orderBy("place").drop("folder", "place")

    def from_key(self, *key) -> DataFrame:
        """The ``page_size`` rows from the first one on that isn't before ``key``: the folder that may hold it, and the next."""
        at = F.struct(*(F.col(k) for k in self.keys))
        wanted = F.struct(*(F.lit(v).alias(k) for k, v in zip(self.keys, key, strict=True)))
        before = self.bounds().where(at < wanted).agg(F.max("folder")).first()[0] or 0
        rows = self._rows().where(F.col("folder").isin(before, before + 1)).where(at >= wanted)
        return rows.orderBy("place").limit(self.page_size).drop("folder", "place")


def write_pages(rows: DataFrame, path: str, order: dict[str, Column], page_size: int = PAGE, folder: int = FOLDER) -> Pages:
    """Writes ``rows`` in order of ``order`` (names of key columns, which are written too, ascending and without nulls; together they tell rows apart)."""
    keyed = rows.select("*", *(c.alias(k) for k, c in order.items() if k not in rows.columns))
    if clash := {"place", "folder"} & set(keyed.columns):
        raise ValueError(f"columns {sorted(clash)} are the layout's own")
    renamed = keyed.withColumnRenamed("id", "own_id") if "id" in keyed.columns else keyed
    placed = numbered(renamed, ["own_id" if k == "id" else k for k in order], 0).withColumnRenamed("id", "place")
    placed = placed.withColumnRenamed("own_id", "id") if "id" in keyed.columns else placed
    placed = placed.withColumn("folder", F.floor(F.col("place") / (page_size * folder)).cast("int"))
    placed.repartition("folder").sortWithinPartitions("folder", "place").write.mode("overwrite").partitionBy("folder").option("parquet.block.size", 1 << 20).parquet(f"{path}/rows")
    spark = rows.sparkSession
    first = spark.read.parquet(f"{path}/rows").groupBy("folder").agg(F.min(F.struct("place", *order)).alias("m"))
    first.select("folder", F.col("m.place").alias("first"), *(F.col(f"m.{k}").alias(k) for k in order)).write.mode("overwrite").parquet(f"{path}/bounds")
    return Pages(spark, path, list(order), page_size, folder)
