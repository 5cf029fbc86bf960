"""Search for a part of a name by postings of its pieces, in place of a look at every name.

A name has a posting for each distinct piece of one to GRAM characters of its lower-case form. A query of up to GRAM characters is one piece; a longer one has several of
GRAM characters, and the names that have all of them are looked at themselves."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, BUCKETS = 3, 64


def pieces_of(query: str) -> list[str]:
    """The distinct pieces that a name with this part must have."""
    q = query.lower()
    return [q] if len(q) <= GRAM else sorted({q[i : i + GRAM] for i in range(len(q) - GRAM + 1)})


def postings(names: DataFrame) -> DataFrame:
    """(piece, id) of names (id, name)."""
    low = F.lower("name")
    starts = F.sequence(F.lit(1), F.length(low))
    each = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(GRAM)), lambda n: F.transform(F.filter(starts, lambda i: i + n - 1 <= F.length(low)), lambda i: F.substring(low, i, n))))
    return names.where(F.length("name") > 0).select("id", F.explode(F.array_distinct(each)).alias("piece"))


@dataclass
class NamesIndex:
    spark: SparkSession
    path: str

    @classmethod
    def create(cls, names: DataFrame, path: str) -> NamesIndex:
        """Writes the postings of names (id, name) by pieces, so a query reads the folders of its own."""
        rows = postings(names).withColumn("bucket", F.pmod(F.xxhash64("piece"), F.lit(BUCKETS)).cast("int"))
        rows.repartition("bucket").sortWithinPartitions("bucket", "piece", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        return cls(names.sparkSession, path)

    def candidates(self, query: str) -> DataFrame:
        """(id) of names that have all pieces of ``query``; the pieces' buckets are found before the read."""
        wanted = pieces_of(query)
        pieces = self.spark.createDataFrame([(p,) for p in wanted], "piece string")
        buckets = [r[0] for r in pieces.select(F.pmod(F.xxhash64("piece"), F.lit(BUCKETS)).cast("int")).distinct().collect()]  # of one query's pieces
        found = self.spark.read.schema("id long, piece string, bucket int").parquet(f"{self.path}/postings").where(F.col("bucket").isin(buckets) & F.col("piece").isin(wanted))
        return found.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(wanted)).select("id")

    def search(self, names: DataFrame, query: str) -> DataFrame:
        """Rows of ``names`` (id, name, ...) whose name has ``query`` in any case; all for an empty query."""
        if not query:
            return names
        return names.join(self.candidates(query), "id", "left_semi").where(F.contains(F.lower("name"), F.lit(query.lower())))
