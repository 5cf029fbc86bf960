"""A corpus pipeline: classify quality, keep one of each group of near copies, mask personal data,
mix sources to their weights, encode to token ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lightbox.llm import bpe, mixing, ngramjoin, pii, quality
from lightbox.llm.common import fresh, named, written

#: Rows of dropped near copies are broadcast up to this many (a doc_id and 16 bytes each), else joined by a shuffle.
BROADCAST_IDS = 1_000_000


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; it learns from ``labels``."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model, only_kept=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents one row: the one with the smallest doc_id, null last, then
    the smallest digest of the text. A doc_id with texts in several components stays in each. Empty texts
    link with nothing: rows of one doc_id leave one, and those of a null doc_id stay."""
    found = ngramjoin.components(docs, digests=True)
    component = F.when(F.col("n_shingles") > 0, F.concat(F.lit("set "), "top")).when(F.col("doc_id").isNotNull(), F.concat(F.lit("id "), "doc_id")).alias("component")
    rows = written(found.select("doc_id", "digest", component).where("component is not null").groupBy("component", "doc_id", "digest").agg(F.count(F.lit(1)).alias("n")), "pipeline-components")
    first = rows.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
    dropped = written(rows.join(first, "component").where(other).select("doc_id", "digest"), "pipeline-dropped")
    mark, key_id, key_digest = (fresh(docs, n) for n in ("row_digest", "key_id", "key_digest"))
    keyed = docs.withColumn(mark, F.unhex(F.md5(F.coalesce("text", F.lit("")))))

    def matched(left: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = keys.select(F.col("doc_id").alias(key_id), F.col("digest").alias(key_digest))
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return left.join(keys, left["doc_id"].eqNullSafe(F.col(key_id)) & (left[mark] == F.col(key_digest)), how)

    left = matched(keyed, dropped, "left_anti")
    # rows that share doc_id and text
    repeated = rows.where("n > 1").select("doc_id", "digest")
    if repeated.limit(1).count():
        left = matched(left, repeated, "left_anti").unionByName(matched(left, repeated, "left_semi").dropDuplicates(["doc_id", mark]))
    return left.drop(mark)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; none is dropped."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, as the shards' quotas draw it: a document comes as often as it is drawn, one at a quota's end in
    part. The shard itself isn't among the columns of ``documents``; it orders the rows."""
    return mixing.draw(docs).select(*named(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of each row."""
    return bpe.encode_documents(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, digests=False)


STAGES = [("quality", reject_low_quality), ("near_copies", drop_near_copies), ("pii", mask_personal_data), ("mixing", mix_sources), ("encode", encode)]
#: A fitted classifier can't be written in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
