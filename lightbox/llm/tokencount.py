"""Token counts through a digest cache.

A text's key is the SHA-256 of its normalised content together with the digest of the
tokenizer's file, so another tokenizer or version never meets stored counts of this one.
Normalisation is only what no tokenizer can tell apart: a null text becomes the empty one.
Documents' keys are joined to the stored counts; texts whose key isn't stored are reduced to
one for each key before and after the shuffle, encoded, and their counts are appended to the
cache. The counts of all documents then come from the cache by a join on keys alone.

Defined results: null and empty texts have the count of the empty text; repeated rows get
a row each; an empty table gives an empty result; other columns than doc_id and text are
not read. A cache folder that doesn't exist yet is an empty cache.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import chunks
from .common import lean, written

CACHE = "tokenizer string, key binary, n_tokens long"


@lru_cache(maxsize=4)
def _counter(path: str):
    """The function that counts the tokens of a list of texts, and the digest of the file."""
    with open(path, "rb") as f:
        version = hashlib.sha256(f.read()).hexdigest()
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return (lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]), version
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return (lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]), version


def tokenizer_version(path: str) -> str:
    return _counter(path)[1]


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; none if the folder isn't there yet."""
    try:
        return spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CACHE)


def append_misses(keyed: DataFrame, cache: str, path: str) -> None:
    """Encode each distinct text of ``keyed`` (key, text) whose key isn't in ``cache``, and append its count."""
    version = tokenizer_version(path)
    stored = read_cache(keyed.sparkSession, cache).where(F.col("tokenizer") == version).select("key")
    # partial aggregation leaves a text once for each task before anything is shuffled
    misses = keyed.join(stored, "key", "left_anti").groupBy("key").agg(F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, _ = _counter(path)
        for batch in batches:
            for rows, texts in chunks(batch, limit=1_000_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([version] * len(texts), pa.string()), rows.column(0), pa.array(count(texts), pa.int64())], names=["tokenizer", "key", "n_tokens"]
                )

    misses.mapInArrow(lean(run), CACHE).write.mode("append").parquet(cache)


def count_tokens(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for every row of ``docs``; ``cache`` is a folder of stored counts."""
    text = F.coalesce("text", F.lit(""))
    key = F.unhex(F.sha2(text, 256)).alias("key")
    append_misses(docs.select(key, text.alias("text")), cache, path)
    counts = read_cache(docs.sparkSession, cache).where(F.col("tokenizer") == tokenizer_version(path)).groupBy("key").agg(F.max("n_tokens").alias("n_tokens"))
    sizes = written(docs.select("doc_id", key, F.octet_length(text).cast("long").alias("n_bytes")), "token-keys")
    return sizes.join(counts, "key", "left").select("doc_id", "n_bytes", "n_tokens")
