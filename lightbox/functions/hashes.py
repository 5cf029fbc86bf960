"""64-bit hashes: hex form, Hamming distance, SimHash of texts, perceptual hash of pixels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def from_hex(h: Column) -> Column:
    """16 hex digits as a signed long; null for anything else."""
    return F.when(h.rlike("^[0-9a-fA-F]{16}$"), F.conv(h, 16, -10).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def simhash64(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hi, lo, phash): bit i of a half is set if more of the text's distinct space-separated
    tokens have it in the same half of their MD5 than not. A pass over the rows without a shuffle; null texts have no row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):  # bits of some documents at a time
                rows = batch.slice(start, 256)
                tokens = [set(t.split(" ")) for t in rows.column(1).to_pylist()]
                sizes = np.array([len(t) for t in tokens], dtype=np.int64)
                digests = b"".join(md5(w.encode(), usedforsecurity=False).digest()[:8] for t in tokens for w in t)
                bits = np.unpackbits(np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8), axis=1)
                sums = np.add.reduceat(bits, np.cumsum(sizes) - sizes, axis=0, dtype=np.int64)
                packed = np.packbits(2 * sums > sizes[:, None], axis=1)
                halves = packed.view(">u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array([x.tobytes().hex() for x in packed], pa.string())], names=[key, "hi", "lo", "phash"])

    wanted = docs.select(key, text).where(F.col(text).isNotNull())
    return wanted.mapInArrow(run, docs.select(key).schema.add("hi", "long").add("lo", "long").add("phash", "string"))


def phash_of_gray(gray: np.ndarray) -> str | None:
    """The perceptual hash of a picture in gray: resampled to 32 x 32, two-dimensional cosine
    transform, and for the 8 x 8 lowest frequencies whether each is over their median."""
    if gray is None or gray.size == 0 or gray.ndim != 2:
        return None
    n, low = 32, 8
    h, w = gray.shape
    cumulated = np.pad(np.cumsum(np.cumsum(gray.astype(np.float64), axis=0), axis=1), ((1, 0), (1, 0)))
    ys, xs = np.linspace(0, h, n + 1), np.linspace(0, w, n + 1)
    y0, y1 = np.floor(ys[:-1]).astype(int), np.maximum(np.ceil(ys[1:]).astype(int), np.floor(ys[:-1]).astype(int) + 1)
    x0, x1 = np.floor(xs[:-1]).astype(int), np.maximum(np.ceil(xs[1:]).astype(int), np.floor(xs[:-1]).astype(int) + 1)
    area = np.outer(y1 - y0, x1 - x0)
    small = (cumulated[np.ix_(y1, x1)] - cumulated[np.ix_(y0, x1)] - cumulated[np.ix_(y1, x0)] + cumulated[np.ix_(y0, x0)]) / area
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    basis = np.cos(np.pi * k * (2 * x + 1) / (2 * n))
    found = (basis @ small @ basis.T)[:low, :low]
    return f"{int(''.join('1' if b else '0' for b in (found > np.median(found)).ravel()), 2):016x}"


@F.pandas_udf(StringType())
def phash64(height: pd.Series, width: pd.Series, channels: pd.Series, data: pd.Series) -> pd.Series:
    """Of rows of Spark's image source (BGR or gray bytes); null where the bytes don't fit the size."""

    def one(h, w, c, d):
        try:
            pixels = np.frombuffer(d, dtype=np.uint8).reshape(h, w, c)
        except (TypeError, ValueError):
            return None
        weights = {1: [1.0], 3: [0.114, 0.587, 0.299], 4: [0.114, 0.587, 0.299, 0.0]}.get(c)
        return phash_of_gray(pixels @ np.array(weights)) if weights else None

    return pd.Series([one(*row) for row in zip(height, width, channels, data, strict=True)], dtype=object)
