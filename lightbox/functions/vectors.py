"""Vectors as arrays of floats: norms, products, means, and the packed float32 form."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

FLOOR = 1e-10


def as_double(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def dot(a: Column, b: Column) -> Column:
    """For single values; joins on products use blocks (``operators.neighbors``)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit length in doubles; a norm under FLOOR counts as FLOOR."""
    return F.transform(F.array(F.greatest(norm(v), F.lit(FLOOR))), lambda n: F.transform(v, lambda x: x.cast("double") / n))[0]


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(normalized(a), normalized(b))


def mean_vectors(df: DataFrame, key: str, vector: str = "embedding") -> DataFrame:
    """(key, centroid): the mean of each key's vectors, made unit length unless it is (nearly) zero.
    A partial and a final aggregation of sums in the JVM; nothing is gathered."""
    means = df.groupBy(key).agg(Summarizer.mean(array_to_vector(as_double(F.col(vector)))).alias("m"))
    m = vector_to_array("m")
    return means.select(key, m.alias("m")).select(key, F.when(norm(F.col("m")) > FLOOR, normalized(F.col("m"))).otherwise(F.col("m")).alias("centroid"))


@F.pandas_udf(ArrayType(FloatType()))
def decode_f32(packed: pd.Series) -> pd.Series:
    """Little-endian float32 bytes to an array."""
    return packed.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4").tolist())


@F.pandas_udf(BinaryType())
def encode_f32(vector: pd.Series) -> pd.Series:
    """An array of floats to little-endian float32 bytes."""
    return vector.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())


def eps_of_percent(percent: float) -> float:
    """A similarity in percent as a cosine distance, and back with ``percent_of_eps``."""
    return 1 - percent / 100


def percent_of_eps(eps: float) -> float:
    return (1 - eps) * 100


def coupled_percents(confident: float, maybe: float, least: float) -> tuple[float, float]:
    """A tentative threshold must stay under the confident one."""
    return confident, maybe if maybe < confident else max(confident - 5, least)
