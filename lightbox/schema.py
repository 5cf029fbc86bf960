"""The catalog's relations, and migrations between schema versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, IntegerType, LongType, StringType, StructField, StructType

SCHEMA_VERSION = 5


def _fields(**kinds) -> StructType:
    return StructType([StructField(name, kind) for name, kind in kinds.items()])


_L, _I, _S, _D, _V = LongType(), IntegerType(), StringType(), DoubleType(), ArrayType(FloatType())

PHOTOS = _fields(id=_L, path=_S, file_size=_L, width=_I, height=_I, format=_S, exif_date=_S, num_faces=_I, scanned_at=_S, phash=_S, duplicate_group_id=_L)
FACES = _fields(id=_L, photo_id=_L, bbox_x=_I, bbox_y=_I, bbox_w=_I, bbox_h=_I, embedding=_V, detection_confidence=_D, cluster_id=_L, dismissed=_I)
CLUSTERS = _fields(id=_L, name=_S, representative_face_id=_L, created_at=_S, updated_at=_S)
DUPLICATE_GROUPS = _fields(id=_L, created_at=_S)
TABLES = {"photos": PHOTOS, "faces": FACES, "clusters": CLUSTERS, "duplicate_groups": DUPLICATE_GROUPS}
EPOCH = "1970-01-01 00:00:00"


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """``df`` with exactly the columns of ``schema``: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields))


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def migrate(tables: dict[str, DataFrame], version: int) -> dict[str, DataFrame]:
    """The tables brought from ``version`` to SCHEMA_VERSION, step by step; idempotent at the end.

    2 adds faces.dismissed; 3 drops all faces and clusters, as vectors changed their dimension, and
    marks every photo for a new scan; 4 is physical only; 5 adds hashes and duplicate groups."""
    out = dict(tables)
    if version < 2:
        out["faces"] = out["faces"].withColumn("dismissed", F.lit(0))
    if version < 3:
        out["faces"], out["clusters"] = out["faces"].where(F.lit(False)), out["clusters"].where(F.lit(False))
        out["photos"] = out["photos"].withColumn("scanned_at", F.lit(EPOCH))
    if version < 5:
        spark = out["photos"].sparkSession
        out["photos"] = out["photos"].withColumns({"phash": F.lit(None).cast("string"), "duplicate_group_id": F.lit(None).cast("long")})
        out["duplicate_groups"] = empty(spark, "duplicate_groups")
    return {name: conform(out[name], schema) for name, schema in TABLES.items()}
