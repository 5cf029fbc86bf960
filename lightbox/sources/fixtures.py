"""The catalog's relations as views over the star-schema test tables; the texts run in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..catalog import Catalog

# Definitions shared with the SQL oracle.
FACES_SQL = """
SELECT vec_id AS id, vec_id % 150 AS photo_id,
 CAST((vec_id * 37) % 640 AS INT) AS bbox_x, CAST((vec_id * 53) % 480 AS INT) AS bbox_y,
 CAST(20 + (vec_id * 7) % 200 AS INT) AS bbox_w, CAST(20 + (vec_id * 11) % 200 AS INT) AS bbox_h,
 embedding,
 CAST(8000 + (vec_id * 7919) % 2000 AS DOUBLE) / CAST(10000 AS DOUBLE) AS detection_confidence,
 CASE WHEN vec_id % 17 = 0 OR vec_id % 5 = 0 THEN NULL ELSE CAST(label + 1 AS BIGINT) END AS cluster_id,
 CASE WHEN vec_id % 17 = 0 THEN 1 ELSE 0 END AS dismissed
FROM {embeddings}"""
PHOTOS_SQL = """
SELECT doc_id AS id,
 concat('/photos/', source, '/', CAST(doc_id AS STRING), '/IMG_', CAST(doc_id % 7 AS STRING), '.jpg') AS path,
 n_chars AS file_size, CAST(640 + (doc_id * 131) % 6000 AS INT) AS width, CAST(480 + (doc_id * 97) % 5000 AS INT) AS height,
 'JPEG' AS format,
 CASE WHEN doc_id % 9 = 0 THEN NULL ELSE concat(CAST(2019 + doc_id % 5 AS STRING), '-',
   lpad(CAST(1 + doc_id % 12 AS STRING),2,'0'), '-', lpad(CAST(1 + doc_id % 28 AS STRING),2,'0'), 'T',
   lpad(CAST(doc_id % 24 AS STRING),2,'0'), ':', lpad(CAST(doc_id % 60 AS STRING),2,'0'), ':00') END AS exif_date
FROM {documents}"""
CLUSTERS_SQL = """
SELECT CAST(id AS BIGINT) AS id, name FROM (VALUES (1,'Alice'),(2,'Bob'),(3,'maybe Alice'),(4,'Person_004'),(5,'Person_005'),
 (6,'Carol/Ann'),(7,'maybe Bob'),(8,'Person_008x'),(9,'Person_1234'),(10,' Dan. '),(11,'Person_003')) AS t(id, name)"""

#: The views as common table expressions, for the oracle.
CTES = {"faces": FACES_SQL.format(embeddings="embeddings"), "photos": PHOTOS_SQL.format(documents="documents"), "clusters": CLUSTERS_SQL}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog.of(
        spark,
        faces=spark.sql(FACES_SQL, embeddings=table(spark, sf_dir, "embeddings")),
        photos=spark.sql(PHOTOS_SQL, documents=table(spark, sf_dir, "documents")),
        clusters=spark.sql(CLUSTERS_SQL),
    )


def files_on_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, mtime): photos with the time of the event of the same number."""
    events = table(spark, sf_dir, "events").selectExpr("event_id as id", "ts as mtime")
    return catalog(spark, sf_dir).photos.select("id", "path").join(events, "id").select("path", "mtime")
