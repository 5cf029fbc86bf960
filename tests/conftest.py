import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = tmp_path_factory.mktemp("shared")
    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", str(shared)).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def make(spark):
    """make(vectors, clusters=..., ...) -> Catalog with a photo for each face."""
    from lightbox.catalog import Catalog

    def build(faces: list[dict], clusters: list[tuple[int, str]] = (), photos: list[dict] | None = None) -> Catalog:
        rows = [
            (f["id"], f.get("photo_id", f["id"]), 0, 0, f.get("w", 50), f.get("h", 50), [float(x) for x in f.get("v", [1.0, 0.0])], float(f.get("conf", 0.9)), f.get("cluster"), f.get("dismissed", 0))
            for f in faces
        ]
        f = spark.createDataFrame(rows, "id long, photo_id long, bbox_x int, bbox_y int, bbox_w int, bbox_h int, embedding array<float>, detection_confidence double, cluster_id long, dismissed int")
        photos = photos if photos is not None else [{"id": i} for i in sorted({r[1] for r in rows})]
        p = spark.createDataFrame(
            [(x["id"], x.get("path", f"/p/{x['id']}.jpg"), x.get("size", 1), 100, 100, "JPEG", x.get("date"), x.get("phash"), x.get("scanned_at")) for x in photos],
            "id long, path string, file_size long, width int, height int, format string, exif_date string, phash string, scanned_at string",
        )
        return Catalog.of(spark, faces=f, photos=p, clusters=spark.createDataFrame(list(clusters), "id long, name string"))

    return build
