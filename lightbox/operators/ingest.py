"""Ingestion: which files are new or changed, per-photo analysis, storing with counters, and the scan of a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import islice
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .. import schema
from ..catalog import Catalog
from ..functions.geometry import large_enough, rescaled
from ..functions.hashes import phash64
from ..functions.media import described
from ..functions.times import exif_iso, is_stale
from ..plans.materialize import remove, run_dir, written
from ..sources import files as sources
from ..sources.pictures import pictures
from .curation import drop_photos

#: Photos that a job reads and stores together, so that a scan that breaks off loses no more than these.
COMMIT = 2_000
CONFIDENCE = 0.9

PHOTO = "path string, file_size long, width int, height int, format string, exif_text string, phash string, error string"
BOX = "x double, y double, w double, h double, score double, embedding array<float>"
ANALYSED = f"{PHOTO}, scale double, boxes array<struct<{BOX.replace(' ', ':').replace(',:', ',')}>>"


class Analyser(Protocol):
    """What looks at pixels: for a file's path and bytes a dict with the fields of ANALYSED (boxes in the
    coordinates of the downscaled picture). Made once in each task by its factory. None as a factory asks for what files' headers say, of which only the first bytes are read."""

    def __call__(self, path: str, content: bytes) -> dict: ...


class Detector(Protocol):
    """Finds objects in a picture (rows, columns, channels as bytes): dicts with x, y, w, h, score and, if it knows them, landmarks."""

    def __call__(self, pixels: np.ndarray) -> list[dict]: ...


class Embedder(Protocol):
    """The vector of an object's picture, cut out and aligned."""

    def __call__(self, pixels: np.ndarray) -> np.ndarray: ...


def headers() -> Analyser:
    """An analyser that reads headers only and looks for no objects: models aren't part of this package."""
    return lambda path, content: {"file_size": len(content), "scale": 1.0, "boxes": []} | described(content)


def object_table(detector: Callable[[], Detector], embedder: Callable[[], Embedder]):
    """A table function (height, width, channels, data) -> rows (x, y, w, h, score, embedding) of a picture's objects,
    for lateral joins with rows of Spark's image source. Both models are made once a worker; of boxes that overlap much the
    surest stays; a picture that can't be read has no rows."""
    from ..functions import pixels

    @udtf(returnType=BOX)
    class Objects:
        def __init__(self):
            self.detect, self.embed = detector(), embedder()

        def eval(self, height: int, width: int, channels: int, data: bytes):
            if data is None or len(data) != height * width * channels:
                return
            image, factor = pixels.downscaled(np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels))
            found = self.detect(image)
            if not found:
                return
            boxes, scores = np.array([[f[k] for k in "xywh"] for f in found], dtype=float), np.array([f["score"] for f in found], dtype=float)
            for k in pixels.suppressed(boxes, scores):
                x, y, w, h = boxes[k]
                marks = found[k].get("landmarks")
                part = pixels.aligned(image, np.asarray(marks)) if marks is not None else image[max(0, int(y)) : int(y + h), max(0, int(x)) : int(x + w)]
                vector = np.asarray(self.embed(part), dtype=float)
                yield float(x / factor), float(y / factor), float(w / factor), float(h / factor), float(scores[k]), [float(v) for v in vector]

    return Objects


def stale_files(files: DataFrame, photos: DataFrame) -> DataFrame:
    """Files (path, mtime) that the catalog doesn't have or that changed since their scan."""
    known = photos.select(F.col("path"), "scanned_at", F.lit(True).alias("known"))
    return files.join(known, "path", "left").where(F.col("known").isNull() | is_stale(F.col("mtime"), F.col("scanned_at"))).select("path", "mtime")


def analyse(files: DataFrame, factory: Callable[[], Analyser]) -> DataFrame:
    """ANALYSED for each file (path, content); a file that fails has its error and is never stored."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyser = factory()
        names = [f.split()[0] for f in PHOTO.split(", ")] + ["scale", "boxes"]
        for pdf in frames:
            out = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                row = dict.fromkeys(names) | {"path": path, "boxes": []}
                try:
                    row |= analyser(path, bytes(content))
                except Exception as e:  # noqa: BLE001  one bad file must not end a scan
                    row |= {"error": f"{type(e).__name__}: {e}", "boxes": []}
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return files.select("path", "content").mapInPandas(run, ANALYSED)


def analyse_files(files: DataFrame, factory: Callable[[], Analyser] | None = None) -> DataFrame:
    """ANALYSED for each file (path), which its task opens itself; a file that fails or went has its error."""
    from ..sources.pictures import Store

    names = [f.split()[0] for f in PHOTO.split(", ")] + ["scale", "boxes"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        analyser = None if factory is None else factory()
        for pdf in frames:
            out = []
            for path in pdf["path"]:
                row = dict.fromkeys(names) | {"path": path, "scale": 1.0, "boxes": []}
                try:
                    disk = Store(path)
                    size = disk.size(disk.root)
                    row |= {"file_size": size}
                    row |= disk.header(disk.root) if analyser is None else analyser(path, disk.range(disk.root, 0, size))
                except Exception as e:  # noqa: BLE001  one bad file must not end a scan
                    row |= {"error": f"{type(e).__name__}: {e}", "boxes": []}
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    return files.select("path").mapInPandas(run, ANALYSED)


def store(catalog: Catalog, analysed: DataFrame, scanned_at: str | None = None, confidence: float = CONFIDENCE, min_face: int | None = None) -> Catalog:
    """Photos of the same path go with their faces; new rows get new ids in order of path and box. Without ``scanned_at`` each
    row of ``analysed`` has its own."""
    good = analysed.where("error is null")
    again = catalog.photos.join(good.select("path").distinct(), "path", "left_semi").select("id")
    kept = drop_photos(catalog, again)
    first_photo, first_face = ((df.agg(F.max("id")).first()[0] or 0) + 1 for df in (catalog.photos, catalog.faces))
    factor = F.coalesce("scale", F.lit(1.0))
    photos = numbered(good, ["path"], first_photo)
    boxes = photos.select("id", factor.alias("factor"), F.posexplode("boxes").alias("k", "box"))
    size = {"bbox_w": (F.col("box.w") / F.col("factor")).cast("int"), "bbox_h": (F.col("box.h") / F.col("factor")).cast("int")}
    found = boxes.select(
        F.col("id").alias("photo_id"), "k", rescaled(F.col("box.x"), F.col("factor")).alias("bbox_x"), rescaled(F.col("box.y"), F.col("factor")).alias("bbox_y"),
        *(v.alias(n) for n, v in size.items()), F.col("box.embedding").alias("embedding"), F.col("box.score").alias("detection_confidence"),
    ).where((F.col("detection_confidence") >= confidence) & (large_enough(F.col("bbox_w"), F.col("bbox_h")) if min_face is None else large_enough(F.col("bbox_w"), F.col("bbox_h"), min_face)))
    faces = numbered(found, ["photo_id", "k"], first_face).withColumn("dismissed", F.lit(0))
    counts = found.groupBy(F.col("photo_id").alias("id")).agg(F.count(F.lit(1)).cast("int").alias("num_faces"))
    rows = photos.join(counts, "id", "left").withColumns({"num_faces": F.coalesce("num_faces", F.lit(0)), "scanned_at": F.col("scanned_at") if scanned_at is None else F.lit(scanned_at), "exif_date": exif_iso(F.col("exif_text"))})
    return kept.to(photos=kept.photos.select(*schema.PHOTOS.names).unionByName(schema.conform(rows, schema.PHOTOS)), faces=kept.faces.select(*schema.FACES.names).unionByName(schema.conform(faces, schema.FACES)))


def numbered(df: DataFrame, keys: list[str], first: int) -> DataFrame:
    """Adds ``id``: first, first + 1, ... in the order of ``keys``, without moving all rows to one task:
    rows are range-partitioned and numbered within, and offsets come from the partitions' counts."""
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    held = written(ranged.withColumn("at", F.monotonically_increasing_id()), "numbered")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).select("part", "offset")  # one row a partition
    within = F.row_number().over(Window.partitionBy("part").orderBy(*keys, "at"))
    return held.join(offsets, "part").withColumn("id", (within + F.col("offset") + (first - 1)).cast("long")).drop("part", "offset", "at")


def scan_counts(files: DataFrame, stale: DataFrame, analysed: DataFrame) -> dict[str, int]:
    """total, skipped, processed, errors, faces_found of a scan."""
    total, todo = files.count(), stale.count()
    row = analysed.agg(F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull()), F.coalesce(F.sum(F.size("boxes")), F.lit(0))).first()
    return {"total": total, "skipped": total - todo, "processed": row[0], "errors": row[1], "faces_found": row[2]}


def unhashed(photos: DataFrame) -> DataFrame:
    """(id, path) of the photos without a hash: the work list of a backfill."""
    return photos.where("phash is null").select("id", "path")


def backfill_hashes(catalog: Catalog, hashes: DataFrame) -> Catalog:
    """Fills missing hashes from ``hashes`` (path, phash); hashes that are there stay."""
    new = hashes.where("phash is not null").groupBy("path").agg(F.first("phash").alias("new_phash"))
    photos = catalog.photos.join(new, "path", "left").withColumn("phash", F.coalesce("phash", "new_phash"))
    return catalog.to(photos=photos.select(*catalog.photos.columns))


def in_commits(paths: DataFrame, size: int = COMMIT) -> Iterator[list[str]]:
    """The paths in order, so many at a time; the driver holds one lot (and a partition of the sorted list)."""
    rows = paths.select("path").orderBy("path").toLocalIterator()
    while lot := [r["path"] for r in islice(rows, size)]:
        yield lot


def hashes_of(spark, paths: list[str]) -> DataFrame:
    """(path, phash) of picture files; null where they can't be decoded."""
    return sources.pixels(spark, paths).select("path", phash64("height", "width", "channels", "data").alias("phash"))


def still_there(spark, paths: list[str]) -> list[str]:
    """Those of a lot's paths that are pictures, as tasks see them."""
    some = spark.createDataFrame([(p,) for p in paths], "path string").repartition(min(len(paths), spark.sparkContext.defaultParallelism))
    return [r["path"] for r in analyse_files(some).where("error is null").select("path").collect()]


def fold_journal(catalog: Catalog, journal: str, confidence: float = CONFIDENCE, min_face: int | None = None) -> Catalog:
    """The catalog with all lots of a journal stored at once; of a path that is there twice the last scan counts."""
    spark = catalog.photos.sparkSession
    if not sources.readable(spark, [journal]):
        return catalog
    lots = spark.read.schema(f"{ANALYSED}, scanned_at string, lot long").parquet(f"{journal}/lot-*")
    once = lots.groupBy("path").agg(F.max_by(F.struct(*lots.drop("lot").columns), F.struct("scanned_at", "lot")).alias("row")).select("row.*")
    return store(catalog, written(once, "journal"), None, confidence, min_face).settled()


def write_lot(spark, journal: str, number: int, paths: DataFrame, scanned_at: str, factory: Callable[[], Analyser] | None = None, hashed: bool = True) -> tuple[int, int]:
    """Analyses files (path) and writes them whole as a lot of the journal, over what a broken attempt left; (pictures stored, their boxes). ``hashed``: with
    hashes of the pictures that can be read, whose paths the driver holds, a lot's."""
    found = analyse_files(paths, factory).withColumns({"scanned_at": F.lit(scanned_at), "lot": F.lit(number).cast("long")})
    if hashed:
        found = written(found, "analysed")
        good = [r["path"] for r in found.where("error is null").select("path").collect()]
        if good:
            found = found.drop("phash").join(hashes_of(spark, good), "path", "left").select(*found.columns)
    path = f"{journal}/lot-{number:08d}"
    found.write.mode("overwrite").parquet(path)
    return tuple(spark.read.schema(found.schema).parquet(path).agg(F.count_if(F.col("error").isNull()), F.coalesce(F.sum(F.size("boxes")), F.lit(0))).first())


def scan(
    catalog: Catalog, folder: str, scanned_at: str, factory: Callable[[], Analyser] | None = None, recursive: bool = True, commit: int = COMMIT, save: Callable[[Catalog], Catalog] | None = None,
    on_progress: Callable[..., None] | None = None, stop: Callable[[], bool] | None = None, confidence: float = CONFIDENCE, min_face: int | None = None, journal: str | None = None,
) -> tuple[Catalog, dict[str, int]]:
    """All new or changed pictures of ``folder`` in the catalog, with size, time taken, hash and objects; (catalog, counts).

    Files are listed first, each folder by a task; only stale ones are read, ``commit`` of them by a job. Each lot is written whole to ``journal`` (a folder;
    by default one for this run), and at the end, or when it is stopped, all lots are stored at once and passed to ``save``, so the work of a lot doesn't
    grow with the catalog. Lots that a scan which broke off has left in ``journal`` are stored first. A file that can't be read counts as
    an error and is tried again by the next scan."""
    spark = catalog.photos.sparkSession
    save = save or (lambda c: c)
    journal = journal or f"{run_dir(spark)}/journal-{uuid.uuid4().hex}"
    if sources.readable(spark, [journal]):
        catalog = save(fold_journal(catalog, journal, confidence, min_face))
        remove(spark, journal)
    listed = written(pictures(spark, folder, recursive, headers=False), "listed")
    stale = written(stale_files(listed.select("path", "mtime"), catalog.photos), "stale")
    total, todo = listed.count(), stale.count()
    counts = {"total": total, "skipped": total - todo, "processed": 0, "errors": 0, "faces_found": 0}
    for number, lot in enumerate(in_commits(stale, commit)):
        if stop is not None and stop():
            break
        good, boxes = write_lot(spark, journal, number, spark.createDataFrame([(p,) for p in lot], "path string").repartition(min(len(lot), spark.sparkContext.defaultParallelism)), scanned_at, factory)
        counts |= {"processed": counts["processed"] + good, "errors": counts["errors"] + len(lot) - good, "faces_found": counts["faces_found"] + boxes}
        if on_progress:
            on_progress(**counts)
    if counts["processed"]:
        catalog = save(fold_journal(catalog, journal, confidence, min_face))
    remove(spark, journal)
    return catalog, counts


def backfill(catalog: Catalog, commit: int = COMMIT, save: Callable[[Catalog], Catalog] | None = None, on_progress: Callable[[int, int], None] | None = None, stop: Callable[[], bool] | None = None) -> tuple[Catalog, int]:
    """Hashes for photos without one, from their files, so many at a time; (catalog, photos that got one). Lots are
    written as they come and stored at once at the end, or when it is stopped."""
    spark = catalog.photos.sparkSession
    work = written(unhashed(catalog.photos), "unhashed")
    total, seen, updated = work.count(), 0, 0
    lots = f"{run_dir(spark)}/hashes-{uuid.uuid4().hex}"
    for number, lot in enumerate(in_commits(work, commit)):
        if stop is not None and stop():
            break
        if there := still_there(spark, lot):
            path = f"{lots}/lot-{number:08d}"
            hashes_of(spark, there).where("phash is not null").write.parquet(path)
            updated += spark.read.schema("path string, phash string").parquet(path).count()
        seen += len(lot)
        if on_progress:
            on_progress(seen, total)
    if updated:
        found = spark.read.schema("path string, phash string").parquet(f"{lots}/lot-*")
        catalog = (save or (lambda c: c))(backfill_hashes(catalog, found).settled())
    return catalog, updated
