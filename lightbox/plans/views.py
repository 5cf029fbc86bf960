"""Read-only queries over a catalog: counts, people, faces, timelines, duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.names import kind_filter, matches
from ..functions.times import day, year

BOX = ["bbox_x", "bbox_y", "bbox_w", "bbox_h"]
UNCLUSTERED = "Unclustered"


def _best(*partition: str):
    """Faces of a cluster by confidence, the lowest id of equal ones first."""
    return Window.partitionBy(*partition).orderBy(F.col("detection_confidence").desc(), F.col("face_id"))


def _detail(c: Catalog, faces: DataFrame) -> DataFrame:
    f = faces.select(F.col("id").alias("face_id"), "photo_id", *BOX, "detection_confidence", "cluster_id", "dismissed")
    return f.join(c.photos.select(F.col("id").alias("photo_id"), "path", "exif_date"), "photo_id")


def catalog_stats(c: Catalog) -> DataFrame:
    """One row; faces in one pass."""
    count = lambda cond: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")
    faces = c.faces.agg(
        count(F.col("dismissed") == 0).alias("faces"), count((F.col("dismissed") == 0) & F.col("cluster_id").isNull()).alias("unclustered_faces"), count(F.col("dismissed") == 1).alias("dismissed_faces")
    )
    photos, clusters = (df.agg(F.count(F.lit(1)).alias(n)) for df, n in ((c.photos, "photos"), (c.clusters, "clusters")))
    return photos.crossJoin(clusters).crossJoin(faces)  # three rows of one


def clusters_with_counts(c: Catalog) -> DataFrame:
    """(id, name, face_count) with empty clusters, most faces first."""
    counts = c.active.where("cluster_id is not null").groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("face_count"))
    return c.clusters.select("id", "name").join(counts, "id", "left").select("id", "name", F.coalesce("face_count", F.lit(0)).cast("long").alias("face_count")).orderBy(F.col("face_count").desc(), "id")


def cluster_by_id(c: Catalog, cluster_id: int) -> DataFrame:
    faces = c.active.where(F.col("cluster_id") == cluster_id)
    return clusters_with_counts(c.to(clusters=c.clusters.where(F.col("id") == cluster_id), faces=faces))


def top_faces(c: Catalog, k: int) -> DataFrame:
    """The k surest faces of each existing cluster with their photos."""
    own = c.active.join(c.clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    ranked = _detail(c, own).withColumn("rn", F.row_number().over(_best("cluster_id"))).where(F.col("rn") <= k)
    return ranked.select("cluster_id", "rn", "face_id", "photo_id", "path", *BOX, F.col("detection_confidence").alias("confidence"))


def representatives(c: Catalog) -> DataFrame:
    return top_faces(c, 1).drop("rn")


def other_representatives(c: Catalog, cluster_id: int) -> DataFrame:
    """(cluster_id, face_id) of the surest face of every other cluster; needs no photo."""
    own = c.active.where(F.col("cluster_id") != cluster_id).join(c.clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    return own.groupBy("cluster_id").agg(F.max_by("id", F.struct("detection_confidence", -F.col("id"))).alias("face_id"))


def representative(c: Catalog, cluster_id: int, preferred: int | None = None) -> DataFrame:
    """One face: the preferred one if it is the cluster's and active, else the surest."""
    own = _detail(c, c.active.where(F.col("cluster_id") == cluster_id))
    first = (F.col("face_id") == preferred).desc() if preferred is not None else F.lit(0)
    return own.orderBy(first, F.col("detection_confidence").desc(), "face_id").limit(1).select("face_id", "photo_id", "path", *BOX, F.col("detection_confidence").alias("confidence"))


def dashboard(c: Catalog) -> DataFrame:
    """Clusters with counts and their surest face."""
    r = representatives(c).withColumnRenamed("cluster_id", "id")
    return clusters_with_counts(c).join(r, "id", "left").orderBy(F.col("face_count").desc(), "id")


def review_pairs(c: Catalog, per_cluster: int = 20) -> DataFrame:
    """(pair, side, cluster_id, name, rank, face_id): each cluster with the next by size, up to 20 faces of each."""
    ranked = clusters_with_counts(c).withColumn("place", F.row_number().over(Window.orderBy(F.col("face_count").desc(), "id")))  # one row a cluster
    nxt = Window.orderBy("place")
    pairs = ranked.select("place", "id", F.lead("id").over(nxt).alias("next_id")).where("next_id is not null")
    sides = pairs.select(F.col("place").alias("pair"), F.explode(F.array(F.struct(F.lit("left").alias("side"), F.col("id").alias("cluster_id")), F.struct(F.lit("right").alias("side"), F.col("next_id").alias("cluster_id")))).alias("s")).select("pair", "s.side", "s.cluster_id")
    faces = top_faces(c, per_cluster).select("cluster_id", F.col("rn").alias("rank"), "face_id")
    return sides.join(c.clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id").join(faces, "cluster_id", "left").select("pair", "side", "cluster_id", "name", "rank", "face_id")


def faces_for_cluster(c: Catalog, cluster_id: int) -> DataFrame:
    """All its faces, dismissed ones still attached too, surest first."""
    return _detail(c, c.faces.where(F.col("cluster_id") == cluster_id)).select("face_id", "photo_id", "path", *BOX, F.col("detection_confidence").alias("confidence"), "dismissed").orderBy(F.col("confidence").desc(), "face_id")


def face_by_id(c: Catalog, face_id: int) -> DataFrame:
    return _detail(c, c.faces.where(F.col("id") == face_id)).select("face_id", "photo_id", "path", *BOX, F.col("detection_confidence").alias("confidence"), "cluster_id", "dismissed")


def photo_by_id(c: Catalog, photo_id: int) -> DataFrame:
    return c.photos.where(F.col("id") == photo_id).select("id", "path", "file_size", "width", "height", "format", "exif_date")


def faces_in_photo(c: Catalog, path: str) -> DataFrame:
    """All active faces in the photo at ``path``."""
    photo = c.photos.where(F.col("path") == path).select(F.col("id").alias("photo_id"), "path")
    return c.active.join(F.broadcast(photo), "photo_id").select(F.col("id").alias("face_id"), "cluster_id", *BOX)  # paths are unique: one row


def photos_for_cluster(c: Catalog, cluster_id: int) -> DataFrame:
    ids = c.faces.where(F.col("cluster_id") == cluster_id).select(F.col("photo_id").alias("id"))
    return c.photos.join(ids, "id", "left_semi").select("path").distinct().orderBy("path")


def photo_counts(c: Catalog) -> DataFrame:
    """(cluster_id, photos): distinct photos of each existing cluster."""
    attached = c.faces.where("cluster_id is not null").join(c.photos.select(F.col("id").alias("photo_id"), "path"), "photo_id")
    counts = attached.groupBy("cluster_id").agg(F.count_distinct("path").alias("photos"))
    return c.clusters.select(F.col("id").alias("cluster_id")).join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("photos", F.lit(0)).alias("photos"))


def dismissed_faces(c: Catalog) -> DataFrame:
    return _detail(c, c.faces.where("dismissed = 1")).select("face_id", "photo_id", "path", *BOX, F.col("detection_confidence").alias("confidence")).orderBy(F.col("face_id").desc())


# ---------------------------------------------------------------- timelines


def timeline(c: Catalog, query: str = "") -> DataFrame:
    """Active faces of dated photos, newest first, with their cluster's name; ``query`` is a part of a name."""
    rows = _detail(c, c.active).where("exif_date is not null").join(c.clusters.select(F.col("id").alias("cluster_id"), F.col("name").alias("cluster_name")), "cluster_id", "left")
    name = F.when(F.coalesce("cluster_name", F.lit("")) == "", F.lit(UNCLUSTERED)).otherwise(F.col("cluster_name"))
    rows = rows.select(day(F.col("exif_date")).alias("day"), "exif_date", "photo_id", "path", "face_id", *BOX, F.col("detection_confidence").alias("confidence"), "cluster_id", name.alias("cluster_name"))
    return (rows.where(matches(F.col("cluster_name"), query)) if query else rows).orderBy(F.col("exif_date").desc(), F.col("confidence").desc(), "face_id")


def timeline_days(c: Catalog, query: str = "") -> DataFrame:
    """(day, faces): days without a hit don't show."""
    return timeline(c, query).groupBy("day").agg(F.count(F.lit(1)).alias("faces")).orderBy(F.col("day").desc())


def timeline_groups(c: Catalog, query: str = "") -> DataFrame:
    """A row a day with its faces in order."""
    face = F.struct((-F.col("confidence")).alias("order"), "face_id", "photo_id", "cluster_name")
    return timeline(c, query).groupBy("day").agg(F.sort_array(F.collect_list(face)).alias("faces")).orderBy(F.col("day").desc())


def timeline_years(c: Catalog) -> DataFrame:
    """(year) ascending, ``Unknown`` last if there are undated faces."""
    dates = c.active.select(F.col("photo_id").alias("id")).join(c.photos.select("id", "exif_date"), "id")
    return dates.select(F.coalesce(year(F.col("exif_date")), F.lit("Unknown")).alias("year")).distinct().orderBy(F.col("year") == "Unknown", "year")


def _page(c: Catalog, keep) -> DataFrame:
    # the filter on photos comes before the join
    photos = c.photos.where(keep).select(F.col("id").alias("photo_id"), "path", "exif_date")
    return c.active.select(F.col("id").alias("face_id"), "photo_id", *BOX, "detection_confidence").join(photos, "photo_id").select("face_id", *BOX, "path", "exif_date", F.col("detection_confidence").alias("confidence"))


def timeline_year(c: Catalog, year_: str) -> DataFrame:
    return _page(c, F.startswith("exif_date", F.lit(year_))).orderBy("exif_date", "path", "face_id")


def timeline_undated(c: Catalog) -> DataFrame:
    return _page(c, F.col("exif_date").isNull()).orderBy("path", "face_id")


# ---------------------------------------------------------------- people and duplicates

SORTS = {
    "faces-desc": lambda: (F.col("face_count").desc(), F.col("id")), "faces-asc": lambda: (F.col("face_count"), F.col("id")),
    "name-asc": lambda: (F.lower("name"), F.col("id")), "name-desc": lambda: (F.lower("name").desc(), F.col("id")),
}


def people(c: Catalog, kind: str = "all", query: str = "", sort: str = "faces-desc", page: int | None = None, page_size: int = 200) -> DataFrame:
    """Clusters by kind of name and part of name, sorted; a page of them if asked."""
    found = clusters_with_counts(c.to(clusters=c.clusters.where(kind_filter(F.col("name"), kind) & (matches(F.col("name"), query) if query else F.lit(True))))).orderBy(*SORTS[sort]())
    return found if page is None else found.offset(page * page_size).limit(page_size)


def merge_targets(c: Catalog, cluster_id: int) -> DataFrame:
    return clusters_with_counts(c).where(F.col("id") != cluster_id)


def duplicate_groups(c: Catalog) -> DataFrame:
    """(id, photo_count), most photos first; groups without photos don't show."""
    return c.duplicate_groups.select("id").join(c.photos.select(F.col("duplicate_group_id").alias("id"), F.col("id").alias("photo_id")), "id").groupBy("id").agg(F.count("photo_id").alias("photo_count")).orderBy(F.col("photo_count").desc(), "id")


def duplicate_photos(c: Catalog, group_id: int) -> DataFrame:
    return c.photos.where(F.col("duplicate_group_id") == group_id).select("id", "path", "file_size", "width", "height").orderBy(F.col("file_size").desc(), "id")
