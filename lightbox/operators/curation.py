"""Curation: each action takes a catalog and returns another one, with what it did.

Checks come first and raise ``ActionError`` with an HTTP-like status; all changes are column
expressions and joins, evaluated when the result is read or saved."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.names import is_user_defined, sanitize
from . import clustering


class ActionError(Exception):
    def __init__(self, message: str, status: int = 400):
        super().__init__(message)
        self.status = status


def _now():
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd HH:mm:ss")


def _exists(df: DataFrame, id_: int) -> bool:
    return df.where(F.col("id") == id_).limit(1).count() > 0


def _known(df: DataFrame, what: str, *ids: int) -> None:
    """Raises for ids that the table doesn't have."""
    there = {r["id"] for r in df.where(F.col("id").isin(*ids)).select("id").collect()}
    if missing := [str(i) for i in ids if i not in there]:
        raise ActionError(f"no {what} {' or '.join(missing)}", 404)


def require_int(value, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, (int, str)):
        raise ActionError(f"{name} must be an integer")
    try:
        return int(value)
    except ValueError as e:
        raise ActionError(f"{name} must be an integer") from e


def _set(df: DataFrame, column: str, when, value) -> DataFrame:
    return df.withColumn(column, F.when(when, value).otherwise(F.col(column)))


def assign_face(c: Catalog, face_id: int, cluster_id: int | None) -> Catalog:
    return c.to(faces=_set(c.faces, "cluster_id", F.col("id") == face_id, F.lit(cluster_id).cast("long")))


def assign_faces(c: Catalog, moves: DataFrame) -> Catalog:
    """``moves``: (face_id, new_cluster_id); null unassigns."""
    return clustering.with_assignments(c, moves)


def clear_clusters(c: Catalog) -> Catalog:
    return c.to(faces=c.faces.withColumn("cluster_id", F.lit(None).cast("long")), clusters=c.clusters.where(F.lit(False)))


def rename(c: Catalog, cluster_id: int, name: str) -> Catalog:
    """The name as given; names need not be unique."""
    hit = F.col("id") == cluster_id
    return c.to(clusters=_set(_set(c.clusters, "name", hit, F.lit(name)), "updated_at", hit, _now()))


def merge(c: Catalog, keep: int, source: int) -> Catalog:
    """All faces of ``source``, dismissed ones too, go to ``keep``; ``source`` goes."""
    clusters = c.clusters.where(F.col("id") != source)
    return c.to(faces=_set(c.faces, "cluster_id", F.col("cluster_id") == source, F.lit(keep).cast("long")), clusters=_set(clusters, "updated_at", F.col("id") == keep, _now()))


def merge_people(c: Catalog, keep: int, source: int) -> Catalog:
    if keep == source:
        raise ActionError(f"{keep} is both sides of the merge")
    _known(c.clusters, "cluster", keep, source)
    return merge(c, keep, source)


def merge_many(c: Catalog, target: int, sources: Iterable[int]) -> Catalog:
    for source in sources:
        if source != target:
            c = merge_people(c, target, source)
    return c


def split_face(c: Catalog, face_id: int, name: str = "") -> tuple[Catalog, dict]:
    """One face to a new cluster; a dismissed one stays dismissed."""
    _known(c.faces, "face", face_id)
    own = {"cluster_id": clustering.next_id(c.clusters), "name": sanitize(name) if name.strip() else f"Split_{face_id}"}
    row = c.faces.sparkSession.createDataFrame([tuple(own.values())], "id long, name string")
    return assign_face(clustering.with_clusters(c, row), face_id, own["cluster_id"]), own


def split_faces(c: Catalog, face_ids: list[int], base: str = "", eps: float = clustering.EPS) -> tuple[Catalog, dict]:
    if not face_ids:
        raise ActionError("no faces were named")
    name = sanitize(base) if base.strip() else "Split"
    state, made = clustering.split_by_similarity(c, face_ids, name, eps)
    return state, {"cluster_ids": made}


def dismiss_face(c: Catalog, face_id: int) -> Catalog:
    _known(c.faces, "face", face_id)
    hit = F.col("id") == face_id
    return c.to(faces=_set(_set(c.faces, "cluster_id", hit, F.lit(None).cast("long")), "dismissed", hit, F.lit(1)))


def restore_face(c: Catalog, face_id: int) -> Catalog:
    """Not dismissed any more; it stays unassigned."""
    _known(c.faces, "face", face_id)
    return c.to(faces=_set(c.faces, "dismissed", F.col("id") == face_id, F.lit(0)))


def dismiss_cluster(c: Catalog, cluster_id: int) -> tuple[Catalog, int]:
    """All its faces dismissed, the cluster deleted; also the number of faces."""
    _known(c.clusters, "cluster", cluster_id)
    hit = F.coalesce(F.col("cluster_id") == cluster_id, F.lit(False))
    n = c.faces.where(hit).count()
    faces = c.faces.withColumns({"dismissed": F.when(hit, 1).otherwise(F.col("dismissed")), "cluster_id": F.when(hit, F.lit(None).cast("long")).otherwise(F.col("cluster_id"))})
    return c.to(faces=faces, clusters=c.clusters.where(F.col("id") != cluster_id)), n


def dismiss_many(c: Catalog, cluster_ids: Iterable[int]) -> tuple[Catalog, int]:
    total = 0
    for i in cluster_ids:
        c, n = dismiss_cluster(c, i)
        total += n
    return c, total


def move_face(c: Catalog, face_id: int, cluster_id: int) -> Catalog:
    _known(c.faces, "face", face_id)
    _known(c.clusters, "cluster", cluster_id)
    return assign_face(c, face_id, cluster_id)


def move_faces(c: Catalog, face_ids: list[int], cluster_id: int) -> tuple[Catalog, int]:
    """The cluster must exist; ids of faces aren't checked, and all count as moved."""
    if not face_ids:
        raise ActionError("no faces were named")
    _known(c.clusters, "cluster", cluster_id)
    return c.to(faces=_set(c.faces, "cluster_id", F.col("id").isin(face_ids), F.lit(cluster_id).cast("long"))), len(face_ids)


def delete_photo(c: Catalog, photo_id: int, remove=None) -> Catalog:
    """The photo and its faces go. ``remove(path)`` deletes the file first: it may find none, and an
    OSError keeps the catalog as it is (status 409). Duplicate groups stay until detected anew."""
    row = c.photos.where(F.col("id") == photo_id).select("path").first()
    if row is None:
        raise ActionError("photo not found", 404)
    if remove is not None:
        try:
            remove(row["path"])
        except FileNotFoundError:
            pass
        except OSError as e:
            raise ActionError(f"could not delete file: {e}", 409) from e
    return drop_photos(c, c.photos.sparkSession.createDataFrame([(photo_id,)], "id long"))


def drop_photos(c: Catalog, ids: DataFrame) -> Catalog:
    """Photos in ``ids`` (id) and, as a cascade, their faces."""
    return c.to(photos=c.photos.join(ids, "id", "left_anti"), faces=c.faces.join(ids.withColumnRenamed("id", "photo_id"), "photo_id", "left_anti").select(*c.faces.columns))


def assign_duplicate_groups(c: Catalog, groups: DataFrame) -> Catalog:
    """``groups``: (photo_id, group_id)."""
    g = groups.select(F.col("photo_id").alias("id"), "group_id", F.lit(True).alias("listed"))
    photos = c.photos.join(g, "id", "left").withColumn("duplicate_group_id", F.when(F.col("listed"), F.col("group_id")).otherwise(F.col("duplicate_group_id")))
    return c.to(photos=photos.select(*c.photos.columns))


def recluster_person(c: Catalog, cluster_id: int, eps: float = clustering.EPS, min_samples: int = clustering.MIN_SAMPLES) -> tuple[Catalog, dict]:
    try:
        return clustering.recluster(c, cluster_id, eps, min_samples)
    except KeyError as e:
        raise ActionError(str(e), 404) from e


def absorb(c: Catalog, cluster_id: int, name: str, eps: float = clustering.EPS) -> tuple[Catalog, dict]:
    """Unassigned faces near the cluster join it, and clusters named ``maybe <name>`` merge into it."""
    near = clustering.absorbed(c, cluster_id, eps)
    n = near.count()
    tentative = (F.col("name") == f"maybe {name}") & (F.col("id") != cluster_id)
    sources = c.clusters.where(tentative).select(F.col("id").alias("cluster_id"), F.lit(True).alias("merged"))
    m = sources.count()
    state = clustering.with_assignments(c, near.select(F.col("id").alias("face_id"), F.lit(cluster_id).cast("long").alias("new_cluster_id"))) if n else c
    if m:
        faces = state.faces.join(sources, "cluster_id", "left").withColumn("cluster_id", F.when(F.col("merged"), F.lit(cluster_id).cast("long")).otherwise(F.col("cluster_id")))
        clusters = state.clusters.where(~tentative)
        state = state.to(faces=faces.select(*c.faces.columns), clusters=_set(clusters, "updated_at", F.col("id") == cluster_id, _now()))
    return state, {"absorbed_faces": n, "merged_clusters": m}


def rename_person_full(c: Catalog, cluster_id: int, new_name: str) -> tuple[Catalog, dict | None]:
    """Sanitised name; a user's name also absorbs. None if there is no such cluster."""
    name = sanitize(new_name)
    if not _exists(c.clusters, cluster_id):
        return c, None
    state, result = rename(c, cluster_id, name), {"name": name}
    if is_user_defined(name):
        state, more = absorb(state, cluster_id, name)
        result |= more
    return state, result


def rename_person(c: Catalog, cluster_id: int, new_name: str) -> tuple[Catalog, bool]:
    state, result = rename_person_full(c, cluster_id, new_name)
    return state, result is not None
