"""Density clustering of vectors, incremental assignment, tightening and splitting of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.names import auto_name, auto_number, user_defined
from ..functions.vectors import mean_vectors
from ..plans.materialize import written
from . import density, linkage
from .neighbors import nearest_centroid

# Defaults of the catalog's tools.
EPS, MIN_SAMPLES = 0.55, 3


def dbscan(vectors: DataFrame, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, label, is_core) of ``vectors`` (id, embedding); noise has label -1; distance is cosine, eps inclusive."""
    return density.dbscan(vectors, eps, min_samples)


def centroids(catalog: Catalog) -> DataFrame:
    """(cluster_id, centroid) of each cluster with active faces: the mean of stored vectors, unit length."""
    return mean_vectors(catalog.active.where("cluster_id is not null"), "cluster_id")


def unassigned(catalog: Catalog) -> DataFrame:
    return catalog.active.where("cluster_id is null").select("id", "embedding")


def highest_auto(catalog: Catalog) -> int:
    """The highest automatic number in use or given before; numbers are never given twice."""
    return max(catalog.last_auto, catalog.clusters.agg(F.max(auto_number(F.col("name")))).first()[0] or 0)


def next_id(df: DataFrame) -> int:
    return (df.agg(F.max("id")).first()[0] or 0) + 1


def with_assignments(catalog: Catalog, new: DataFrame) -> Catalog:
    """Faces listed in ``new`` (face_id, new_cluster_id) get that cluster; null is a legal new value, so a
    flag says who is listed."""
    listed = new.select(F.col("face_id").alias("id"), "new_cluster_id", F.lit(True).alias("listed"))
    faces = catalog.faces.join(listed, "id", "left").withColumn("cluster_id", F.when(F.col("listed"), F.col("new_cluster_id")).otherwise(F.col("cluster_id")))
    return catalog.to(faces=faces.select(*catalog.faces.columns))


def with_clusters(catalog: Catalog, new: DataFrame) -> Catalog:
    """Adds clusters (id, name)."""
    full = new.select("id", "name", F.lit(None).cast("long").alias("representative_face_id"), F.lit(None).cast("string").alias("created_at"), F.lit(None).cast("string").alias("updated_at"))
    return catalog.to(clusters=catalog.clusters.unionByName(full))


def full_clustering(catalog: Catalog, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> tuple[Catalog, int]:
    """All active faces clustered anew; (catalog, number of clusters). Old clusters go, named ones too.
    Without active faces nothing changes."""
    vectors = catalog.active.select("id", "embedding")
    if not vectors.limit(1).count():
        return catalog, 0
    labels = written(dbscan(vectors, eps, min_samples), "labels")
    numbers = labels.where("label >= 0").select("label").distinct()
    start = next_id(catalog.clusters)
    n = numbers.count()
    named = numbers.select((F.col("label") + start).cast("long").alias("id"), auto_name(F.col("label") + 1).alias("name"))
    cleared = catalog.to(faces=catalog.faces.withColumn("cluster_id", F.lit(None).cast("long")), clusters=catalog.clusters.where(F.lit(False)))
    new = labels.select(F.col("id").alias("face_id"), F.when(F.col("label") >= 0, (F.col("label") + start).cast("long")).alias("new_cluster_id"))
    return with_assignments(with_clusters(cleared, named), new).to(last_auto=max(catalog.last_auto, n)), n


def incremental_plan(catalog: Catalog, eps: float = EPS, min_samples: int = MIN_SAMPLES, density_eps: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(matched (id, cluster_id, dist), labels (id, label, is_core) of what is left). Clusters of the rest
    have the radius ``density_eps``, by default eps too."""
    rest = unassigned(catalog)
    near = written(nearest_centroid(rest, centroids(catalog)).where(F.col("dist") <= eps), "matched")
    return near, written(dbscan(rest.join(near.select("id"), "id", "left_anti"), eps if density_eps is None else density_eps, min_samples), "labels")


def tentative_names(catalog: Catalog, labels: DataFrame, maybe_eps: float | None) -> DataFrame:
    """(label, name): for each new cluster ``maybe <name>`` of the nearest named cluster within maybe_eps,
    else null. Named clusters are those with a user's name and active faces."""
    numbers = labels.where("label >= 0").select("label").distinct()
    if maybe_eps is None:
        return numbers.withColumn("name", F.lit(None).cast("string"))
    named = catalog.clusters.where(user_defined(F.col("name"))).select(F.col("id").alias("cluster_id"), "name")
    known = centroids(catalog).join(named.select("cluster_id"), "cluster_id", "left_semi")
    members = catalog.faces.join(labels.where("label >= 0").select("id", "label"), "id").select("label", "embedding")
    units = members.select("label", F.col("embedding"))
    means = mean_vectors(_units(units), "label", "unit").select(F.col("label").cast("long").alias("id"), F.col("centroid").cast("array<float>").alias("embedding"))
    near = nearest_centroid(means, known).where(F.col("dist") <= maybe_eps).join(named, "cluster_id")
    return numbers.join(near.select(F.col("id").cast("int").alias("label"), F.concat(F.lit("maybe "), "name").alias("name")), "label", "left")


def _units(df: DataFrame) -> DataFrame:
    from ..functions.vectors import normalized

    return df.select("label", normalized(F.col("embedding")).alias("unit"))


def incremental_clustering(catalog: Catalog, eps: float = EPS, min_samples: int = MIN_SAMPLES, maybe_eps: float | None = None, density_eps: float | None = None) -> tuple[Catalog, dict[str, int]]:
    """Unassigned faces go to the nearest existing cluster within eps; the rest is clustered; new clusters
    near a named one get a tentative name."""
    counts = {"assigned": 0, "new_clusters": 0, "maybe_clusters": 0, "new_noise": 0}
    if not unassigned(catalog).limit(1).count():
        return catalog, counts
    matched, labels = incremental_plan(catalog, eps, min_samples, density_eps)
    base, first = highest_auto(catalog), next_id(catalog.clusters)
    named = tentative_names(catalog, labels, maybe_eps)
    autos = F.sum(F.col("name").isNull().cast("int")).over(Window.orderBy("label").rowsBetween(Window.unboundedPreceding, 0))  # one row a new cluster
    new = written(named.select("label", (F.col("label") + first).cast("long").alias("id"), F.coalesce("name", auto_name(autos + base)).alias("name"), F.col("name").isNotNull().alias("maybe")), "new-clusters")
    moves = matched.select(F.col("id").alias("face_id"), F.col("cluster_id").alias("new_cluster_id")).unionByName(
        labels.select(F.col("id").alias("face_id"), F.when(F.col("label") >= 0, (F.col("label") + first).cast("long")).alias("new_cluster_id"))
    )
    n = new.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("maybe").cast("int")), F.lit(0))).first()
    counts = {"assigned": matched.count(), "new_clusters": n[0], "maybe_clusters": n[1], "new_noise": labels.where("label = -1").count()}
    return with_assignments(with_clusters(catalog, new.select("id", "name")), moves).to(last_auto=base + n[0] - n[1]), counts


def recluster_labels(catalog: Catalog, cluster_id: int, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """(id, label) of the cluster's active faces, groups under min_samples as -1."""
    raw = linkage.average_linkage(catalog.active.where(F.col("cluster_id") == cluster_id).select("id", "embedding"), eps)
    n = F.count(F.lit(1)).over(Window.partitionBy("label"))
    return raw.select("id", F.when(n < min_samples, F.lit(-1)).otherwise(F.col("label")).alias("label"))


def recluster(catalog: Catalog, cluster_id: int, eps: float = EPS, min_samples: int = MIN_SAMPLES) -> tuple[Catalog, dict[str, int]]:
    """A cluster split into tighter ones. The largest keeps the id (of equal ones the first), others get
    automatic names, faces of small groups become unassigned. Raises KeyError for a missing cluster; a
    single face is left as it is."""
    if not catalog.clusters.where(F.col("id") == cluster_id).count():
        raise KeyError(f"cluster {cluster_id} not found")
    labels = written(recluster_labels(catalog, cluster_id, eps, min_samples), "labels")
    groups = {r["label"]: r["count"] for r in labels.groupBy("label").count().collect()}  # at most a cluster's faces / min_samples rows
    total, noise = sum(groups.values()), groups.pop(-1, 0)
    if total <= 1 or (len(groups) <= 1 and not noise):
        return catalog, {"original_faces": total, "new_clusters": 0, "noise": 0}
    keep = max(groups, key=lambda k: (groups[k], -k)) if groups else None
    base, first = highest_auto(catalog), next_id(catalog.clusters)
    fresh = {label: (first + i, f"Person_{base + 1 + i:03d}") for i, label in enumerate(sorted(k for k in groups if k != keep))}
    spark = catalog.faces.sparkSession
    ids = spark.createDataFrame([(k, cluster_id if k == keep else fresh[k][0]) for k in groups], "label int, new_cluster_id long")
    moves = labels.join(F.broadcast(ids), "label", "left").select(F.col("id").alias("face_id"), "new_cluster_id")
    state = with_clusters(catalog, spark.createDataFrame(list(fresh.values()), "id long, name string")) if fresh else catalog
    return with_assignments(state, moves).to(last_auto=base + len(fresh)), {"original_faces": total, "new_clusters": max(0, len(groups) - 1), "noise": noise}


def split_by_similarity(catalog: Catalog, face_ids: list[int], base: str, eps: float = EPS) -> tuple[Catalog, list[int]]:
    """Active faces of the list go to one new cluster for each group of similar ones, named ``base``, or
    ``base 1``, ``base 2`` ... if there are several; dismissed faces are left out."""
    chosen = catalog.active.where(F.col("id").isin(face_ids)).select("id", "embedding")
    labels = written(linkage.average_linkage(chosen, eps), "labels")
    n = labels.select("label").distinct().count()
    if not n:
        return catalog, []
    first = next_id(catalog.clusters)
    names = [(first + i, base if n == 1 else f"{base} {i + 1}") for i in range(n)]
    state = with_clusters(catalog, catalog.faces.sparkSession.createDataFrame(names, "id long, name string"))
    return with_assignments(state, labels.select(F.col("id").alias("face_id"), (F.col("label") + first).cast("long").alias("new_cluster_id"))), [i for i, _ in names]


def absorbed(catalog: Catalog, cluster_id: int, eps: float = EPS) -> DataFrame:
    """(id, dist) of unassigned faces within eps of the cluster's centroid."""
    own = centroids(catalog).where(F.col("cluster_id") == cluster_id)
    return nearest_centroid(unassigned(catalog), own).where(F.col("dist") <= eps).select("id", "dist")
