"""Export of each entity's pictures to a folder of its own: a plan as a table, then its execution."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import Catalog
from ..functions.names import sanitized
from ..plans.materialize import run_dir, written
from ..sources import folders

#: A name's number before its extension, which a free name adds to.
NUMBERED = r"^(.+)_[0-9]+((?:\.[^.]*)?)$"


def split_name(name: str) -> tuple[str, str]:
    """Stem and extension; a name that starts with its only dot has none."""
    found = re.fullmatch(r"(?s)(.+?)(\.[^.]*)?", name)
    return (found[1], found[2] or "") if found else (name, "")


def free_names(names: Iterable[str], taken: set[str]) -> list[str]:
    """For each name in turn itself or, if it is taken, the first free one of ``stem_1.ext``, ``stem_2.ext`` ...; all
    given names are taken for the next ones."""
    out, tried = [], {}
    for name in names:
        stem, ext = split_name(name)
        k, found = tried.get(name, 0), name
        while (found := f"{stem}_{k}{ext}" if k else name) in taken:
            k += 1
        tried[name] = k  # lower numbers stay taken
        taken.add(found)
        out.append(found)
    return out


def pictures_of(catalog: Catalog) -> DataFrame:
    """(cluster_id, name, folder, src, base): each distinct picture of a cluster once."""
    named = catalog.clusters.select(F.col("id").alias("cluster_id"), "name", sanitized(F.col("name")).alias("folder"))
    photos = catalog.photos.select(F.col("id").alias("photo_id"), F.col("path").alias("src"))
    pictures = catalog.faces.where("cluster_id is not null").join(photos, "photo_id").select("cluster_id", "src").distinct().join(named, "cluster_id")
    return pictures.select("cluster_id", "name", "folder", "src", F.regexp_extract("src", r"([^/]*)$", 1).alias("base"))


def export_plan(catalog: Catalog, existing: DataFrame | None = None) -> DataFrame:
    """(cluster_id, name, folder, src, file_name): each distinct picture of a cluster once. Clusters with names
    that sanitise alike share a folder; in order of cluster and path each picture gets its own name if that is free in the folder,
    else the first free one with ``_1``, ``_2`` ... before its extension. ``existing`` (folder, file_name) are taken.

    Names can only meet in a family: a name, and those that add a number to a name of the family that is there.
    Only families of two names or more are gone through in order, each by one task."""
    pictures = pictures_of(catalog)
    taken = pictures.select("folder", F.col("base").alias("file_name")).limit(0) if existing is None else existing.select("folder", "file_name").distinct()
    pictures = written(pictures, "export-pictures")
    there = pictures.select("folder", "base").union(taken).distinct()
    # every ancestor of a name: one number less each time, up to the first that isn't there
    family = written(there.select("folder", "base", F.col("base").alias("root"), F.lit(True).alias("open")), "export-names")
    known = there.select(F.col("folder").alias("of_folder"), F.col("base").alias("parent"), F.lit(True).alias("known"))
    while family.where(F.col("open") & F.col("root").rlike(NUMBERED)).limit(1).count():
        up = family.withColumn("up", F.when(F.col("open") & F.col("root").rlike(NUMBERED), F.regexp_replace("root", NUMBERED, "$1$2")))
        up = up.join(known, (up["folder"] == known["of_folder"]) & (up["up"] == known["parent"]), "left")
        family = written(up.select("folder", "base", F.when(F.col("known"), F.col("up")).otherwise(F.col("root")).alias("root"), F.coalesce("known", F.lit(False)).alias("open")), "export-names")
    family = family.select("folder", "base", "root")
    rooted = pictures.join(family, ["folder", "base"])
    old = taken.withColumnRenamed("file_name", "base").join(family, ["folder", "base"])
    members = rooted.unionByName(old, allowMissingColumns=True)
    sizes = members.groupBy("folder", "root").agg(F.count(F.lit(1)).alias("size"))
    sized = rooted.join(sizes, ["folder", "root"])

    def name(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["cluster_id"].notna()].sort_values(["cluster_id", "src"], kind="stable")
        return own.assign(file_name=free_names(own["base"], set(pdf.loc[pdf["cluster_id"].isna(), "base"])))[["cluster_id", "name", "folder", "src", "file_name"]].astype({"cluster_id": "int64"})

    several = members.join(sizes.where("size > 1").select("folder", "root"), ["folder", "root"], "left_semi")
    searched = several.select("cluster_id", "name", "folder", "src", "base", "root").groupBy("folder", "root").applyInPandas(name, "cluster_id long, name string, folder string, src string, file_name string")
    return sized.where("size = 1").select("cluster_id", "name", "folder", "src", F.col("base").alias("file_name")).unionByName(searched)


def export_summary(catalog: Catalog, plan: DataFrame) -> DataFrame:
    """(cluster_id, name, folder, exported): clusters without pictures have 0."""
    named = catalog.clusters.select(F.col("id").alias("cluster_id"), "name", sanitized(F.col("name")).alias("folder"))
    return named.join(plan.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("exported")), "cluster_id", "left").withColumn("exported", F.coalesce("exported", F.lit(0)))


def names_there(spark, output: str, folders: DataFrame) -> DataFrame:
    """(folder, file_name) of what lies in the ``folders`` (folder) of ``output``, listed by tasks."""

    def listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            there = [(f, n) for f in pdf["folder"] if os.path.isdir(os.path.join(output, f)) for n in os.listdir(os.path.join(output, f))]
            yield pd.DataFrame(there, columns=["folder", "file_name"])

    return folders.select("folder").distinct().mapInPandas(listed, "folder string, file_name string")


def run_export(catalog: Catalog, output: str, symlink: bool = False, on_progress: Callable[[int, int], None] | None = None, stop: Callable[[], bool] | None = None) -> dict[str, int]:
    """Copies (or links) on a file system that driver and executors share; {name: pictures}. One job for all entities: pictures are dealt to tasks one
    by one, so an entity of any size is spread, and all of them get their names when every task has ended, or none does. Missing
    pictures are skipped, files that are there are never overwritten. ``stop`` is heeded before the job, and a job that is cancelled leaves nothing."""
    if stop is not None and stop():
        return {}
    spark = catalog.clusters.sparkSession
    clusters = catalog.clusters.select("id", "name", sanitized(F.col("name")).alias("folder")).orderBy("id").collect()  # the entities a user named, one row each
    for c in clusters:
        os.makedirs(os.path.join(output, c["folder"]), exist_ok=True)
    folders.register(spark)
    report = f"{run_dir(spark)}/export-{uuid.uuid4().hex}"
    plan = export_plan(catalog, names_there(spark, output, spark.createDataFrame([(c["folder"],) for c in clusters], "folder string")))
    sink = plan.select("cluster_id", "folder", "src", "file_name").repartition(F.xxhash64("folder", "src")).write.format(folders.FORMAT)
    sink.option("symlink", str(symlink)).option("report", report).mode("append").save(output)
    done = {r["cluster_id"]: r["n"] for r in spark.read.schema("cluster_id long, n long").json(report).groupBy("cluster_id").agg(F.sum("n").alias("n")).collect()}  # a row an entity
    if on_progress:
        on_progress(len(clusters), len(clusters))
    summary: dict[str, int] = {}
    for c in clusters:
        summary[c["name"]] = summary.get(c["name"], 0) + done.get(c["id"], 0)
    return summary
