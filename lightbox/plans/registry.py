"""The registered queries over the fixture catalog, each with the SQL that states the same for an oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..catalog import Catalog
from ..functions import display, geometry, hashes, names, times, vectors
from ..operators import clustering, curation, duplicates, export, ingest, neighbors
from ..sources import fixtures
from . import views
from .materialize import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Radius for density clusters, threshold for centroids, for tentative names and for average linkage on the fixture.
EPS, NEAR, MAYBE, TIGHT = 0.60, 0.80, 0.90, 0.85


def _with(*tables: str, recursive: bool = False, **more: str) -> str:
    parts = [f"{t} AS ({fixtures.CTES[t]})" for t in tables] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n"


def _register(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _on_catalog(name: str, sql: str | None, body: Callable[[Catalog], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: body(fixtures.catalog(spark, sf_dir))
    if sql is not None:
        ORACLES[name] = sql


# ---------------------------------------------------------------- counts, people, faces

FPC = ("faces", "photos", "clusters")
BOX = "f.bbox_x, f.bbox_y, f.bbox_w, f.bbox_h"
COUNTED = "SELECT c.id, c.name, count(f.id) AS face_count FROM clusters c LEFT JOIN faces f ON f.cluster_id = c.id AND f.dismissed = 0 GROUP BY c.id, c.name"
RANKED = f"""SELECT f.cluster_id, row_number() OVER (PARTITION BY f.cluster_id ORDER BY f.detection_confidence DESC, f.id) AS rn, f.id AS face_id,
 f.photo_id, p.path, {BOX}, f.detection_confidence AS confidence FROM faces f JOIN photos p ON p.id = f.photo_id
 WHERE f.dismissed = 0 AND f.cluster_id IN (SELECT id FROM clusters)"""

_on_catalog("catalog_stats", _with(*FPC) + """SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM clusters) AS clusters,
 count(*) FILTER (WHERE dismissed = 0) AS faces, count(*) FILTER (WHERE dismissed = 0 AND cluster_id IS NULL) AS unclustered_faces,
 count(*) FILTER (WHERE dismissed = 1) AS dismissed_faces FROM faces""", views.catalog_stats)  # fmt: skip
_on_catalog("clusters_with_counts", _with(*FPC) + COUNTED, views.clusters_with_counts)
_on_catalog("cluster_by_id", _with(*FPC, counted=COUNTED) + "SELECT * FROM counted WHERE id = 2", lambda c: views.cluster_by_id(c, 2))
_on_catalog("dashboard", _with(*FPC, counted=COUNTED, ranked=RANKED) + """SELECT c.*, r.face_id, r.photo_id, r.path, r.bbox_x, r.bbox_y, r.bbox_w, r.bbox_h, r.confidence
 FROM counted c LEFT JOIN ranked r ON r.cluster_id = c.id AND r.rn = 1""", views.dashboard)  # fmt: skip
_on_catalog("representative_face", _with(*FPC, ranked=RANKED) + "SELECT * EXCLUDE (rn) FROM ranked WHERE rn = 1", views.representatives)
REP = f"SELECT f.id AS face_id, f.photo_id, p.path, {BOX}, f.detection_confidence AS confidence FROM faces f JOIN photos p ON p.id = f.photo_id"
_on_catalog("representative_face_preferred", _with(*FPC) + REP + " WHERE f.dismissed = 0 AND f.cluster_id = 2 ORDER BY (f.id = 21) DESC, f.detection_confidence DESC, f.id LIMIT 1", lambda c: views.representative(c, 2, 21))
_on_catalog("other_cluster_reps", _with(*FPC) + """SELECT cluster_id, id AS face_id FROM faces WHERE dismissed = 0 AND cluster_id <> 2 AND cluster_id IN (SELECT id FROM clusters)
 QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY detection_confidence DESC, id) = 1""", lambda c: views.other_representatives(c, 2))  # fmt: skip
_on_catalog("review_top6", _with(*FPC, ranked=RANKED) + "SELECT * FROM ranked WHERE rn <= 6", lambda c: views.top_faces(c, 6))
_on_catalog("review_pairs_top20", _with(*FPC, counted=COUNTED, ranked=RANKED, placed="SELECT *, row_number() OVER (ORDER BY face_count DESC, id) AS place FROM counted") + """
 SELECT s.pair, s.side, s.id AS cluster_id, s.name, r.rn AS rank, r.face_id FROM (
  SELECT place AS pair, 'left' AS side, id, name FROM placed WHERE place < (SELECT max(place) FROM placed)
  UNION ALL SELECT place - 1, 'right', id, name FROM placed WHERE place > 1) s LEFT JOIN ranked r ON r.cluster_id = s.id AND r.rn <= 20""", lambda c: views.review_pairs(c, 20))  # fmt: skip
_on_catalog("faces_for_cluster", _with(*FPC) + REP.replace(" FROM faces", ", f.dismissed FROM faces") + " WHERE f.cluster_id = 2", lambda c: views.faces_for_cluster(c, 2))
_on_catalog("face_by_id", _with(*FPC) + REP.replace(" FROM faces", ", f.cluster_id, f.dismissed FROM faces") + " WHERE f.id = 21", lambda c: views.face_by_id(c, 21))
_on_catalog("photo_by_id", _with("photos") + "SELECT id, path, file_size, width, height, format, exif_date FROM photos WHERE id = 7", lambda c: views.photo_by_id(c, 7))
QUERIES["faces_in_photo"] = lambda spark, d: (lambda c: views.faces_in_photo(c, c.photos.where("id = 21").first()["path"]))(fixtures.catalog(spark, d))
ORACLES["faces_in_photo"] = _with(*FPC) + f"SELECT f.id AS face_id, f.cluster_id, {BOX} FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.dismissed = 0 AND p.path = (SELECT path FROM photos WHERE id = 21)"
_on_catalog("photos_for_cluster", _with(*FPC) + "SELECT DISTINCT p.path FROM photos p JOIN faces f ON f.photo_id = p.id WHERE f.cluster_id = 2", lambda c: views.photos_for_cluster(c, 2))
_on_catalog("photo_count_per_cluster", _with(*FPC) + """SELECT c.id AS cluster_id, count(DISTINCT p.path) AS photos FROM clusters c LEFT JOIN faces f ON f.cluster_id = c.id
 LEFT JOIN photos p ON p.id = f.photo_id GROUP BY c.id""", views.photo_counts)  # fmt: skip
_on_catalog("dismissed_faces", _with(*FPC) + REP + " WHERE f.dismissed = 1", views.dismissed_faces)
_on_catalog("merge_targets", _with(*FPC, counted=COUNTED) + "SELECT * FROM counted WHERE id <> 2", lambda c: views.merge_targets(c, 2))

AUTO_OR_MAYBE = names.AUTO_OR_MAYBE.replace("'", "''")
_on_catalog("people_search_named", _with(*FPC, counted=COUNTED) + f"SELECT * FROM counted WHERE NOT regexp_matches(name, '{AUTO_OR_MAYBE}') AND contains(lower(name), 'a')", lambda c: views.people(c, "named", "A", "name-asc"))
_on_catalog("people_search_auto", _with(*FPC, counted=COUNTED) + f"SELECT * FROM counted WHERE regexp_matches(name, '{names.AUTO}')", lambda c: views.people(c, "auto", "", "faces-asc"))
_on_catalog("people_search_maybe", _with(*FPC, counted=COUNTED) + "SELECT * FROM counted WHERE starts_with(name, 'maybe ')", lambda c: views.people(c, "maybe", "", "name-desc"))
_on_catalog("people_page", _with(*FPC, counted=COUNTED) + "SELECT * FROM counted ORDER BY face_count DESC, id LIMIT 4 OFFSET 4", lambda c: views.people(c, page=1, page_size=4))
_on_catalog("clusters_top20", _with(*FPC, counted=COUNTED) + "SELECT * FROM counted ORDER BY face_count DESC, id LIMIT 20", lambda c: views.clusters_with_counts(c).orderBy(F.col("face_count").desc(), "id").limit(20))
for _sort, _order in (("faces-asc", "face_count, id"), ("name-asc", "lower(name), id"), ("name-desc", "lower(name) DESC, id")):
    _on_catalog(f"people_page_{_sort.replace('-', '_')}", _with(*FPC, counted=COUNTED) + f"SELECT * FROM counted ORDER BY {_order} LIMIT 3 OFFSET 3", lambda c, sort=_sort: views.people(c, sort=sort, page=1, page_size=3))
_on_catalog("display_formats", _with("faces", "photos") + """SELECT f.id AS face_id, CAST(CAST(round_even(CAST(f.detection_confidence * 100 AS DECIMAL(9, 4)), 0) AS INT) AS VARCHAR) || '%' AS confidence,
 printf('%.1f KB', round(p.file_size / 1024, 1)) AS size FROM faces f JOIN photos p ON p.id = f.photo_id""",
            lambda c: c.faces.join(c.photos.select(F.col("id").alias("photo_id"), "file_size"), "photo_id").select(F.col("id").alias("face_id"), display.percent(F.col("detection_confidence").cast("decimal(9,6)")).alias("confidence"), display.kilobytes(F.col("file_size")).alias("size")))
_on_catalog("user_defined_names", _with("clusters") + f"SELECT id, name FROM clusters WHERE NOT regexp_matches(name, '{AUTO_OR_MAYBE}')", lambda c: c.clusters.where(names.user_defined(F.col("name"))).select("id", "name"))

# ---------------------------------------------------------------- timelines

TIMELINE = f"""SELECT substr(p.exif_date, 1, 10) AS day, p.exif_date, p.id AS photo_id, p.path, f.id AS face_id, {BOX}, f.detection_confidence AS confidence,
 f.cluster_id, coalesce(nullif(c.name, ''), 'Unclustered') AS cluster_name FROM photos p JOIN faces f ON f.photo_id = p.id AND f.dismissed = 0
 LEFT JOIN clusters c ON c.id = f.cluster_id WHERE p.exif_date IS NOT NULL"""
PAGE = f"SELECT f.id AS face_id, {BOX}, p.path, p.exif_date, f.detection_confidence AS confidence FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.dismissed = 0 AND "
_on_catalog("timeline_rows", _with(*FPC) + TIMELINE, views.timeline)
_on_catalog("timeline_day_counts", _with(*FPC, t=TIMELINE) + "SELECT day, count(*) AS faces FROM t GROUP BY day", views.timeline_days)
_on_catalog("timeline_person_filter", _with(*FPC, t=TIMELINE) + "SELECT day, count(*) AS faces FROM t WHERE contains(lower(cluster_name), 'ali') GROUP BY day", lambda c: views.timeline_days(c, "Ali"))
_on_catalog("timeline_years", _with(*FPC) + "SELECT DISTINCT coalesce(substr(p.exif_date, 1, 4), 'Unknown') AS year FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.dismissed = 0", views.timeline_years)
_on_catalog("timeline_year_page", _with(*FPC) + PAGE + "p.exif_date LIKE '2021%'", lambda c: views.timeline_year(c, "2021"))
_on_catalog("timeline_undated", _with(*FPC) + PAGE + "p.exif_date IS NULL", views.timeline_undated)

def _folder(spark: SparkSession, name: str) -> str:
    import uuid

    from .materialize import run_dir

    return f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"


@_register(_with("photos") + "SELECT id, path, file_size FROM photos ORDER BY path LIMIT 40 OFFSET 120")
def photo_page(spark, d):
    """The fourth page of photos by path, from a sorted layout."""
    from .pages import write_pages

    photos = fixtures.catalog(spark, d).photos.select("id", "path", "file_size")
    return write_pages(photos, _folder(spark, "pages"), {"path": F.col("path")}, page_size=40, folder=2).page(3)


@_register(_with("photos") + "SELECT id, path FROM photos WHERE contains(lower(path), 'src7/1')")
def photo_search(spark, d):
    """Photos with a part of a path, by postings of its pieces."""
    from .names_index import NamesIndex

    names = fixtures.catalog(spark, d).photos.select("id", F.col("path").alias("name"))
    return NamesIndex.create(names, _folder(spark, "names")).search(names, "SRC7/1").select("id", F.col("name").alias("path"))


# ---------------------------------------------------------------- hashes and duplicates

_BITS = ", ".join(f"sum((({h} >> {i}) & 1) * 2 - 1) AS {h}{i}" for h in ("hi", "lo") for i in range(32))
_PACK = {h: " + ".join(f"CASE WHEN {h}{i} > 0 THEN {1 << i}::BIGINT ELSE 0 END" for i in range(32)) for h in ("hi", "lo")}
SIMHASH = f"""SELECT doc_id, CAST({_PACK['hi']} AS BIGINT) AS hi, CAST({_PACK['lo']} AS BIGINT) AS lo FROM (SELECT doc_id, {_BITS} FROM (
 SELECT doc_id, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS hi, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS lo FROM (
 SELECT doc_id, md5(t) AS h FROM (SELECT DISTINCT doc_id, unnest(string_split(text, ' ')) AS t FROM documents))) GROUP BY doc_id)"""
HAMMING = "SELECT x.doc_id AS a, y.doc_id AS b, CAST(bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) AS INT) AS bits FROM simhash x JOIN simhash y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.hi, y.hi)) + bit_count(xor(x.lo, y.lo)) <= {bits}"
GROUPED = """SELECT a, b FROM near UNION ALL SELECT b, a FROM near"""


def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = hashes.simhash64(fixtures.table(spark, sf_dir, "documents"))
    return h.select(F.col("doc_id").alias("id"), hashes.from_hex(F.col("phash")).alias("hash"))


def _hashed_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    c = fixtures.catalog(spark, sf_dir)
    h = written(hashes.simhash64(fixtures.table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("id"), "phash"), "simhashes")  # read by several plans
    return c.to(photos=c.photos.drop("phash").join(h, "id", "left").select(*schema.PHOTOS.names))


@_register(_with(simhash=SIMHASH) + "SELECT doc_id, printf('%08x%08x', hi, lo) AS phash FROM simhash")
def simhash64(spark, d):
    return hashes.simhash64(fixtures.table(spark, d, "documents")).select("doc_id", "phash")


@_register(_with(simhash=SIMHASH) + HAMMING.format(bits=6))
def hamming_pairs(spark, d):
    return neighbors.hamming_join(_hashes(spark, d), 6)


DUPLICATES = dict(simhash=SIMHASH, near=HAMMING.format(bits=10), edges=GROUPED, reach="SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a", roots="SELECT a AS id, least(a, min(b)) AS root FROM reach GROUP BY a", grouped="SELECT id, dense_rank() OVER (ORDER BY root) AS group_id FROM roots")


@_register(_with(recursive=True, **DUPLICATES) + "SELECT id AS photo_id, group_id AS duplicate_group_id FROM grouped")
def duplicate_detect(spark, d):
    c, _ = duplicates.detect_duplicates(_hashed_catalog(spark, d))
    return c.photos.where("duplicate_group_id is not null").select(F.col("id").alias("photo_id"), "duplicate_group_id")


@_register(_with(recursive=True, **DUPLICATES) + "SELECT id AS photo_id, group_id AS duplicate_group_id FROM grouped")
def duplicates_kept(spark, d):
    """The groups of an index that most photos were brought to first, and the rest after them."""
    import uuid

    from ..operators.hashindex import HashIndex
    from .materialize import run_dir

    photos = written(_hashes(spark, d), "hashes")
    index = HashIndex(spark, f"{run_dir(spark)}/index-{uuid.uuid4().hex}")
    index.add(photos.where("id % 50 <> 3"))
    index.add(photos.where("id % 50 = 3"))
    labels = written(index.labels(photos), "index-labels")
    index.close()
    return labels.select(F.col("id").alias("photo_id"), (F.col("label") + 1).cast("long").alias("duplicate_group_id"))


@_register(_with(recursive=True, **DUPLICATES) + "SELECT group_id AS id, count(*) AS photo_count FROM grouped GROUP BY group_id")
def duplicate_groups(spark, d):
    return views.duplicate_groups(duplicates.detect_duplicates(_hashed_catalog(spark, d))[0])


@_register(_with("photos", recursive=True, **DUPLICATES) + "SELECT p.id, p.path, p.file_size, p.width, p.height FROM photos p JOIN grouped g USING (id) WHERE g.group_id = 1")
def duplicate_group_members(spark, d):
    return views.duplicate_photos(duplicates.detect_duplicates(_hashed_catalog(spark, d))[0], 1)


# ---------------------------------------------------------------- vectors and clusters

UNIT = "list_transform(CAST({e} AS DOUBLE[]), lambda x: x / greatest(sqrt(list_dot_product(CAST({e} AS DOUBLE[]), CAST({e} AS DOUBLE[]))), 1e-10))"
ALL_UNITS = f"SELECT vec_id AS id, {UNIT.format(e='embedding')} AS e FROM embeddings"
ACTIVE_UNITS = f"SELECT id, cluster_id, {UNIT.format(e='embedding')} AS e FROM faces WHERE dismissed = 0"


def _mean(rows: str, key: str) -> str:
    """SQL: (key, c) unit means of (key, v DOUBLE[])."""
    return f"""SELECT {key}, list_transform(m, lambda x: x / (CASE WHEN sqrt(list_dot_product(m, m)) > 1e-10 THEN sqrt(list_dot_product(m, m)) ELSE 1 END)) AS c FROM (
 SELECT {key}, list(x ORDER BY pos) AS m FROM (SELECT {key}, pos, avg(x) AS x FROM (SELECT {key}, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM ({rows})) GROUP BY {key}, pos) GROUP BY {key})"""


CENTROIDS = _mean("SELECT cluster_id, CAST(embedding AS DOUBLE[]) AS v FROM faces WHERE dismissed = 0 AND cluster_id IS NOT NULL", "cluster_id")


def _dbscan(units: str, eps: float, prefix: str = "") -> dict[str, str]:
    """SQL: common table expressions ending in {prefix}labels (id, label, is_core) of ``units`` (id, e)."""
    p = prefix
    return {
        f"{p}nb": f"SELECT a.id AS a, b.id AS b FROM {units} a JOIN {units} b ON 1 - list_dot_product(a.e, b.e) <= {eps}",
        f"{p}core": f"SELECT a FROM {p}nb GROUP BY a HAVING count(*) >= 3",
        f"{p}ce": f"SELECT n.a, n.b FROM {p}nb n JOIN {p}core c1 ON n.a = c1.a JOIN {p}core c2 ON n.b = c2.a",
        f"{p}reach": f"SELECT a, b FROM {p}ce UNION SELECT r.a, e.b FROM {p}reach r JOIN {p}ce e ON r.b = e.a",
        f"{p}lab": f"SELECT a, dense_rank() OVER (ORDER BY root) - 1 AS label FROM (SELECT a, min(b) AS root FROM {p}reach GROUP BY a)",
        f"{p}bord": f"SELECT n.a, min(l.label) AS label FROM {p}nb n JOIN {p}lab l ON n.b = l.a WHERE n.a NOT IN (SELECT a FROM {p}core) GROUP BY n.a",
        f"{p}labels": f"SELECT u.id, CAST(coalesce(l.label, b.label, -1) AS INT) AS label, l.a IS NOT NULL AS is_core FROM {units} u LEFT JOIN {p}lab l ON u.id = l.a LEFT JOIN {p}bord b ON u.id = b.a",
    }


def _vectors(spark, d) -> DataFrame:
    return fixtures.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


@_register(f"SELECT id, pos, round(x, 6) AS value FROM (SELECT id, generate_subscripts(e, 1) - 1 AS pos, unnest(e) AS x FROM ({ALL_UNITS}))")
def l2_normalize(spark, d):
    u = _vectors(spark, d).select("id", F.posexplode(vectors.normalized(F.col("embedding"))).alias("pos", "x"))
    return u.select("id", F.col("pos").cast("long").alias("pos"), F.round("x", 6).alias("value"))


@_register(_with(u=ALL_UNITS) + f"SELECT a.id AS a, b.id AS b, round(1 - list_dot_product(a.e, b.e), 6) AS dist FROM u a JOIN u b ON a.id < b.id AND 1 - list_dot_product(a.e, b.e) <= {EPS}")
def cosine_pairs(spark, d):
    return neighbors.radius_join(_vectors(spark, d), EPS).select("a", "b", F.round("dist", 6).alias("dist"))


_on_catalog("cluster_centroids", _with("faces", cent=CENTROIDS) + "SELECT cluster_id, pos - 1 AS pos, round(x, 5) AS value FROM (SELECT cluster_id, generate_subscripts(c, 1) AS pos, unnest(c) AS x FROM cent)",
            lambda c: clustering.centroids(c).select("cluster_id", F.posexplode("centroid").alias("pos", "x")).select("cluster_id", F.col("pos").cast("long").alias("pos"), F.round("x", 5).alias("value")))

NEAREST = "SELECT u.id, min_by(k.cluster_id, (1 - list_dot_product(u.e, k.c), k.cluster_id)) AS cluster_id, min(1 - list_dot_product(u.e, k.c)) AS dist FROM u JOIN cent k ON true WHERE u.cluster_id IS NULL GROUP BY u.id"
_on_catalog("nearest_centroid_assign", _with("faces", u=ACTIVE_UNITS, cent=CENTROIDS, near=NEAREST) + f"SELECT id, cluster_id, round(dist, 6) AS dist FROM near WHERE dist <= {NEAR}",
            lambda c: neighbors.nearest_centroid(clustering.unassigned(c), clustering.centroids(c)).where(F.col("dist") <= NEAR).select("id", "cluster_id", F.round("dist", 6).alias("dist")))


@_register(_with(recursive=True, u=ALL_UNITS, **_dbscan("u", EPS)) + "SELECT id, label FROM labels")
def dbscan_labels(spark, d):
    return clustering.dbscan(_vectors(spark, d), EPS).select("id", "label")


@_register(_with(u=ALL_UNITS, nb=_dbscan("u", EPS)["nb"]) + "SELECT a AS id FROM nb GROUP BY a HAVING count(*) >= 3")
def dbscan_core(spark, d):
    return clustering.dbscan(_vectors(spark, d), EPS).where("is_core").select("id")


@_register(_with(recursive=True, u=ALL_UNITS, **_dbscan("u", EPS)) + "SELECT count(DISTINCT label) FILTER (WHERE label >= 0) AS clusters, count(*) FILTER (WHERE label = -1) AS noise, count(*) FILTER (WHERE is_core) AS cores FROM labels")
def dbscan_summary(spark, d):
    return clustering.dbscan(_vectors(spark, d), EPS).agg(F.count_distinct(F.when(F.col("label") >= 0, F.col("label"))).alias("clusters"), F.count_if(F.col("label") == -1).alias("noise"), F.count_if("is_core").alias("cores"))


def _full(c: Catalog) -> DataFrame:
    state, _ = clustering.full_clustering(c, EPS)
    named = state.clusters.select(F.col("id").alias("cluster_id"), "name")
    return state.active.select("id", "cluster_id").join(named, "cluster_id", "left").select(F.col("id").alias("face_id"), "name")


_on_catalog("full_cluster_names", _with("faces", recursive=True, u=ACTIVE_UNITS, **_dbscan("u", EPS)) + "SELECT id AS face_id, CASE WHEN label >= 0 THEN printf('Person_%03d', label + 1) END AS name FROM labels", _full)

LEFT = f"SELECT id, e FROM u WHERE cluster_id IS NULL AND id NOT IN (SELECT id FROM near WHERE dist <= {NEAR})"
INCREMENTAL = dict(u=ACTIVE_UNITS, cent=CENTROIDS, near=NEAREST, rest=LEFT, **_dbscan("rest", 0.70))


def _assigned(c: Catalog) -> DataFrame:
    matched, labels = clustering.incremental_plan(c, NEAR, density_eps=0.70)
    return matched.select("id", F.lit("matched").alias("how"), F.col("cluster_id").cast("long").alias("number")).unionByName(labels.select("id", F.when(F.col("label") >= 0, "new").otherwise("noise").alias("how"), F.col("label").cast("long").alias("number")))


_on_catalog("incremental_assign", _with("faces", recursive=True, **INCREMENTAL) + f"""SELECT id, 'matched' AS how, cluster_id AS number FROM near WHERE dist <= {NEAR}
 UNION ALL SELECT id, CASE WHEN label >= 0 THEN 'new' ELSE 'noise' END, CAST(label AS BIGINT) FROM labels""", _assigned)  # fmt: skip

NEW_MEANS = _mean("SELECT l.label, r.e AS v FROM labels l JOIN rest r ON r.id = l.id WHERE l.label >= 0", "label")
MAYBES = f"""SELECT label, max(CASE WHEN rn = 1 AND dist <= {MAYBE} THEN 'maybe ' || name END) AS name FROM (
 SELECT m.label, k.name, 1 - list_dot_product(m.c, q.c) AS dist, row_number() OVER (PARTITION BY m.label ORDER BY 1 - list_dot_product(m.c, q.c), k.id) AS rn
 FROM means m LEFT JOIN (SELECT * FROM clusters WHERE NOT regexp_matches(name, '{AUTO_OR_MAYBE}')) k ON true JOIN cent q ON q.cluster_id = k.id) GROUP BY label"""
_on_catalog("maybe_names", _with("faces", "clusters", recursive=True, **INCREMENTAL, means=NEW_MEANS, maybes=MAYBES) + "SELECT label, name FROM maybes",
            lambda c: clustering.tentative_names(c, clustering.incremental_plan(c, NEAR, density_eps=0.70)[1], MAYBE))


def _incremental(c: Catalog) -> DataFrame:
    state, _ = clustering.incremental_clustering(c, NEAR, maybe_eps=MAYBE, density_eps=0.70)
    return state.active.select("id", "cluster_id").join(state.clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id", "left").select(F.col("id").alias("face_id"), "cluster_id", "name")


_on_catalog("incremental_cluster", _with("faces", "clusters", recursive=True, **INCREMENTAL, means=NEW_MEANS, maybes=MAYBES, fresh="""SELECT label, label + 12 AS id,
 coalesce(name, printf('Person_%03d', 1234 + sum(CASE WHEN name IS NULL THEN 1 ELSE 0 END) OVER (ORDER BY label)::BIGINT)) AS name FROM maybes""") + f"""
 SELECT u.id AS face_id, coalesce(u.cluster_id, n.cluster_id, g.id) AS cluster_id, coalesce(k.name, g.name) AS name FROM u
 LEFT JOIN (SELECT * FROM near WHERE dist <= {NEAR}) n ON n.id = u.id LEFT JOIN labels l ON l.id = u.id LEFT JOIN fresh g ON g.label = l.label
 LEFT JOIN clusters k ON k.id = coalesce(u.cluster_id, n.cluster_id)""", _incremental)  # fmt: skip

_on_catalog("absorb_after_rename", _with("faces", "clusters", u=ACTIVE_UNITS, cent=CENTROIDS) + f"""SELECT f.id AS face_id, CASE WHEN f.cluster_id = 3 OR f.id IN (
 SELECT u.id FROM u JOIN cent k ON k.cluster_id = 1 WHERE u.cluster_id IS NULL AND 1 - list_dot_product(u.e, k.c) <= {NEAR}) THEN 1 ELSE f.cluster_id END AS cluster_id FROM faces f""",
            lambda c: curation.absorb(c, 1, "Alice", NEAR)[0].faces.select(F.col("id").alias("face_id"), "cluster_id"))


def _linkage(units: str, eps: float) -> dict[str, str]:
    """SQL: common table expressions ending in linked (id, label): the nearest two groups of ``units`` (id, e) merge while their average distance is under ``eps``.
    A group is in the place of its smallest id, so places are labels."""
    pairs = """flatten(list_transform(range(1, len(gs) + 1), lambda i: list_transform(range(i + 1, len(gs) + 1),
 lambda j: {'d': 1 - list_dot_product(gs[i].s, gs[j].s) / (gs[i].n * gs[j].n), 'i': i, 'j': j})))"""
    both = """{'ids': list_concat(gs[p.i].ids, gs[p.j].ids), 's': list_transform(range(1, len(gs[p.i].s) + 1), lambda t: gs[p.i].s[t] + gs[p.j].s[t]), 'n': gs[p.i].n + gs[p.j].n}"""
    return {
        "steps": f"""SELECT 0 AS step, list({{'ids': [id], 's': e, 'n': 1}} ORDER BY id) AS gs FROM {units}
 UNION ALL SELECT step + 1, list_transform(list_filter(range(1, len(gs) + 1), lambda k: k <> p.j), lambda k: CASE WHEN k = p.i THEN {both} ELSE gs[k] END)
 FROM (SELECT step, gs, list_sort(list_filter({pairs}, lambda x: x.d < {eps}))[1] AS p FROM steps) WHERE p IS NOT NULL""",
        "linked": """SELECT unnest(g.ids) AS id, label FROM (SELECT unnest(gs) AS g, unnest(range(len(gs))) AS label FROM steps WHERE step = (SELECT max(step) FROM steps))""",
    }


def _units_of(where: str) -> str:
    return f"SELECT id, e FROM ({ACTIVE_UNITS}) WHERE {where}"


SIZED = "SELECT id, label, count(*) OVER (PARTITION BY label) AS size FROM linked"
_on_catalog("recluster_one", _with("faces", recursive=True, u=_units_of("cluster_id = 2"), **_linkage("u", TIGHT), sized=SIZED) + "SELECT id, CAST(CASE WHEN size < 3 THEN -1 ELSE label END AS INT) AS label FROM sized",
            lambda c: clustering.recluster_labels(c, 2, TIGHT))
_on_catalog("recluster_state", _with("faces", "clusters", recursive=True, u=_units_of("cluster_id = 2"), **_linkage("u", TIGHT), sized=SIZED,
                                     kept="SELECT label, row_number() OVER (ORDER BY size DESC, label) AS place FROM (SELECT DISTINCT label, size FROM sized WHERE size >= 3)",
                                     fresh="""SELECT label, 2 AS id, CAST(NULL AS VARCHAR) AS name FROM kept WHERE place = 1
 UNION ALL SELECT label, 11 + row_number() OVER (ORDER BY label), printf('Person_%03d', 1234 + row_number() OVER (ORDER BY label)) FROM kept WHERE place > 1""") + """
 SELECT x.cluster_id, coalesce(x.name, c.name) AS name, count(*) AS count FROM (
  SELECT cluster_id, CAST(NULL AS VARCHAR) AS name FROM faces WHERE dismissed = 0 AND cluster_id <> 2
  UNION ALL SELECT f.id, f.name FROM sized s JOIN fresh f USING (label)) x LEFT JOIN clusters c ON c.id = x.cluster_id GROUP BY x.cluster_id, coalesce(x.name, c.name)""",
            lambda c: (lambda s: s.active.join(s.clusters.select(F.col("id").alias("cluster_id"), "name"), "cluster_id").groupBy("cluster_id", "name").count())(clustering.recluster(c, 2, TIGHT)[0]))
_on_catalog("split_selected", _with("faces", recursive=True, u=_units_of("id BETWEEN 1 AND 39"), **_linkage("u", TIGHT)) + "SELECT id, CAST(12 + label AS BIGINT) AS cluster_id FROM linked",
            lambda c: (lambda r: r[0].faces.where(F.col("cluster_id").isin(r[1])).select("id", "cluster_id"))(clustering.split_by_similarity(c, list(range(1, 40)), "Split", TIGHT)))
_on_catalog("next_auto_name", _with("clusters") + f"SELECT printf('Person_%03d', max(CAST(regexp_extract(name, '{names.AUTO_NUMBER}', 1) AS BIGINT)) + 1) AS name FROM clusters WHERE regexp_matches(name, '{names.AUTO_PREFIX}')",
            lambda c: c.clusters.agg(names.auto_name(F.max(names.auto_number(F.col("name"))) + 1).alias("name")))

# ---------------------------------------------------------------- names, export, geometry, dates

SANITIZED = "coalesce(nullif(regexp_replace(regexp_replace(regexp_replace({n}, '[<>:\"/\\\\|?*\\x00-\\x1f]', '_', 'g'), '^\\s+|\\s+$', '', 'g'), '^[.]+|[.]+$', '', 'g'), ''), 'unnamed')"
_on_catalog("sanitize_names", _with("clusters") + f"SELECT id, {SANITIZED.format(n='name')} AS safe FROM clusters", lambda c: c.clusters.select("id", names.sanitized(F.col("name")).alias("safe")))
PLAN = f"""SELECT c.id AS cluster_id, c.name, {SANITIZED.format(n='c.name')} AS folder, x.path AS src, regexp_extract(x.path, '([^/]*)$', 1) AS base
 FROM (SELECT DISTINCT f.cluster_id, p.path FROM faces f JOIN photos p ON p.id = f.photo_id WHERE f.cluster_id IS NOT NULL) x JOIN clusters c ON c.id = x.cluster_id"""
_on_catalog("export_plan", _with(*FPC, plan=PLAN, numbered="SELECT *, row_number() OVER (PARTITION BY folder, base ORDER BY cluster_id, src) - 1 AS k FROM plan") + """
 SELECT cluster_id, name, folder, src, CASE WHEN k = 0 THEN base ELSE replace(base, '.jpg', '') || '_' || CAST(k AS VARCHAR) || '.jpg' END AS file_name FROM numbered""", export.export_plan)  # fmt: skip
_on_catalog("export_summary", _with(*FPC, plan=PLAN) + f"SELECT c.id AS cluster_id, c.name, {SANITIZED.format(n='c.name')} AS folder, count(p.src) AS exported FROM clusters c LEFT JOIN plan p ON p.cluster_id = c.id GROUP BY c.id, c.name", lambda c: export.export_summary(c, export.export_plan(c)))


#: Names that look as if an export had numbered them.
NUMBERED = "CASE id % 5 WHEN 0 THEN 'a.jpg' WHEN 1 THEN 'a_1.jpg' WHEN 2 THEN 'a_1_1.jpg' WHEN 3 THEN 'a_2.jpg' ELSE 'b.jpg' END"
RENAMED = f"SELECT id, concat('/photos/', CAST(id % 3 AS {{s}}), '/', CAST(id AS {{s}}), '/', {NUMBERED}) AS path FROM {{photos}}"


@_register(_with("faces", "clusters", recursive=True, all_photos=fixtures.CTES["photos"], photos=RENAMED.format(s="VARCHAR", photos="all_photos"), plan=PLAN,
                 placed="SELECT *, row_number() OVER (PARTITION BY folder ORDER BY cluster_id, src) AS place FROM plan",
                 walk="""SELECT DISTINCT folder, 0::BIGINT AS place, NULL::VARCHAR AS file_name, []::VARCHAR[] AS taken FROM plan
 UNION ALL SELECT folder, place, free, list_append(taken, free) FROM (SELECT w.folder, p.place, w.taken, list_filter(
  list_prepend(p.base, list_transform(range(1, len(w.taken) + 2), lambda k: replace(p.base, '.jpg', '') || '_' || CAST(k AS VARCHAR) || '.jpg')),
  lambda n: NOT list_contains(w.taken, n))[1] AS free FROM walk w JOIN placed p ON p.folder = w.folder AND p.place = w.place + 1)""") + """
 SELECT p.cluster_id, p.name, p.folder, p.src, w.file_name FROM placed p JOIN walk w ON w.folder = p.folder AND w.place = p.place""")  # fmt: skip
def export_plan_clashes(spark, d):
    """Export names where pictures are called as an export would name them."""
    c = fixtures.catalog(spark, d)
    renamed = spark.sql(RENAMED.format(s="STRING", photos="{photos}"), photos=c.photos)
    return export.export_plan(c.to(photos=c.photos.drop("path").join(renamed, "id").select(*schema.PHOTOS.names)))


def _crops(c: Catalog) -> DataFrame:
    f = c.faces.select(F.col("id").alias("face_id"), "photo_id", *views.BOX).join(c.photos.select(F.col("id").alias("photo_id"), "width", "height"), "photo_id")
    made = f.withColumns(geometry.crop(*(F.col(x) for x in ("bbox_x", "bbox_y", "bbox_w", "bbox_h", "width", "height"))))
    return made.select("face_id", "crop_left", "crop_top", "crop_right", "crop_bottom")


_on_catalog("crop_rectangles", _with("faces", "photos") + """SELECT f.id AS face_id, greatest(0, bbox_x - CAST(floor(bbox_w * 0.2::DOUBLE) AS INT)) AS crop_left, greatest(0, bbox_y - CAST(floor(bbox_h * 0.2::DOUBLE) AS INT)) AS crop_top,
 least(p.width, bbox_x + bbox_w + CAST(floor(bbox_w * 0.2::DOUBLE) AS INT)) AS crop_right, least(p.height, bbox_y + bbox_h + CAST(floor(bbox_h * 0.2::DOUBLE) AS INT)) AS crop_bottom
 FROM faces f JOIN photos p ON p.id = f.photo_id""", _crops)  # fmt: skip


def _dims(c: Catalog) -> DataFrame:
    f = geometry.downscale_factor(F.col("width"), F.col("height"))
    return c.photos.select(F.col("id").alias("photo_id"), F.round(f, 6).alias("factor"), geometry.downscaled(F.col("width"), f).alias("new_width"), geometry.downscaled(F.col("height"), f).alias("new_height"))


_on_catalog("downscale_dims", _with("photos", s="SELECT id, width, height, CASE WHEN width > 4096 OR height > 4096 THEN least(4096::DOUBLE / width, 4096::DOUBLE / height) ELSE 1::DOUBLE END AS f FROM photos") + """
 SELECT id AS photo_id, round(f, 6) AS factor, greatest(1, CAST(floor(width * f) AS INT)) AS new_width, greatest(1, CAST(floor(height * f) AS INT)) AS new_height FROM s""", _dims)  # fmt: skip
_on_catalog("thumbnail_dims", _with("photos") + """SELECT id AS photo_id, greatest(1, CAST(round(width * least(1::DOUBLE, 150::DOUBLE / width, 150::DOUBLE / height)) AS INT)) AS thumb_w,
 greatest(1, CAST(round(height * least(1::DOUBLE, 150::DOUBLE / width, 150::DOUBLE / height)) AS INT)) AS thumb_h FROM photos""",
            lambda c: c.photos.select(F.col("id").alias("photo_id"), *(v.alias(k) for k, v in geometry.fitted(F.col("width"), F.col("height")).items())))
_on_catalog("min_face_filter", _with("faces") + "SELECT id FROM faces WHERE bbox_w >= 40 AND bbox_h >= 40 AND detection_confidence >= 0.9", lambda c: c.faces.where(geometry.large_enough(F.col("bbox_w"), F.col("bbox_h")) & (F.col("detection_confidence") >= 0.9)).select("id"))

RAW_DATE = "CASE WHEN doc_id % 9 = 0 THEN NULL WHEN doc_id % 3 = 0 THEN '2021:0' || CAST(1 + doc_id % 9 AS {s}) || ':1' || CAST(doc_id % 9 AS {s}) || ' 10:20:30' WHEN doc_id % 3 = 1 THEN '2022-0' || CAST(1 + doc_id % 9 AS {s}) || '-05 01:02:03' ELSE 'not a date' END"


@_register(f"SELECT doc_id, strftime(coalesce(try_strptime(raw, '%Y:%m:%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%dT%H:%M:%S') AS exif_date FROM (SELECT doc_id, {RAW_DATE.format(s='VARCHAR')} AS raw FROM documents)")
def exif_parse(spark, d):
    return fixtures.table(spark, d, "documents").selectExpr("doc_id", f"{RAW_DATE.format(s='STRING')} AS raw").select("doc_id", times.exif_iso(F.col("raw")).alias("exif_date"))


SCANNED = "2024-01-15 00:00:00"


@_register(_with("photos") + f"SELECT p.path FROM photos p JOIN events e ON e.event_id = p.id WHERE p.id % 4 = 0 OR e.ts > TIMESTAMP '{SCANNED}'")
def stale_files(spark, d):
    known = fixtures.catalog(spark, d).photos.where("id % 4 <> 0").withColumn("scanned_at", F.lit(SCANNED))
    return ingest.stale_files(fixtures.files_on_disk(spark, d), known).select("path")


#: A picture's header: an EXIF block with the time, if there is one, and a frame of so many pixels; some files are broken.
APP1, FRAME = "FFE10036" + "457869660000" + "49492A0008000000" + "0100" + "32010200140000001A000000" + "00000000", "FFC0001108"
HEADER = f"""CASE WHEN id % 11 = 0 THEN '00' ELSE concat('FFD8', CASE WHEN raw IS NULL THEN 'FFFE0002' ELSE concat('{APP1}', rpad(hex(CAST(raw AS BINARY)), 40, '0')) END,
 '{FRAME}', lpad(hex(height), 4, '0'), lpad(hex(width), 4, '0'), '03', '011100021101031101', 'FFDA') END"""


@_register(_with("photos", raws=f"SELECT doc_id AS id, {RAW_DATE.format(s='VARCHAR')} AS raw FROM documents",
                 found=f"SELECT p.*, r.raw, (p.id % 4 = 0 OR e.ts > TIMESTAMP '{SCANNED}') AND p.id % 11 <> 0 AS again FROM photos p JOIN raws r USING (id) LEFT JOIN events e ON e.event_id = p.id") + f"""
 SELECT path, width, height, CASE WHEN again THEN CASE WHEN raw IS NULL THEN 27 ELSE 79 END ELSE file_size END AS file_size, format,
 CASE WHEN again THEN strftime(coalesce(try_strptime(raw, '%Y:%m:%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%dT%H:%M:%S') ELSE exif_date END AS exif_date
 FROM found WHERE coalesce(again, false) OR id % 4 <> 0""")  # fmt: skip
def scan_ingest(spark, d):
    """A scan of files by their headers: new and changed ones are read and stored, broken ones aren't, the others stay."""
    c = fixtures.catalog(spark, d)
    known = c.to(photos=c.photos.where("id % 4 <> 0").withColumn("scanned_at", F.lit(SCANNED)).select(*schema.PHOTOS.names))
    raws = fixtures.table(spark, d, "documents").selectExpr("doc_id as id", f"{RAW_DATE.format(s='STRING')} as raw")
    contents = c.photos.join(raws, "id").select("path", F.unhex(F.expr(HEADER)).alias("content"))
    stale = ingest.stale_files(fixtures.files_on_disk(spark, d), known.photos)
    found = ingest.written(ingest.analyse(contents.join(stale.select("path"), "path", "left_semi"), ingest.headers), "analysed")
    return ingest.store(known, found, SCANNED).photos.select("path", "width", "height", "file_size", "format", "exif_date")


@_register(_with("photos", raws=f"SELECT doc_id AS id, {RAW_DATE.format(s='VARCHAR')} AS raw FROM documents") + """
 SELECT path, CAST(width + CASE WHEN id % 30 = 0 THEN 1 ELSE 0 END AS INT) AS width, height, CASE WHEN raw IS NULL THEN 27 ELSE 79 END AS file_size, 'JPEG' AS format,
 strftime(coalesce(try_strptime(raw, '%Y:%m:%d %H:%M:%S'), try_strptime(raw, '%Y-%m-%d %H:%M:%S')), '%Y-%m-%dT%H:%M:%S') AS exif_date
 FROM photos JOIN raws USING (id) WHERE id % 11 <> 0""")  # fmt: skip
def file_stream_ingest(spark, d):
    """Files that come in three lots, a tenth of the first lot's changed with the second, some broken, scanned as a stream from lot to lot and stored once."""
    import uuid

    from ..sources.pictures import Store
    from ..streaming.scan import scan_stream
    from .materialize import run_dir

    base = f"{run_dir(spark)}/stream-{uuid.uuid4().hex}"
    raws = fixtures.table(spark, d, "documents").selectExpr("doc_id as id", f"{RAW_DATE.format(s='STRING')} as raw")
    photos = fixtures.catalog(spark, d).photos.join(raws, "id").select("id", "path", "width", "height", "raw")

    def put(frames):
        for pdf in frames:
            disk = Store(f"{base}/pictures")
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                disk.put(disk.root + path, bytes(content))
            yield pdf[["path"]]

    for lot in range(3):
        new = photos.where(F.col("id") % 3 == lot)
        if lot == 1:
            new = new.unionByName(photos.where("id % 30 = 0").withColumn("width", F.col("width") + 1))
        new.select("path", F.unhex(F.expr(HEADER)).alias("content")).mapInPandas(put, "path string").write.format("noop").mode("overwrite").save()
        query = scan_stream(spark, f"{base}/pictures", f"{base}/journal", f"{base}/checkpoint", lambda: SCANNED, files_per_trigger=2_000, hashed=False)
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    state = ingest.fold_journal(Catalog.empty(spark), f"{base}/journal")
    shown = F.substring_index("path", "/pictures/", -1)
    return state.photos.select(F.concat(F.lit("/"), shown).alias("path"), "width", "height", "file_size", "format", "exif_date")


@_register(_with(simhash=SIMHASH) + "SELECT d.doc_id AS id, CASE WHEN d.doc_id % 6 <> 3 THEN printf('%08x%08x', hi, lo) END AS phash FROM documents d LEFT JOIN simhash s USING (doc_id)")
def phash_backfill(spark, d):
    """Photos without a hash are the work list; those whose files can still be read get one."""
    c = _hashed_catalog(spark, d)
    hashed = ingest.written(c.photos.select("id", "path", "phash"), "hashed")
    cut = c.photos.drop("phash").join(hashed.select("id", F.when(F.col("id") % 3 != 0, F.col("phash")).alias("phash")), "id").select(*schema.PHOTOS.names)
    work = ingest.unhashed(cut)
    hashes_now = work.where("id % 2 = 0").join(hashed.select("id", "phash"), "id")
    return ingest.backfill_hashes(c.to(photos=cut), hashes_now).photos.select("id", "phash")


# ---------------------------------------------------------------- state transitions


def state_rows(c: Catalog) -> DataFrame:
    """Faces and clusters of a catalog as rows (kind, id, cluster_id, dismissed, name)."""
    faces = c.faces.select(F.lit("face").alias("kind"), "id", "cluster_id", "dismissed", F.lit(None).cast("string").alias("name"))
    return faces.unionByName(c.clusters.select(F.lit("cluster").alias("kind"), "id", F.lit(None).cast("long").alias("cluster_id"), F.lit(None).cast("int").alias("dismissed"), "name"))


def _state(cluster: str = "cluster_id", dismissed: str = "dismissed", faces: str = "true", clusters: str = "true", name: str = "name", new: str = "") -> str:
    return _with("faces", "clusters") + f"""SELECT 'face' AS kind, id, CAST({cluster} AS BIGINT) AS cluster_id, CAST({dismissed} AS INT) AS dismissed, CAST(NULL AS VARCHAR) AS name FROM faces WHERE {faces}
 UNION ALL SELECT 'cluster', id, NULL, NULL, {name} FROM clusters WHERE {clusters}{new}"""


def _after(name: str, sql: str, act: Callable[[Catalog], Catalog]) -> None:
    _on_catalog(name, sql, lambda c: state_rows(act(c)))


_after("after_merge", _state("CASE WHEN cluster_id = 3 THEN 1 ELSE cluster_id END", clusters="id <> 3"), lambda c: curation.merge_people(c, 1, 3))
_after("after_batch_merge", _state("CASE WHEN cluster_id IN (3, 7) THEN 1 ELSE cluster_id END", clusters="id NOT IN (3, 7)"), lambda c: curation.merge_many(c, 1, [3, 1, 7]))
_after("after_rename", _state(name="CASE WHEN id = 4 THEN 'Eve_Smith' ELSE name END"), lambda c: curation.rename(c, 4, names.sanitize(" Eve/Smith. ")))
_after("after_dismiss_face", _state("CASE WHEN id = 21 THEN NULL ELSE cluster_id END", "CASE WHEN id = 21 THEN 1 ELSE dismissed END"), lambda c: curation.dismiss_face(c, 21))
_after("after_dismiss_cluster", _state("CASE WHEN cluster_id = 5 THEN NULL ELSE cluster_id END", "CASE WHEN cluster_id = 5 THEN 1 ELSE dismissed END", clusters="id <> 5"), lambda c: curation.dismiss_cluster(c, 5)[0])
_after("after_split", _state("CASE WHEN id = 1 THEN 12 ELSE cluster_id END", new=" UNION ALL SELECT 'cluster', 12, NULL, NULL, 'Split_1'"), lambda c: curation.split_face(c, 1)[0])
_after("after_restore", _state(dismissed="CASE WHEN id = 17 THEN 0 ELSE dismissed END"), lambda c: curation.restore_face(c, 17))
_after("after_move_faces", _state("CASE WHEN id IN (2, 3, 4) THEN 6 ELSE cluster_id END"), lambda c: curation.move_faces(c, [2, 3, 4], 6)[0])
_after("after_move_face", _state("CASE WHEN id = 2 THEN 6 ELSE cluster_id END"), lambda c: curation.move_face(c, 2, 6))
_after("after_delete_photo", _state(faces="photo_id <> 7"), lambda c: curation.delete_photo(c, 7))
_after("after_clear", _state("NULL", clusters="false"), curation.clear_clusters)
_after("after_batch_assign", _state("CASE WHEN id % 10 = 1 THEN NULL WHEN id % 10 = 2 THEN 9 ELSE cluster_id END"),
       lambda c: curation.assign_faces(c, c.faces.where("id % 10 in (1, 2)").selectExpr("id as face_id", "case when id % 10 = 2 then 9L end as new_cluster_id")))
_on_catalog("invariants", _with("faces", "photos", "clusters") + """SELECT 'face without photo' AS invariant, id FROM faces WHERE photo_id NOT IN (SELECT id FROM photos)
 UNION ALL SELECT 'face without cluster', id FROM faces WHERE cluster_id NOT IN (SELECT id FROM clusters) UNION ALL SELECT 'dismissed face in a cluster', id FROM faces WHERE dismissed = 1 AND cluster_id IS NOT NULL""", Catalog.problems)  # fmt: skip


@_register(_with("photos") + "SELECT id, path, CAST(NULL AS VARCHAR) AS phash, CAST(NULL AS BIGINT) AS duplicate_group_id FROM photos")
def migrate_v4_v5(spark, d):
    c = fixtures.catalog(spark, d)
    old = {"photos": c.photos.drop("phash", "duplicate_group_id"), "faces": c.faces, "clusters": c.clusters}
    return schema.migrate(old, 4)["photos"].select("id", "path", "phash", "duplicate_group_id")


def _kept(name: str, sql: str, act: Callable[[Catalog], Catalog], read) -> None:
    """A query of a store's kept counts after a change that wrote only what it touched."""

    def run(spark, d):
        import uuid

        from .materialize import run_dir
        from .store import Store

        path = f"{run_dir(spark)}/store-{uuid.uuid4().hex}"
        store = Store.create(fixtures.catalog(spark, d), path)
        before = store.load()
        store.apply(before, act(before))
        return read(Store.open(spark, path))

    QUERIES[name], ORACLES[name] = run, sql


MOVED = "SELECT * REPLACE (CASE WHEN cluster_id = 3 THEN 1 ELSE cluster_id END AS cluster_id) FROM faces_before"
LEFT_OVER = dict(faces_before=fixtures.CTES["faces"], clusters_before=fixtures.CTES["clusters"], faces=MOVED, clusters="SELECT * FROM clusters_before WHERE id <> 3")
_kept("kept_face_counts", _with(**LEFT_OVER, counted=COUNTED) + "SELECT * FROM counted", lambda c: curation.merge_people(c, 1, 3), lambda s: s.clusters_with_counts())
_kept("kept_photo_counts", _with("photos", **LEFT_OVER) + """SELECT c.id AS cluster_id, count(DISTINCT p.path) AS photos FROM clusters c LEFT JOIN faces f ON f.cluster_id = c.id
 LEFT JOIN photos p ON p.id = f.photo_id GROUP BY c.id""", lambda c: curation.merge_people(c, 1, 3), lambda s: s.photo_counts())  # fmt: skip
_kept("kept_day_counts", _with("photos", "clusters", all_faces=fixtures.CTES["faces"], faces="SELECT * FROM all_faces WHERE photo_id <> 7", t=TIMELINE) + "SELECT day, count(*) AS faces FROM t GROUP BY day",
      lambda c: curation.delete_photo(c, 7), lambda s: s.day_counts())
_kept("kept_stats", _with("photos", all_faces=fixtures.CTES["faces"], all_clusters=fixtures.CTES["clusters"]) + """SELECT (SELECT count(*) FROM photos) AS photos, (SELECT count(*) FROM all_clusters) - 1 AS clusters,
 count(*) FILTER (WHERE gone = 0) AS faces, count(*) FILTER (WHERE gone = 0 AND cluster_id IS NULL) AS unclustered_faces, count(*) FILTER (WHERE gone = 1) AS dismissed_faces
 FROM (SELECT cluster_id, CASE WHEN cluster_id = 5 THEN 1 ELSE dismissed END AS gone FROM all_faces)""", lambda c: curation.dismiss_cluster(c, 5)[0], lambda s: s.stats())  # fmt: skip

UPSERT_FROM = "id % 100 = 7"


@_register(_with("photos", "faces", top="SELECT (SELECT max(id) FROM photos) AS p, (SELECT max(id) FROM faces) AS f") + f"""
 SELECT 'photo' AS kind, id, path, 0 AS num_faces FROM photos WHERE NOT {UPSERT_FROM}
 UNION ALL SELECT 'photo', top.p + row_number() OVER (ORDER BY path), path, 1 FROM photos, top WHERE {UPSERT_FROM}
 UNION ALL SELECT 'face', f.id, NULL, NULL FROM faces f WHERE f.photo_id NOT IN (SELECT id FROM photos WHERE {UPSERT_FROM})
 UNION ALL SELECT 'face', top.f + row_number() OVER (ORDER BY path), NULL, NULL FROM photos, top WHERE {UPSERT_FROM}""")
def upsert_rescan(spark, d):
    """Photos scanned again get new rows and one new face each; their old faces go."""
    c = fixtures.catalog(spark, d)
    box = F.array(F.expr("named_struct('x', 1d, 'y', 2d, 'w', 50d, 'h', 60d, 'score', 0.95d, 'embedding', array(1f))"))
    again = c.photos.where(UPSERT_FROM).select("path", "file_size", "width", "height", "format", F.lit(None).cast("string").alias("exif_text"), F.lit(None).cast("string").alias("phash"), F.lit(None).cast("string").alias("error"), F.lit(1.0).alias("scale"), box.alias("boxes"))
    s = ingest.store(c, again, SCANNED)
    photos = s.photos.select(F.lit("photo").alias("kind"), "id", "path", F.coalesce("num_faces", F.lit(0)).alias("num_faces"))
    return photos.unionByName(s.faces.select(F.lit("face").alias("kind"), "id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("num_faces")))


@_register(_with("faces", u=ACTIVE_UNITS, cent=CENTROIDS, near=NEAREST) + f"SELECT CASE WHEN dist <= {NEAR} THEN cluster_id END AS cluster_id, count(*) AS faces FROM near GROUP BY 1")
def ingest_stream_counts(spark, d):
    """Vectors streamed in micro-batches against the catalog's centroids: faces by cluster."""
    import uuid

    from ..streaming.ingest import assign_stream
    from .materialize import shared_dir, written

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    c = fixtures.catalog(spark, d)
    clustering.unassigned(c).repartition(4).write.parquet(f"{base}/in")
    source = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 2).parquet(f"{base}/in")
    assign_stream(source, written(clustering.centroids(c), "centroids"), NEAR, f"{base}/out", f"{base}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{base}/out").groupBy("cluster_id").agg(F.count(F.lit(1)).alias("faces"))


_STEP = "SELECT u.id, min_by(k.cluster_id, (1 - list_dot_product(u.e, k.c), k.cluster_id)) AS cluster_id, min(1 - list_dot_product(u.e, k.c)) AS dist FROM {rows} u JOIN {cent} k ON true GROUP BY u.id HAVING min(1 - list_dot_product(u.e, k.c)) <= " + str(NEAR)


@_register(_with("faces", u=ACTIVE_UNITS, cent=CENTROIDS, b0="SELECT id, e FROM u WHERE cluster_id IS NULL AND id % 2 = 0", n0=_STEP.format(rows="b0", cent="cent"),
                 cent1=_mean("SELECT coalesce(f.cluster_id, n0.cluster_id) AS cluster_id, CAST(f.embedding AS DOUBLE[]) AS v FROM faces f LEFT JOIN n0 USING (id) WHERE f.dismissed = 0 AND coalesce(f.cluster_id, n0.cluster_id) IS NOT NULL", "cluster_id"),
                 b1="SELECT id, e FROM u WHERE cluster_id IS NULL AND id NOT IN (SELECT id FROM n0)", n1=_STEP.format(rows="b1", cent="cent1")) + """
 SELECT id, cluster_id, 0 AS batch FROM n0 UNION ALL SELECT id, cluster_id, 1 FROM n1""")  # fmt: skip
def growing_centroids(spark, d):
    """Vectors in two micro-batches against centroids that the first one moves; what it left waits for the second."""
    import uuid

    from ..streaming.centroids import GrowingClusters
    from .materialize import run_dir

    base = f"{run_dir(spark)}/growing-{uuid.uuid4().hex}"
    c = fixtures.catalog(spark, d)
    grown = GrowingClusters(spark, base, NEAR, least=1 << 40)
    grown.start(c.active.where("cluster_id is not null").select("cluster_id", "embedding"))
    for lot in (0, 1):
        clustering.unassigned(c).where(F.col("id") % 2 == lot).coalesce(1).write.mode("append").parquet(f"{base}/in")
        source = spark.readStream.schema("id long, embedding array<float>").option("maxFilesPerTrigger", 1).parquet(f"{base}/in")
        grown.run(source, f"{base}/checkpoint").awaitTermination()
    return grown.placed().select("id", "cluster_id", "batch")
