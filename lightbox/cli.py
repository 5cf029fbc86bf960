"""Command line over a saved catalog: ``python -m lightbox.cli <command> ... --catalog DIR``.

A catalog is a folder of Parquet tables. A command that changes it writes the new state next to
it and swaps the folders, so a failure leaves the old one whole."""

from __future__ import annotations

import argparse
import json
import logging
import os
import shutil
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from . import __version__
from .catalog import Catalog
from .operators import clustering, curation, duplicates, export, ingest
from .plans import materialize, views
from .plans.store import Store
from .sources import files

log = logging.getLogger("lightbox")


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lightbox").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def opened(spark: SparkSession, path: str) -> Catalog:
    if not os.path.isdir(os.path.join(path, "meta")):
        print(f"No catalog at {path}. Run 'scan' first.", file=sys.stderr)
        raise SystemExit(1)
    return Store.open(spark, path).load() if "buckets" in json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta").collect())) else Catalog.load(spark, path)


def saved(catalog: Catalog, path: str, before: Catalog | None = None) -> None:
    """Keeps a state; of the one that was opened there as ``before`` only the buckets that differ are written."""
    spark = catalog.photos.sparkSession
    if before is not None and "buckets" in json.loads("\n".join(r[0] for r in spark.read.text(f"{path}/meta").collect())):
        Store.open(spark, path).apply(before, catalog)
        return
    new, old = f"{path}.new-{os.getpid()}", f"{path}.old-{os.getpid()}"
    catalog.save(new)
    if os.path.isdir(path):
        os.rename(path, old)
    os.rename(new, path)
    shutil.rmtree(old, ignore_errors=True)


def settings_path(catalog: str) -> str:
    return os.path.abspath(catalog) + "-settings.json"


def log_path(catalog: str) -> str:
    return os.path.abspath(catalog) + ".log"


def journal_path(catalog: str) -> str:
    return os.path.abspath(catalog) + "-journal"


def now() -> str:
    return time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime())


def committed(spark: SparkSession, path: str) -> Callable[[Catalog], Catalog]:
    """Saves a state and goes on from what was saved."""

    def save(catalog: Catalog) -> Catalog:
        saved(catalog, path)
        return Catalog.load(spark, path)

    return save


def scan(spark, args, analyser: Callable | None = None) -> int:
    exists = os.path.isdir(os.path.join(args.catalog, "meta"))
    catalog = Catalog.load(spark, args.catalog) if exists else Catalog.empty(spark)
    show_progress = lambda **c: log.info("%s of %s", c["processed"] + c["errors"], c["total"] - c["skipped"])
    save = committed(spark, args.catalog)
    state, counts = ingest.scan(catalog, args.folder, now(), analyser, not args.flat, args.commit, save, show_progress, min_face=args.min_face, journal=journal_path(args.catalog))
    if not exists and not counts["processed"]:
        save(state)
    print(", ".join(f"{k}: {v}" for k, v in counts.items()))
    return 0


def backfill(spark, args) -> int:
    _, n = ingest.backfill(opened(spark, args.catalog), args.commit, committed(spark, args.catalog), lambda done, of: log.info("%s of %s", done, of))
    print(f"{n} photos got a hash")
    return 0


def serve(spark, args) -> int:
    from .server import serve as made

    opened(spark, args.catalog)
    server = made(spark, args.catalog, args.port)
    print(f"http://127.0.0.1:{server.server_port}/")
    try:
        server.serve_forever()
    except KeyboardInterrupt:
        server.server_close()
    return 0


def cluster(spark, args) -> int:
    catalog = opened(spark, args.catalog)
    if args.incremental:
        state, counts = clustering.incremental_clustering(catalog, args.threshold, args.min_size)
        print(", ".join(f"{k}: {v}" for k, v in counts.items()))
    else:
        state, n = clustering.full_clustering(catalog, args.threshold, args.min_size)
        print(f"{n} clusters" if n else "No clusters formed; a higher threshold joins more.")
    saved(state, args.catalog, catalog)
    return 0


def show(spark, args) -> int:
    catalog = opened(spark, args.catalog)
    row = views.catalog_stats(catalog).first().asDict()
    print(", ".join(f"{k}: {v}" for k, v in row.items()))
    found = views.clusters_with_counts(catalog)
    for r in found.limit(20).collect():
        print(f"{r['id']:>6}  {r['face_count']:>6}  {r['name']}")
    if row["clusters"] > 20:
        print(f"... and {row['clusters'] - 20} more")
    return 0


def stats(spark, args) -> int:
    row = views.catalog_stats(opened(spark, args.catalog)).drop("dismissed_faces").first().asDict()
    print("\n".join(f"{k}: {v}" for k, v in row.items()))
    return 0


def find_duplicates(spark, args) -> int:
    """Photos without a hash get one from their files first, where these can still be read."""
    catalog = opened(spark, args.catalog)
    full, filled = ingest.backfill(catalog) if ingest.unhashed(catalog.photos).limit(1).count() else (catalog, 0)
    state, n = duplicates.detect_duplicates(full, args.threshold)
    saved(state, args.catalog, catalog)
    if filled:
        print(f"{filled} photos got a hash")
    print(f"{n} duplicate groups")
    return 0


def list_duplicates(spark, args) -> int:
    catalog = opened(spark, args.catalog)
    groups = views.duplicate_groups(catalog)
    n = groups.count()
    for g in groups.limit(20).collect():
        print(f"Group {g['id']}: {g['photo_count']} photos")
        for p in views.duplicate_photos(catalog, g["id"]).collect():
            print(f"  {p['file_size'] / 1024:.1f} KB  {p['path']}")
    if n > 20:
        print(f"... and {n - 20} more groups")
    if not n:
        print("No duplicate groups.")
    return 0


def export_people(spark, args) -> int:
    summary = export.run_export(opened(spark, args.catalog), args.output, args.symlink)
    for name, n in summary.items():
        print(f"{name}: {n}")
    print(f"{sum(summary.values())} pictures")
    return 0


def change(action: Callable) -> Callable:
    """A command that applies ``action(catalog, args) -> (catalog, message)`` and saves."""

    def run(spark, args) -> int:
        catalog = opened(spark, args.catalog)
        try:
            state, message = action(catalog, args)
        except curation.ActionError as e:
            print(f"Error: {e}", file=sys.stderr)
            return 1
        saved(state, args.catalog, catalog)
        print(message)
        return 0

    return run


def _rename(c, a):
    state, result = curation.rename_person_full(c, a.cluster, a.name)
    if result is None:
        raise curation.ActionError(f"cluster {a.cluster} not found", 404)
    return state, f"Renamed {a.cluster} to {result['name']}" + (f" (absorbed {result['absorbed_faces']} faces, merged {result['merged_clusters']} clusters)" if "absorbed_faces" in result else "")


def _dismiss_cluster(c, a):
    state, n = curation.dismiss_cluster(c, a.cluster)
    return state, f"Dismissed {n} faces"


def _split(c, a):
    state, result = curation.split_face(c, a.face, a.name)
    return state, f"Face {a.face} is now {result['name']} ({result['cluster_id']})"


def _recluster(c, a):
    state, result = curation.recluster_person(c, a.cluster, a.threshold, a.min_size)
    return state, ", ".join(f"{k}: {v}" for k, v in result.items())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lightbox")
    top.add_argument("--version", action="version", version=__version__)
    top.add_argument("-v", "--verbose", action="count", default=0)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        p.add_argument("--catalog", default="./.lightbox")
        for flags, options in arguments:
            p.add_argument(*flags, **options)
        p.set_defaults(run=run)

    number = lambda n: ((n,), {"type": int})
    eps = (("--threshold",), {"type": float, "default": clustering.EPS})
    least = (("--min-size",), {"type": int, "default": clustering.MIN_SAMPLES})
    commit = (("--commit",), {"type": int, "default": ingest.COMMIT})
    add("scan", scan, (("folder",), {}), (("--flat",), {"action": "store_true"}), (("--min-face",), {"type": int, "default": None}), commit)
    add("backfill-hashes", backfill, commit)
    add("serve", serve, (("--port",), {"type": int, "default": 5050}))
    add("cluster", cluster, eps, least, (("--incremental",), {"action": "store_true"}))
    add("show", show)
    add("stats", stats)
    add("find-duplicates", find_duplicates, (("--threshold",), {"type": int, "default": duplicates.BITS}))
    add("duplicates", list_duplicates)
    add("export", export_people, (("output",), {}), (("--symlink",), {"action": "store_true"}))
    add("rename", change(_rename), number("cluster"), (("name",), {}))
    add("dismiss", change(lambda c, a: ((curation.restore_face if a.restore else curation.dismiss_face)(c, a.face), f"{'Restored' if a.restore else 'Dismissed'} face {a.face}")), number("face"), (("--restore",), {"action": "store_true"}))
    add("dismiss-cluster", change(_dismiss_cluster), number("cluster"))
    add("delete-photo", change(lambda c, a: (curation.delete_photo(c, a.photo, files.recycle), f"Deleted photo {a.photo}")), number("photo"))
    add("merge", change(lambda c, a: (curation.merge_people(c, a.keep, a.merge), f"Merged {a.merge} into {a.keep}")), number("keep"), number("merge"))
    add("split", change(_split), number("face"), (("--name",), {"default": ""}))
    add("recluster", change(_recluster), number("cluster"), eps, least)
    add("move", change(lambda c, a: (curation.move_faces(c, a.faces, a.cluster)[0], f"Moved {len(a.faces)} faces")), number("cluster"), (("faces",), {"type": int, "nargs": "+"}))
    add("check", lambda spark, a: (opened(spark, a.catalog).problems().show(100, False), 0)[1])
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(2, args.verbose)], format="%(asctime)s %(levelname)s %(name)s: %(message)s")
    kept = logging.FileHandler(log_path(args.catalog), delay=True)
    kept.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s"))
    log.addHandler(kept)
    spark = session()
    try:
        return args.run(spark, args)
    finally:
        materialize.discard(spark)
        log.removeHandler(kept)


if __name__ == "__main__":
    sys.exit(main())
