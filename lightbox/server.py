"""A small JSON server over a saved catalog, on the standard library: ``python -m lightbox.server --catalog DIR``.

Reads answer at once; what changes the catalog runs under one lock and saves; scans and clustering run as tasks."""

from __future__ import annotations

import argparse
import json
import mimetypes
import os
import re
import shutil
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qsl

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cli
from .catalog import Catalog
from .operators import clustering, curation, duplicates, export, ingest
from .operators.curation import ActionError, require_int
from .plans import views
from .sources import files
from .sources.thumbnails import thumbnail
from .streaming.tasks import Tasks

PAGE = 200


def rows(df: DataFrame, most: int = PAGE) -> list[dict]:
    """One page; a page's rows are what the driver may hold."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


class App:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.lock, self.tasks = spark, path, threading.Lock(), Tasks(spark)

    def catalog(self) -> Catalog:
        return Catalog.load(self.spark, self.path)

    def change(self, action) -> dict:
        with self.lock:
            before = self.catalog()
            state, result = action(before)
            cli.saved(state, self.path, before)
        return {"ok": True} | (result or {})

    def background(self, kind: str, action) -> dict:
        return {"task_id": self.tasks.submit(kind, lambda task: self.change(action)).id}

    def settings(self) -> files.Settings:
        return files.Settings.load(cli.settings_path(self.path))

    def configure(self, body: dict) -> dict:
        """The known fields of ``body`` changed, if all values are in range."""
        found = self.settings()
        for name, value in body.items():
            if name in found.__dataclass_fields__:
                setattr(found, name, type(getattr(found, name))(value))
        found.checked().save(cli.settings_path(self.path))
        return found.__dict__ | {"ok": True}

    def scan(self, folder: str, recursive: bool) -> dict:
        """A scan as a task: every lot is written, progress is shown, and a stop is heeded between lots."""
        if not os.path.isdir(folder):
            raise ActionError("folder not found", 400)
        found = self.settings()
        found.remember(folder)
        found.save(cli.settings_path(self.path))

        def run(task):
            with self.lock:
                catalog = self.catalog() if os.path.isdir(os.path.join(self.path, "meta")) else Catalog.empty(self.spark)
                _, counts = ingest.scan(catalog, folder, cli.now(), recursive=recursive, save=cli.committed(self.spark, self.path), on_progress=task.report, stop=task.stop.is_set, confidence=found.confidence, min_face=found.min_face, journal=cli.journal_path(self.path))
            task.report(last=True, **counts)
            return counts

        return {"task_id": self.tasks.submit("scan", run).id}

    def backfill(self) -> dict:
        def run(task):
            with self.lock:
                _, n = ingest.backfill(self.catalog(), save=cli.committed(self.spark, self.path), on_progress=lambda done, of: task.report(done=done, total=of), stop=task.stop.is_set)
            return {"updated": n}

        return {"task_id": self.tasks.submit("backfill", run).id}

    def export(self, output: str, symlink: bool) -> dict:
        if not output:
            raise ActionError("output is missing", 400)

        def run(task):
            summary = export.run_export(self.catalog(), output, symlink, lambda done, of: task.report(done=done, total=of), task.stop.is_set)
            return {"exported": sum(summary.values()), "summary": summary}

        return {"task_id": self.tasks.submit("export", run).id}

    def picture(self, kind: str, number: int) -> str:
        """The path of a picture file to show: a photo itself, or the thumbnail of a photo or a face."""
        c, cache = self.catalog(), os.path.abspath(self.path) + "-thumbnails"
        found = views.face_by_id(c, number).first() if kind == "face" else c.photos.where(F.col("id") == number).first()
        if found is None:
            raise ActionError(f"{kind} not found", 404)
        box = tuple(found[f"bbox_{k}"] for k in "xywh") if kind == "face" else None
        made = found["path"] if kind == "file" else thumbnail(self.spark, cache, kind, number, found["path"], box)
        if made is None or not os.path.exists(made):
            raise ActionError("picture not found", 404)
        return made

    def logs(self, n: int) -> list[str]:
        path = cli.log_path(self.path)
        return [r["line"] for r in files.log_tail(self.spark, path, n).collect()] if os.path.exists(path) else []

    def get(self, path: str, query: dict) -> dict | list | None:
        c = self.catalog
        simple = {
            "/api/stats": lambda: rows(views.catalog_stats(c()))[0],
            "/api/dashboard": lambda: rows(views.dashboard(c())),
            "/api/people": lambda: rows(views.people(c(), query.get("kind", "all"), query.get("q", ""), query.get("sort", "faces-desc"), require_int(query.get("page", 0), "page"))),
            "/api/review": lambda: rows(views.top_faces(c(), 6)),
            "/api/timeline": lambda: rows(views.timeline(c(), query.get("q", ""))),
            "/api/timeline/days": lambda: rows(views.timeline_days(c(), query.get("q", ""))),
            "/api/timeline/years": lambda: [r["year"] for r in rows(views.timeline_years(c()))],
            "/api/dismissed": lambda: rows(views.dismissed_faces(c())),
            "/api/duplicates": lambda: rows(views.duplicate_groups(c())),
            "/api/browse": lambda: files.browse(query.get("path", ".")),
            "/api/settings": lambda: self.settings().__dict__,
            "/api/logs": lambda: {"lines": self.logs(require_int(query.get("n", 200), "n"))},
        }
        if path in simple:
            return simple[path]()
        if m := re.fullmatch(r"/api/person/(\d+)", path):
            found = rows(views.cluster_by_id(c(), int(m[1])))
            if not found:
                raise ActionError("cluster not found", 404)
            return found[0] | {"faces": rows(views.faces_for_cluster(c(), int(m[1]))), "photos": rows(views.photos_for_cluster(c(), int(m[1])))}
        if m := re.fullmatch(r"/api/duplicates/(\d+)", path):
            return rows(views.duplicate_photos(c(), int(m[1])))
        if m := re.fullmatch(r"/api/task/(\w+)", path):
            task = self.tasks.get(m[1])
            if task is None:
                raise ActionError("task not found", 404)
            return task.as_dict()
        return None

    def post(self, path: str, body: dict) -> dict | None:
        def number(name: str) -> int:
            return require_int(body.get(name), name)

        def numbers(name: str) -> list[int]:
            return [require_int(x, name) for x in body.get(name) or []]

        def rename(c: Catalog):
            state, result = curation.rename_person_full(c, number("cluster_id"), str(body.get("name", "")))
            if result is None:
                raise ActionError("cluster not found", 404)
            return state, result

        def dismiss_cluster(c: Catalog):
            state, n = curation.dismiss_cluster(c, number("cluster_id"))
            return state, {"dismissed": n}

        def moved(c: Catalog):
            state, n = curation.move_faces(c, numbers("face_ids"), number("cluster_id"))
            return state, {"moved": n}

        eps = float(body.get("eps", clustering.EPS))
        actions = {
            "/api/rename": rename,
            "/api/merge": lambda c: (curation.merge_people(c, number("keep_id"), number("merge_id")), None),
            "/api/split": lambda c: curation.split_face(c, number("face_id"), str(body.get("name", ""))),
            "/api/split-batch": lambda c: curation.split_faces(c, numbers("face_ids"), str(body.get("name", "")), eps),
            "/api/move-face": lambda c: (curation.move_face(c, number("face_id"), number("cluster_id")), None),
            "/api/move-faces": moved,
            "/api/recluster": lambda c: curation.recluster_person(c, number("cluster_id"), eps),
            "/api/dismiss-cluster": dismiss_cluster,
            "/api/dismiss": lambda c: (curation.dismiss_face(c, number("face_id")), None),
            "/api/restore": lambda c: (curation.restore_face(c, number("face_id")), None),
            "/api/delete-photo": lambda c: (curation.delete_photo(c, number("photo_id"), files.recycle), None),
        }
        if path in actions:
            return self.change(actions[path])
        if path == "/api/cluster":
            if body.get("incremental"):
                return self.background("cluster", lambda c: clustering.incremental_clustering(c, eps, maybe_eps=body.get("maybe_eps")))
            return self.background("cluster", lambda c: (lambda r: (r[0], {"clusters": r[1]}))(clustering.full_clustering(c, eps)))
        if path == "/api/detect-duplicates":
            return self.background("duplicates", lambda c: (lambda r: (r[0], {"groups": r[1]}))(duplicates.detect_duplicates(c, int(body.get("threshold", duplicates.BITS)))))
        if path == "/api/scan":
            return self.scan(str(body.get("folder", "")), bool(body.get("recursive", True)))
        if path == "/api/backfill-hashes":
            return self.backfill()
        if path == "/api/export":
            return self.export(str(body.get("output", "")), bool(body.get("symlink", False)))
        if path == "/api/settings":
            return self.configure(body)
        if path == "/api/logs/clear":
            files.truncate_log(cli.log_path(self.path))
            return {"ok": True}
        if m := re.fullmatch(r"/api/task/(\w+)/cancel", path):
            return {"cancelled": self.tasks.cancel(m[1])}
        return None


def handler(app: App) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def log_message(self, *args) -> None:
            pass

        def answer(self, status: int, payload) -> None:
            data = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def respond(self, make) -> None:
            try:
                found = make()
                self.answer(200 if found is not None else 404, found if found is not None else {"error": "not found"})
            except ActionError as e:
                self.answer(e.status, {"error": str(e)})
            except (ValueError, KeyError) as e:
                self.answer(400, {"error": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            path, _, query = self.path.partition("?")
            if m := re.fullmatch(r"/api/task/(\w+)/stream", path):
                self.send_response(200)
                self.send_header("Content-Type", "text/event-stream")
                self.end_headers()
                for event in app.tasks.events(m[1]):
                    self.wfile.write(event.encode())
                    self.wfile.flush()
                return
            if m := re.fullmatch(r"/api/picture/(file|photo|face)/(\d+)", path):
                try:
                    made = app.picture(m[1], int(m[2]))
                except ActionError as e:
                    return self.answer(e.status, {"error": str(e)})
                self.send_response(200)
                self.send_header("Content-Type", mimetypes.guess_type(made)[0] or "application/octet-stream")
                self.send_header("Content-Length", str(os.path.getsize(made)))
                self.end_headers()
                with open(made, "rb") as f:
                    return shutil.copyfileobj(f, self.wfile)
            self.respond(lambda: app.get(path, dict(parse_qsl(query))))

        def do_POST(self) -> None:  # noqa: N802
            size = int(self.headers.get("Content-Length") or 0)
            self.respond(lambda: app.post(self.path, json.loads(self.rfile.read(size) or b"{}")))

    return Handler


def serve(spark: SparkSession, path: str, port: int = 0) -> ThreadingHTTPServer:
    """A server that isn't started yet, on this machine only; its port is ``server_port``."""
    return ThreadingHTTPServer(("127.0.0.1", port), handler(App(spark, path)))


def main() -> None:
    p = argparse.ArgumentParser(prog="lightbox.server")
    p.add_argument("--catalog", default="./.lightbox")
    p.add_argument("--port", type=int, default=5050)
    args = p.parse_args()
    serve(cli.session(), args.catalog, args.port).serve_forever()


if __name__ == "__main__":
    main()
