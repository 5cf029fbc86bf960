import os
import time

import pytest

from lightbox import cli
from lightbox.catalog import Catalog
from lightbox.operators import export, ingest
from lightbox.sources import files


@pytest.fixture()
def folder(tmp_path):
    for name in ("b.JPG", "a.png", "note.txt", "sub/c.jpeg", ".lightbox/x.jpg"):
        p = tmp_path / "pics" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"data-" + name.encode())
    return tmp_path / "pics"


def stubs():
    """A factory that goes to the workers by value."""

    def look(path, content):
        if path.endswith("a.png"):
            raise ValueError("broken")
        box = {"x": -4.0, "y": 10.0, "w": 30.0, "h": 30.0, "score": 0.95, "embedding": [1.0, 0.0]}
        weak, tiny = box | {"score": 0.5}, box | {"w": 5.0}
        return {"file_size": len(content), "width": 100, "height": 80, "format": "JPEG", "exif_text": "2020:01:02 03:04:05", "scale": 0.5, "boxes": [box, weak, tiny]}

    return lambda: look


def test_discovery(spark, folder):
    got = [os.path.relpath(r["path"], folder) for r in files.discover(spark, str(folder)).collect()]
    assert got == ["a.png", "b.JPG", "sub/c.jpeg"]
    assert [os.path.basename(r["path"]) for r in files.discover(spark, str(folder), recursive=False).collect()] == ["a.png", "b.JPG"]


def test_scan_stores_skips_and_isolates_errors(spark, folder):
    found = files.discover(spark, str(folder), content=True)
    c = Catalog.empty(spark)
    stale = ingest.stale_files(found.select("path", "mtime"), c.photos)
    analysed = ingest.analyse(found, stubs())
    assert ingest.scan_counts(found, stale, analysed) == {"total": 3, "skipped": 0, "processed": 2, "errors": 1, "faces_found": 6}
    now = time.strftime("%Y-%m-%d %H:%M:%S", time.gmtime(time.time() + 5))
    c = ingest.store(c, analysed, now).settled()
    assert [(r["id"], os.path.basename(r["path"]), r["num_faces"], r["exif_date"]) for r in c.photos.orderBy("id").collect()] == [(1, "b.JPG", 1, "2020-01-02T03:04:05"), (2, "c.jpeg", 1, "2020-01-02T03:04:05")]
    assert [(r["bbox_x"], r["bbox_y"], r["bbox_w"], r["bbox_h"]) for r in c.faces.collect()] == [(0, 20, 60, 60)] * 2
    # the failed file is tried again, the others are fresh
    assert [os.path.basename(r["path"]) for r in ingest.stale_files(found.select("path", "mtime"), c.photos).collect()] == ["a.png"]
    again = ingest.store(c, analysed.where("path like '%b.JPG'"), now)
    assert sorted(r["id"] for r in again.photos.collect()) == [2, 3] and sorted(r["id"] for r in again.faces.collect()) == [2, 3]


def png(gray, text: bytes = b"") -> bytes:
    """A gray picture file, with an EXIF block if there is a text."""
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    raw = b"".join(b"\0" + bytes(int(v) for v in row) for row in gray)
    exif = chunk(b"eXIf", b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 0x0132, 2, 20, 26) + bytes(4) + text.ljust(20, b"\0")) if text else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", len(gray[0]), len(gray), 8, 0, 0, 0, 0)) + exif + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def jpeg(width, height, taken=None, big_endian=False) -> bytes:
    """Header segments only: an EXIF directory within the first directory, and a frame."""
    import struct

    o = ">" if big_endian else "<"
    text = (taken or "").encode() + b"\0"
    tiff = (b"MM\0*" if big_endian else b"II*\0") + struct.pack(o + "I", 8) + struct.pack(o + "HHHII", 1, 0x8769, 4, 1, 26) + bytes(4)
    tiff += struct.pack(o + "HHHII", 1, 0x9003, 2, len(text), 44) + bytes(4) + text
    app1 = b"Exif\0\0" + tiff if taken else b"other"
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(app1) + 2) + app1 + b"\xff\xff\xc2" + struct.pack(">HBHHB", 11, 8, height, width, 1) + b"\1\x11\0" + b"\xff\xda"


def test_headers_tell_format_size_and_time():
    import struct

    from lightbox.functions.media import described

    d = lambda data: tuple(described(data)[k] for k in ("format", "width", "height", "exif_text"))
    assert d(jpeg(640, 480, "2021:05:06 07:08:09")) == ("JPEG", 640, 480, "2021:05:06 07:08:09") == d(jpeg(640, 480, "2021:05:06 07:08:09", True))
    assert d(jpeg(7, 5)) == ("JPEG", 7, 5, None) and d(b"\xff\xd8\xff\xe1\0") == ("JPEG", None, None, None)
    assert d(png([[1, 2, 3]] * 2, b"2020:01:02 03:04:05")) == ("PNG", 3, 2, "2020:01:02 03:04:05")
    assert d(b"BM" + bytes(16) + struct.pack("<ii", 9, -4)) == ("BMP", 9, 4, None)
    assert d(b"RIFF\0\0\0\0WEBPVP8X" + struct.pack("<I", 10) + bytes(4) + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")) == ("WEBP", 100, 50, None)
    tiff = b"II*\0\x08\0\0\0" + struct.pack("<H", 2) + struct.pack("<HHIHH", 0x100, 3, 1, 33, 0) + struct.pack("<HHII", 0x101, 4, 1, 44) + bytes(4)
    assert d(tiff) == ("TIFF", 33, 44, None) and d(tiff[:16]) == ("TIFF", None, None, None)
    for bad in (b"", b"text", b"GIF89a"):
        with pytest.raises(ValueError):
            described(bad)


def test_scan_fills_the_catalog_in_commits(spark, tmp_path, capsys, monkeypatch):
    import numpy as np

    r = np.random.RandomState(0)
    small = np.kron(r.randint(0, 255, (8, 8)), np.ones((8, 8), dtype=int))
    other = np.kron(r.randint(0, 255, (8, 8)), np.ones((8, 8), dtype=int))
    folder, cat = tmp_path / "pics", str(tmp_path / "cat")
    folder.mkdir()
    for name, data in {"a.png": png(small, b"2020:01:02 03:04:05"), "b[1].PNG": png(np.kron(small, np.ones((2, 2), dtype=int))), "c.png": png(other), "d.jpg": jpeg(30, 20, "2019:01:01 00:00:00"), "e.png": b"broken", "note.txt": b"x"}.items():
        (folder / name).write_bytes(data)
        os.utime(folder / name, (1_700_000_000, 1_700_000_000))
    monkeypatch.setattr(cli, "session", lambda: spark)
    monkeypatch.setattr(cli.materialize, "discard", lambda spark: None)
    assert cli.main(["-v", "scan", str(folder), "--catalog", cat, "--commit", "2"]) == 0
    assert capsys.readouterr().out.strip() == "total: 5, skipped: 0, processed: 4, errors: 1, faces_found: 0"
    rows = {os.path.basename(x["path"]): x for x in Catalog.load(spark, cat).photos.collect()}
    assert [(n, x["width"], x["height"], x["format"], x["exif_date"]) for n, x in sorted(rows.items())] == [
        ("a.png", 64, 64, "PNG", "2020-01-02T03:04:05"), ("b[1].PNG", 128, 128, "PNG", None), ("c.png", 64, 64, "PNG", None), ("d.jpg", 30, 20, "JPEG", "2019-01-01T00:00:00"),
    ]
    assert rows["a.png"]["file_size"] == (folder / "a.png").stat().st_size and rows["d.jpg"]["phash"] is None and rows["a.png"]["phash"] == rows["b[1].PNG"]["phash"] != rows["c.png"]["phash"]
    assert cli.main(["find-duplicates", "--catalog", cat]) == 0 and "1 duplicate groups" in capsys.readouterr().out
    # fresh files are skipped, failed ones tried again; hashes that are missing are filled from the files
    assert cli.main(["scan", str(folder), "--catalog", cat]) == 0 and capsys.readouterr().out.strip() == "total: 5, skipped: 4, processed: 0, errors: 1, faces_found: 0"
    c = Catalog.load(spark, cat)
    cut = ingest.written(c.photos.withColumn("phash", ingest.F.when(ingest.F.col("path").contains("c.png"), ingest.F.col("phash"))), "t")
    assert sorted(os.path.basename(x["path"]) for x in ingest.unhashed(cut).collect()) == ["a.png", "b[1].PNG", "d.jpg"]
    (folder / "a.png").unlink()
    seen = []
    back, n = ingest.backfill(c.to(photos=cut), 2, on_progress=lambda done, of: seen.append((done, of)))
    assert n == 1 and seen == [(2, 3), (3, 3)]
    assert {os.path.basename(x["path"]): x["phash"] for x in back.photos.collect()} == {n: x["phash"] if n[0] in "bc" else None for n, x in rows.items()}
    # a scan that is stopped keeps the lots before
    stops = iter([False, True])
    state, counts = ingest.scan(Catalog.empty(spark), str(folder), "2999-01-01 00:00:00", commit=2, stop=lambda: next(stops))
    assert counts["processed"] == 2 and state.photos.count() == 2
    # one that breaks off leaves its lots to the next one, with the time of their scan
    journal, stops = str(tmp_path / "journal"), iter([False])
    with pytest.raises(StopIteration):
        ingest.scan(Catalog.empty(spark), str(folder), "2001-01-01 00:00:00", commit=2, stop=lambda: next(stops), journal=journal)
    assert sorted(os.listdir(journal)) == ["lot-00000000"]
    state, counts = ingest.scan(Catalog.empty(spark), str(folder), "2999-01-01 00:00:00", journal=journal, stop=lambda: True)
    assert counts["processed"] == 0 and {r["scanned_at"] for r in state.photos.collect()} == {"2001-01-01 00:00:00"} and state.photos.count() == 2 and not os.path.exists(journal)


def test_objects_of_pictures_by_a_table_function(spark):
    import numpy as np

    def detector():
        return lambda image: [{"x": 1, "y": 1, "w": 4, "h": 4, "score": 0.9}, {"x": 2, "y": 1, "w": 4, "h": 4, "score": 0.8}, {"x": 8, "y": 8, "w": 2, "h": 2, "score": 0.7}] if image.shape[0] > 5 else []

    spark.udtf.register("objects", ingest.object_table(detector, lambda: lambda part: np.array([part.mean(), part.shape[0]])))
    image = np.full((12, 12, 3), 7, dtype=np.uint8)
    spark.createDataFrame([(1, 12, 12, 3, bytearray(image.tobytes())), (2, 2, 2, 3, bytearray(12)), (3, 9, 9, 3, bytearray(b"x")), (4, 9, 9, 3, None)], "id int, h int, w int, c int, d binary").createOrReplaceTempView("pictures")
    got = [tuple(r) for r in spark.sql("select id, x, score, embedding from pictures, lateral objects(h, w, c, d) order by id, x").collect()]
    assert got == [(1, 1.0, 0.9, [7.0, 4.0]), (1, 8.0, 0.7, [7.0, 2.0])]


def test_models_reach_the_workers(spark, tmp_path):
    from lightbox.sources import models

    assert models.processors(["CPUExecutionProvider", "CUDAExecutionProvider"]) == ["CUDAExecutionProvider", "CPUExecutionProvider"] and models.processors([]) == ["CPUExecutionProvider"]
    assert models.processors()[-1] == "CPUExecutionProvider"
    assert models.tasks_at_once(16, models.PROCESSORS) == 4 and models.tasks_at_once(16, ["CPUExecutionProvider"]) == 15 and models.tasks_at_once(1, models.PROCESSORS) == 1
    (tmp_path / "weights.bin").write_bytes(b"12345")
    there = models.distributed(spark, str(tmp_path / "weights.bin"))

    def read(frames):
        for pdf in frames:
            yield pdf.assign(n=len(open(there(), "rb").read()))

    assert [r["n"] for r in spark.range(3).repartition(2).mapInPandas(read, "id long, n int").collect()] == [5, 5, 5]


def test_unreadable_scan_time_is_fresh(spark):
    df = spark.sql("select '/x' as path, timestamp'2024-01-02' as mtime union all select '/y', timestamp'2024-01-02'")
    known = spark.createDataFrame([("/x", "gibberish"), ("/y", "2024-01-01T00:00:00")], "path string, scanned_at string")
    assert [r["path"] for r in ingest.stale_files(df, known).collect()] == ["/y"]


def test_numbering_without_one_task(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 as k")
    got = sorted((r["k"], r["id"]) for r in ingest.numbered(df, ["k"], 5).collect())
    assert got == [(k, k + 5) for k in range(1000)]


def test_export(spark, make, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d).mkdir()
        (tmp_path / d / "photo.jpg").write_bytes(d.encode())
    photos = [{"id": 1, "path": str(tmp_path / "a/photo.jpg")}, {"id": 2, "path": str(tmp_path / "b/photo.jpg")}, {"id": 3, "path": str(tmp_path / "missing.jpg")}]
    c = make([{"id": i, "photo_id": i, "cluster": 1} for i in (1, 2, 3)], [(1, "Ann/Lee"), (2, "Empty")], photos)
    plan = export.export_plan(c)
    assert sorted(r["file_name"] for r in plan.collect()) == ["missing.jpg", "photo.jpg", "photo_1.jpg"]
    existing = spark.createDataFrame([("Ann_Lee", "photo.jpg")], "folder string, file_name string")
    assert sorted(r["file_name"] for r in export.export_plan(c, existing).collect()) == ["missing.jpg", "photo_1.jpg", "photo_2.jpg"]
    seen = []
    assert export.run_export(c, str(tmp_path / "out"), on_progress=lambda d, n: seen.append((d, n))) == {"Ann/Lee": 2, "Empty": 0} and seen == [(2, 2)]
    assert sorted(os.listdir(tmp_path / "out/Ann_Lee")) == ["photo.jpg", "photo_1.jpg"] and os.path.isdir(tmp_path / "out/Empty")
    export.run_export(c, str(tmp_path / "out"), symlink=True)
    assert os.path.islink(tmp_path / "out/Ann_Lee/photo_2.jpg")
    assert export.run_export(c, str(tmp_path / "none"), stop=lambda: True) == {}


def test_names_are_free_in_their_folder(spark, make):
    """Against a plain walk in order of cluster and path, with natural names that look numbered."""
    import random

    r = random.Random(4)
    names = ["a.jpg", "a_1.jpg", "a_1_1.jpg", "a_2.jpg", "b", "b_1", ".hid", ".hid_1", "x_7.png", "c.tar.gz", "c.tar_1.gz"]
    paths = sorted({f"/{k}/{r.choice(names)}" for k in range(60)})
    photos = [{"id": i, "path": p} for i, p in enumerate(paths)]
    # three clusters, of which two share a folder
    c = make([{"id": i, "photo_id": i, "cluster": 1 + i % 3} for i in range(len(paths))], [(1, "Ann/Lee"), (2, "Bob"), (3, "Ann_Lee")], photos)
    for old in ([], ["a.jpg", "a_3.jpg", "b_1"]):
        existing = spark.createDataFrame([("Ann_Lee", n) for n in old], "folder string, file_name string")
        want, taken = {}, {"Ann_Lee": set(old), "Bob": set()}
        for cluster, folder in ((1, "Ann_Lee"), (2, "Bob"), (3, "Ann_Lee")):
            for p in [p for i, p in enumerate(paths) if 1 + i % 3 == cluster]:
                base = os.path.basename(p)
                stem, ext = os.path.splitext(base)
                name, k = base, 0
                while name in taken[folder]:
                    k += 1
                    name = f"{stem}_{k}{ext}"
                taken[folder].add(name)
                want[cluster, p] = name
        rows = export.export_plan(c, existing if old else None).collect()
        assert {(x["cluster_id"], x["src"]): x["file_name"] for x in rows} == want and len(rows) == len(want)


def test_shared_folder_and_discard(spark, make, tmp_path):
    from lightbox.plans import materialize

    kept = materialize.written(make([{"id": 1}]).photos, "t")
    assert kept.count() == 1 and os.path.isdir(materialize.run_dir(spark))
    materialize.discard(spark)
    assert not os.path.isdir(materialize.run_dir(spark))


def test_state_survives_saving(spark, make, tmp_path):
    c = make([{"id": 1, "cluster": 1}], [(1, "Alice")]).to(last_auto=9)
    c.save(str(tmp_path / "cat"))
    back = Catalog.load(spark, str(tmp_path / "cat"))
    assert back.last_auto == 9 and back.clusters.first()["name"] == "Alice" and back.faces.first()["embedding"] == [1.0, 0.0]


def test_migrations(spark, make):
    from lightbox import schema

    c = make([{"id": 1, "cluster": 1}], [(1, "Alice")])
    old = {"photos": c.photos.drop("phash", "duplicate_group_id"), "faces": c.faces.drop("dismissed"), "clusters": c.clusters}
    new = schema.migrate(old | {"faces": c.faces}, 4)
    assert new["photos"].count() == 1 and new["photos"].first()["phash"] is None and new["faces"].count() == 1
    new = schema.migrate(old, 1)
    assert new["faces"].count() == 0 and new["clusters"].count() == 0 and new["photos"].first()["scanned_at"] == schema.EPOCH
    same = schema.migrate(new, 5)
    assert same["photos"].columns == schema.PHOTOS.names


def test_settings(tmp_path):
    path = str(tmp_path / "s" / "settings.json")
    s = files.Settings(cluster_eps=0.4)
    for i in range(12):
        s.remember(f"/f{i}")
    s.remember("/f5")
    s.save(path)
    assert files.Settings.load(path) == s and s.recent_folders[0] == "/f5" and len(s.recent_folders) == 10
    with open(path, "w") as f:
        f.write('{"cluster_eps": 0.3, "unknown": 1}')
    assert files.Settings.load(path).cluster_eps == 0.3
    with open(path, "w") as f:
        f.write("{broken")
    assert files.Settings.load(path) == files.Settings() == files.Settings.load(str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        files.Settings(confidence=0.05).checked()
    assert files.Settings(workers=99).checked().workers == 16


def test_log_tail(spark, tmp_path):
    p = tmp_path / "x.log"
    p.write_text("".join(f"line {i}\n" for i in range(50)))
    assert [r["line"] for r in files.log_tail(spark, str(p), 3).collect()] == [f"line {i}" for i in range(40, 50)]


def test_command_line(spark, make, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cat = str(tmp_path / "cat")
    with pytest.raises(SystemExit) as e:
        cli.main(["stats", "--catalog", cat])
    assert e.value.code == 1
    make([{"id": 1, "cluster": 1}, {"id": 2, "cluster": 2}, {"id": 3}], [(1, "Alice"), (2, "Bob")]).save(cat)
    run = lambda *a: cli.main([*a, "--catalog", cat])
    assert run("show") == 0 and "Alice" in capsys.readouterr().out
    assert run("rename", "2", "Carol/X") == 0 and "Carol_X" in capsys.readouterr().out
    assert run("merge", "1", "2") == 0 and run("merge", "1", "1") == 1
    assert run("split", "1") == 0 and run("dismiss", "3") == 0 and run("dismiss", "3", "--restore") == 0 and run("dismiss", "99") == 1
    assert run("cluster") == 0 and run("find-duplicates") == 0 and run("duplicates") == 0 and run("stats") == 0
    assert "No duplicate groups" in capsys.readouterr().out
