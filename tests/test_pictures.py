import os
import time

import pytest
from pyspark.sql import functions as F
from test_ingest import jpeg, png

from lightbox.catalog import Catalog
from lightbox.operators import ingest
from lightbox.sources import pictures
from lightbox.streaming import scan


@pytest.fixture()
def folder(tmp_path):
    root = tmp_path / "pics"
    big = jpeg(30, 20, "2019:01:01 00:00:00")
    late = b"\xff\xd8" + b"\xff\xe2\xff\xff" + bytes(65_533) + jpeg(9, 8)[2:]  # the frame comes after a long block
    for name, data in {"x.jpg": big + bytes(500_000), "a/y.JPG": big, "a/b/z.png": png([[1, 2, 3]] * 2), "a/b/bad.jpg": b"broken", "late.jpeg": late + bytes(2_000_000), "note.txt": b"-", ".lightbox/q.jpg": big, "c/never.jpg": b"\xff\xd8" + (b"\xff\xe2\xff\xff" + bytes(65_533)) * 40}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    return root


def test_batch_reads_headers_of_each_folder(spark, folder):
    rows = {os.path.relpath(r["path"], folder): r for r in pictures.pictures(spark, str(folder)).collect()}
    assert {n: (r["width"], r["height"], r["format"], r["exif_text"]) for n, r in rows.items()} == {
        "x.jpg": (30, 20, "JPEG", "2019:01:01 00:00:00"), "a/y.JPG": (30, 20, "JPEG", "2019:01:01 00:00:00"), "a/b/z.png": (3, 2, "PNG", None), "a/b/bad.jpg": (None,) * 4,
        "late.jpeg": (9, 8, "JPEG", None), "c/never.jpg": (None, None, "JPEG", None),
    }
    assert "ValueError" in rows["a/b/bad.jpg"]["error"] and rows["x.jpg"]["length"] == (folder / "x.jpg").stat().st_size
    assert abs(rows["x.jpg"]["mtime"].timestamp() - (folder / "x.jpg").stat().st_mtime) < 1e-3
    flat = pictures.pictures(spark, str(folder), recursive=False, headers=False).collect()
    assert sorted(os.path.basename(r["path"]) for r in flat) == ["late.jpeg", "x.jpg"] and all(r["width"] is None and r["error"] is None for r in flat)


def test_bytes_read_of_a_file_are_bounded(folder, monkeypatch):
    read = {}
    whole = pictures.Store.range

    def counted(self, path, start, n):
        data = whole(self, path, start, n)
        name = os.path.relpath(path, folder)
        read[name] = read.get(name, 0) + len(data)
        return data

    monkeypatch.setattr(pictures.Store, "range", counted)
    reader = pictures.PictureReader({"path": str(folder)})
    assert len([row for part in reader.partitions() for row in reader.read(part)]) == 6
    assert read["x.jpg"] == pictures.FIRST and read["late.jpeg"] <= 16 * pictures.FIRST and read["c/never.jpg"] == pictures.MOST


def test_filters_reach_the_files(spark, folder, monkeypatch):
    df = pictures.pictures(spark, str(folder))
    old = time.time() - 1000
    os.utime(folder / "a/y.JPG", (old, old))
    wanted = df.where(F.col("path").startswith(f"{folder}/a/") & (F.col("mtime") > F.lit(old + 500).cast("timestamp")) & (F.col("height") > 1))
    plan = spark._jvm.PythonSQLUtils.explainString(wanted._jdf.queryExecution(), "formatted")
    assert "StringStartsWith(path" in plan and "GreaterThan(mtime" in plan
    assert [os.path.basename(r["path"]) for r in wanted.collect()] == ["z.png"]
    assert df.where(F.col("path") == f"{folder}/x.jpg").count() == 1 and df.where(F.col("path").isin(f"{folder}/x.jpg", "/no")).count() == 1
    # folders that can't hold a wanted path aren't gone into, and other files aren't opened
    reader = pictures.PictureReader({"path": str(folder)})
    assert list(reader.pushFilters([pictures.EqualTo(("path",), f"{folder}/a/b/z.png"), pictures.EqualTo(("width",), 3)])) == [pictures.EqualTo(("width",), 3)]
    assert {os.path.relpath(f, folder) for p in reader.partitions() for f, _ in p.folders} == {".", "a", "a/b"}
    monkeypatch.setattr(pictures.Store, "header", lambda self, path, most: {"width": int(path.endswith("z.png")) or 1 // 0})
    assert [r[3] for part in reader.partitions() for r in reader.read(part)] == [1]


def test_wide_and_deep_folders_are_all_listed(tmp_path, monkeypatch):
    monkeypatch.setattr(pictures, "ENOUGH", 5)
    want = set()
    for k in range(40):
        p = tmp_path / f"d{k % 7}" / f"e{k % 3}" / f"f{k}" / f"{k}.jpg"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(b"x")
        want.add(str(p))
    reader = pictures.PictureReader({"path": str(tmp_path), "headers": "false"})
    parts = reader.partitions()
    got = [row[0] for part in parts for row in reader.read(part)]
    assert len(parts) > 4 and len(got) == 40 and set(got) == want
    assert len(pictures.PictureReader({"path": str(tmp_path), "partitions": "2"}).partitions()) == 2


def test_stream_in_triggers_equals_the_batch_scan(spark, tmp_path, folder):
    journal, checkpoint, lots = str(tmp_path / "journal"), str(tmp_path / "check"), []
    go = lambda c: scan.scan_what_changed(c, str(folder), journal, checkpoint, lambda: "2999-01-01 00:00:00", files_per_trigger=2, hashed=False, on_lot=lambda *lot: lots.append(lot))
    first = go(Catalog.empty(spark))
    assert len(lots) >= 3 and sum(n for _, n, _ in lots) == 5
    facts = lambda c: sorted((os.path.relpath(r["path"], folder), r["width"], r["height"], r["file_size"], r["exif_date"]) for r in c.photos.collect())
    batch, counts = ingest.scan(Catalog.empty(spark), str(folder), "2999-01-01 00:00:00")
    assert counts == {"total": 6, "skipped": 0, "processed": 5, "errors": 1, "faces_found": 0} and facts(first) == facts(batch)
    # nothing new; then a changed file, and one that comes with an old time
    lots.clear()
    assert facts(go(first)) == facts(first) and not lots
    (folder / "x.jpg").write_bytes(jpeg(77, 66))
    (folder / "old.jpg").write_bytes(jpeg(5, 4))
    os.utime(folder / "old.jpg", (1_000_000_000, 1_000_000_000))
    second = {r[0]: r[1:3] for r in facts(go(first))}
    assert second["x.jpg"] == (77, 66) and second["old.jpg"] == (5, 4) and len(second) == 6


def test_a_restart_in_the_middle_loses_and_doubles_nothing(spark, tmp_path, folder, monkeypatch):
    journal, checkpoint = str(tmp_path / "journal"), str(tmp_path / "check")
    done = []

    def break_off(number, good, boxes):
        done.append(number)
        if len(done) == 2:
            raise RuntimeError("power cut")

    options = dict(files_per_trigger=2, hashed=False)
    query = scan.scan_stream(spark, str(folder), journal, checkpoint, lambda: "2001-01-01 00:00:00", on_lot=break_off, **options)
    with pytest.raises(Exception, match="power cut"):
        query.processAllAvailable()
    query.stop()
    assert scan.pending(spark, journal).count() == 2
    state = scan.scan_what_changed(Catalog.empty(spark), str(folder), journal, checkpoint, lambda: "2002-01-01 00:00:00", on_lot=lambda n, *_: done.append(n), **options)
    assert done[:3] == [0, 1, 1] and sorted(os.path.basename(r["path"]) for r in state.photos.collect()) == ["late.jpeg", "never.jpg", "x.jpg", "y.JPG", "z.png"]


def test_options_are_checked():
    with pytest.raises(ValueError):
        pictures.PictureReader({})
    with pytest.raises(ValueError):
        pictures.PictureStreamReader({"path": "/x", "maxFilesPerTrigger": "5"})


def test_batches_of_a_stream_list_only_their_folders(tmp_path, monkeypatch):
    """One listing plans many batches; before, each batch listed every folder twice."""
    from lightbox.sources import pictures as source

    for k in range(40):
        (tmp_path / f"in/d{k}").mkdir(parents=True)
        (tmp_path / f"in/d{k}/a.jpg").write_bytes(b"x")
    calls, plain = [], source.Store.entries
    monkeypatch.setattr(source.Store, "entries", lambda self, folder: calls.append(folder) or plain(self, folder))

    def drained(reader, start):
        seen, batches = [], 0
        while (end := reader.latestOffset()) != start:
            rows = [r[0] for part in reader.partitions(start, end) for r in reader.read(part)]
            seen, start, batches = seen + rows, end, batches + 1
        return seen, start, batches

    options = {"path": str(tmp_path / "in"), "headers": "false", "maxFilesPerTrigger": "4", "progress": str(tmp_path / "progress")}
    for planned in (200_000, 6):
        monkeypatch.setattr(source, "PLANNED", planned)
        calls.clear()
        reader = source.PictureStreamReader(options | {"progress": str(tmp_path / f"progress-{planned}")})
        seen, end, batches = drained(reader, reader.initialOffset())
        assert sorted(seen) == sorted(str(tmp_path / f"in/d{k}/a.jpg") for k in range(40)) and batches >= 2
        if planned == 200_000:
            assert len(calls) <= 4 * 41 + 40
    (tmp_path / "in/d7/a.jpg").write_bytes(b"y")
    assert drained(reader, end)[0] == [str(tmp_path / "in/d7/a.jpg")]
