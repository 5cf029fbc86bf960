import os

import pytest
from catalog_helpers import named, of

from lightbox.operators import clustering, curation, ingest
from lightbox.plans import store, views
from lightbox.plans.store import Store


@pytest.fixture()
def kept(spark, make, tmp_path):
    faces = [{"id": i, "photo_id": i % 40, "cluster": [1, 2, 3, None][i % 4], "dismissed": int(i % 4 == 3 and i % 8 == 7)} for i in range(120)]
    photos = [{"id": i, "date": None if i % 5 == 0 else f"20{20 + i % 3}-01-0{1 + i % 4}T00:00:00"} for i in range(40)]
    c = make(faces, [(1, "Alice"), (2, "Bob"), (3, "maybe Bob"), (4, "Empty")], photos)
    return Store.create(c, str(tmp_path / "cat"), buckets=2)


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


ACTIONS = {
    "merge": lambda c: curation.merge_people(c, 1, 3),
    "delete": lambda c: curation.delete_photo(c, 12),
    "assign": lambda c: clustering.with_assignments(c, c.photos.sparkSession.createDataFrame([(3, 4), (1, None)], "face_id long, new_cluster_id long")),
}


def test_state_and_counts_after_each_action(spark, kept):
    for name in ("merge", "delete", "assign"):
        before = kept.load()
        want = ACTIONS[name](before).settled()
        kept.apply(before, ACTIONS[name](before))
        again = Store.open(spark, kept.path)
        now = again.load()
        for t in ("photos", "faces", "clusters"):
            assert rows(getattr(now, t).drop("updated_at")) == rows(getattr(want, t).drop("updated_at")), (name, t)
        assert rows(again.clusters_with_counts()) == rows(views.clusters_with_counts(want)), name
        assert rows(again.photo_counts()) == rows(views.photo_counts(want)), name
        assert rows(again.day_counts()) == rows(views.timeline_days(want)), name
        assert rows(again.stats()) == rows(views.catalog_stats(want)), name


def test_only_touched_buckets_are_written(spark, kept):
    old = files(kept.path)
    before = kept.load()
    touched = kept.apply(before, curation.rename(before, 2, "Eve"))
    changed = {p for p in files(kept.path).keys() - old.keys()}
    assert list(touched) == ["clusters"] and len(touched["clusters"]) == 1 and all("/clusters/" in p for p in changed)
    before = kept.load()
    old = files(kept.path)
    touched = kept.apply(before, curation.move_faces(before, [4, 8], 2)[0])
    changed = {p for p in files(kept.path).keys() - old.keys()}
    assert 1 <= len(touched["faces"]) <= 2 and "photos" not in touched and {p.split("/bucket=")[0].rsplit("/", 1)[1] for p in changed} <= {"faces", "faces_by_cluster", "photos_by_cluster"}
    assert kept.apply(kept.load(), kept.load()) == {}
    # a scan that stores one photo again writes the buckets of its rows
    before = kept.load()
    box = ingest.F.array(ingest.F.expr("named_struct('x', 1d, 'y', 2d, 'w', 50d, 'h', 60d, 'score', 0.95d, 'embedding', array(1f))"))
    seen = before.photos.where("id = 3").select("path", "file_size", "width", "height", "format", ingest.F.lit(None).cast("string").alias("exif_text"), ingest.F.lit(None).cast("string").alias("phash"), ingest.F.lit(None).cast("string").alias("error"), ingest.F.lit(1.0).alias("scale"), box.alias("boxes"))
    touched = kept.apply(before, ingest.store(before, seen, "2024-01-01 00:00:00"))
    assert len(touched["photos"]) <= 2 and len(touched["faces"]) <= 4 and kept.load().faces.count() == 118


@pytest.mark.parametrize("moment", ["staged", "half"])
def test_a_crash_leaves_the_state_before_or_after(spark, kept, monkeypatch, moment):
    before = kept.load()
    written, plain = [], Store._write

    def broken(self, table, *more, **kw):
        if moment == "staged" or written:
            raise RuntimeError("power cut")
        written.append(table)
        plain(self, table, *more, **kw)

    with monkeypatch.context() as m:
        m.setattr(Store, "_write", broken)
        with pytest.raises(RuntimeError):
            kept.apply(before, curation.merge_people(before, 1, 3))
    now = Store.open(spark, kept.path)  # the note was there, so it is ended
    assert set(named(now.load())) == {1, 2, 4} and of(now.load())[2] == 1 and not os.path.exists(f"{kept.path}/{store.PENDING}")
    assert rows(now.clusters_with_counts()) == rows(views.clusters_with_counts(now.load()))
    # without the note nothing has happened
    before = now.load()
    with monkeypatch.context() as m:
        m.setattr(Store, "_note", lambda *a: 1 // 0)
        with pytest.raises(ZeroDivisionError):
            now.apply(before, curation.rename(before, 1, "Zoe"))
    assert named(Store.open(spark, kept.path).load())[1] == "Alice"
