import os
import shutil

import pytest

from lightbox.operators import export
from lightbox.sources import folders


@pytest.fixture()
def album(spark, make, tmp_path):
    photos = []
    for i in range(30):
        p = tmp_path / "in" / str(i % 4) / f"p{i % 6}.jpg"
        if i % 4 == 0 or not p.exists():
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_bytes(str(p).encode())
    paths = sorted(str(p) for p in (tmp_path / "in").rglob("*.jpg"))
    photos = [{"id": i, "path": p} for i, p in enumerate([*paths, str(tmp_path / "gone.jpg")])]
    return make([{"id": i, "photo_id": i, "cluster": 1 + i % 2} for i in range(len(photos))], [(1, "Ann/Lee"), (2, "Bob"), (3, "None")], photos)


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n)).read() for d, _, names in os.walk(root) for n in names}


def test_all_pictures_get_the_planned_names(spark, album, tmp_path):
    out = str(tmp_path / "out")
    plan = {(r["folder"], r["file_name"]): r["src"] for r in export.export_plan(album).collect()}
    summary = export.run_export(album, out)
    assert tree(out) == {f"{folder}/{name}": src for (folder, name), src in plan.items() if "gone" not in src}
    counted = {r["name"]: r["exported"] for r in export.export_summary(album, export.export_plan(album).where("src not like '%gone%'")).collect()}
    assert summary == counted and sorted(os.listdir(out)) == ["Ann_Lee", "Bob", "None"]


def test_a_failed_job_leaves_no_half_folder(spark, album, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    export.run_export(album, out)
    before = tree(out)
    folders.register(spark)
    bad = spark.createDataFrame([(1, "Ann_Lee", r["src"], f"new{i}.jpg") for i, r in enumerate(export.pictures_of(album).collect())] + [(1, None, "/", "x")], "cluster_id long, folder string, src string, file_name string")
    with pytest.raises(Exception):
        bad.repartition(4).write.format(folders.FORMAT).mode("append").save(out)
    assert {n: t for n, t in tree(out).items() if not n.startswith(".export")} == before
    writer = folders.FolderWriter({"path": out}, bad.schema)
    os.makedirs(f"{writer.staging}/0-1/Bob")
    writer.abort([])
    assert not [n for n in os.listdir(out) if n.startswith(writer.staging.rsplit("/", 1)[1])]
    writer.abort([])  # nothing there


def test_names_taken_meanwhile_and_leftovers_of_dead_tasks(spark, album, tmp_path):
    out = str(tmp_path / "out")
    os.makedirs(f"{out}/Bob")
    with open(f"{out}/Bob/a.jpg", "w") as f:
        f.write("mine")
    schema = spark.createDataFrame([], "cluster_id long, folder string, src string, file_name string").schema
    writer = folders.FolderWriter({"path": out}, schema)
    src = export.pictures_of(album).where("src not like '%gone%'").first()["src"]
    staged = f"{writer.staging}/0-7"
    os.makedirs(f"{staged}/Bob")
    os.makedirs(f"{writer.staging}/0-6/Bob")  # an attempt that died
    for k in ("0-7", "0-6"):
        shutil.copy2(src, f"{writer.staging}/{k}/Bob/a.jpg")
    writer.commit([folders.Copied(staged, {2: 1}), None])
    assert tree(out) == {"Bob/a.jpg": "mine", "Bob/a_1.jpg": src}
