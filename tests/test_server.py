import json
import threading
import time
import urllib.error
import urllib.request

import numpy as np
import pytest

from lightbox.functions import pixels
from lightbox.server import serve
from lightbox.streaming import tasks


@pytest.fixture()
def call(spark, make, tmp_path):
    cat = str(tmp_path / "cat")
    make([{"id": 1, "cluster": 1}, {"id": 2, "cluster": 2}, {"id": 3}], [(1, "Alice"), (2, "Bob")], [{"id": i, "date": "2020-01-02T03:04:05"} for i in (1, 2, 3)]).save(cat)
    server = serve(spark, cat)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def request(path, body=None):
        data = None if body is None else json.dumps(body).encode()
        try:
            with urllib.request.urlopen(urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", data), timeout=60) as r:
                text = r.read().decode()
                return r.status, json.loads(text) if text.startswith(("{", "[")) else text
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    yield request
    server.shutdown()


def test_reads_and_changes(call):
    assert call("/api/stats")[1]["faces"] == 3 and [r["name"] for r in call("/api/people?kind=named&q=AL")[1]] == ["Alice"]
    assert call("/api/timeline/years") == (200, ["2020"]) and call("/api/nothing")[0] == 404 and call("/api/person/9")[0] == 404
    assert call("/api/rename", {"cluster_id": 2, "name": "Carol/X"})[1]["name"] == "Carol_X" and call("/api/person/2")[1]["name"] == "Carol_X"
    assert call("/api/merge", {"keep_id": 1, "merge_id": 1})[0] == 400 and call("/api/merge", {"keep_id": 1, "merge_id": "x"})[0] == 400
    assert call("/api/merge", {"keep_id": 1, "merge_id": 2})[0] == 200 and call("/api/person/1")[1]["face_count"] == 3  # renaming absorbed the unassigned one
    assert call("/api/move-faces", {"face_ids": [3], "cluster_id": 1})[1]["moved"] == 1 and call("/api/dismiss", {"face_id": 99})[0] == 404


def test_background_tasks(call):
    status, out = call("/api/cluster", {})
    assert status == 200
    end = time.time() + 60
    while (task := call(f"/api/task/{out['task_id']}")[1])["status"] == "running" and time.time() < end:
        time.sleep(0.3)
    assert task["status"] == "done" and task["result"]["clusters"] == 1
    assert '"status": "done"' in call(f"/api/task/{out['task_id']}/stream")[1] and call("/api/task/none")[0] == 404


def finished(call, task_id):
    end = time.time() + 90
    while (task := call(f"/api/task/{task_id}")[1])["status"] == "running" and time.time() < end:
        time.sleep(0.2)
    return task


def test_scan_settings_export_logs_and_pictures(call, spark, tmp_path, monkeypatch):
    import os

    from test_ingest import png

    monkeypatch.setenv("XDG_DATA_HOME", str(tmp_path / "data"))
    folder = tmp_path / "pics"
    folder.mkdir()
    (folder / "x.png").write_bytes(png(np.arange(90 * 60).reshape(60, 90) % 251))
    os.utime(folder / "x.png", (1_700_000_000, 1_700_000_000))
    assert call("/api/scan", {"folder": str(tmp_path / "nothing")})[0] == 400
    task = finished(call, call("/api/scan", {"folder": str(folder)})[1]["task_id"])
    assert task["status"] == "done" and task["result"]["processed"] == 1 and task["progress"]["total"] == 1 and call("/api/stats")[1]["photos"] == 4
    assert call("/api/settings")[1]["recent_folders"] == [str(folder)] and call("/api/settings", {"hamming": 7, "other": 1})[1]["hamming"] == 7
    assert call("/api/settings", {"confidence": 0.01})[0] == 400 and call("/api/settings")[1]["hamming"] == 7
    assert call("/api/logs")[1] == {"lines": []} and call("/api/logs/clear", {})[0] == 200
    task = finished(call, call("/api/export", {"output": str(tmp_path / "out")})[1]["task_id"])
    assert task["result"] == {"exported": 0, "summary": {"Alice": 0, "Bob": 0}} and os.path.isdir(tmp_path / "out/Alice") and call("/api/export", {})[0] == 400
    assert finished(call, call("/api/backfill-hashes", {})[1]["task_id"])["result"] == {"updated": 0}
    assert call("/api/picture/face/1")[0] == 404 and call("/api/picture/photo/99")[0] == 404
    assert call("/api/delete-photo", {"photo_id": 4})[0] == 200 and os.listdir(tmp_path / "data/Trash/files") == ["x.png"] and not (folder / "x.png").exists()


def test_thumbnails_are_kept(spark, tmp_path):
    import os

    from test_ingest import png

    from lightbox.functions.media import described
    from lightbox.sources import thumbnails

    path, cache = str(tmp_path / "a.png"), str(tmp_path / "t")
    with open(path, "wb") as f:
        f.write(png(np.arange(300 * 400).reshape(300, 400) % 251))
    size = lambda p: [described(open(p, "rb").read())[k] for k in ("format", "width", "height")]
    whole = thumbnails.thumbnail(spark, cache, "photo", 1, path)
    assert size(whole) == ["JPEG", 150, 112] and size(thumbnails.thumbnail(spark, cache, "face", 1, path, (390, 0, 50, 50))) == ["JPEG", 20, 60]
    os.remove(path)
    assert thumbnails.thumbnail(spark, cache, "photo", 1, path) == whole and thumbnails.thumbnail(spark, cache, "photo", 2, path) is None
    assert sorted(os.listdir(cache)) == ["face_1.jpg", "photo_1.jpg"]


def test_recycle_bin(tmp_path):
    from lightbox.sources import files

    for k in range(2):
        (tmp_path / "a b.jpg").write_bytes(b"x")
        assert files.recycle(str(tmp_path / "a b.jpg"), str(tmp_path / "bin")).endswith(["a b.jpg", "a b_1.jpg"][k])
    assert "a%20b.jpg" in (tmp_path / "bin/info/a b_1.jpg.trashinfo").read_text()
    with pytest.raises(FileNotFoundError):
        files.recycle(str(tmp_path / "a b.jpg"), str(tmp_path / "bin"))


def test_one_wrong_landmark_does_not_turn_a_face():
    turned = pixels.TEMPLATE[:, ::-1] * [1, -1] * 2 + [5, 300]
    right = pixels.similarity(turned)
    wrong = turned.copy()
    wrong[2] += [80, -60]
    assert np.allclose(pixels.robust_similarity(wrong), right, atol=1e-6) and not np.allclose(pixels.similarity(wrong), right, atol=0.1)
    assert pixels.robust_similarity(np.zeros((5, 2))) is None


def test_tasks_report_fail_cancel_and_expire():
    now = [0.0]
    t = tasks.Tasks(clock=lambda: now[0])
    bad = t.submit("x", lambda task: 1 / 0)
    slow = t.submit("y", lambda task: task.stop.wait(20))
    assert t.cancel(slow.id)
    while bad.finished is None or slow.finished is None:
        time.sleep(0.01)
    assert bad.status == "error" and slow.status == "cancelled" and not t.cancel(bad.id)
    bad.report(done=1)
    bad.report(done=2)
    bad.report(done=3, last=True)
    assert bad.progress == {"done": 3}
    now[0] = 7200.0
    t.sweep()
    assert t.get(bad.id) is None and "not_found" in next(t.events(bad.id))


def test_pixels(spark):
    rng = np.random.RandomState(0)
    image = rng.randint(0, 255, (40, 60, 3)).astype(np.uint8)
    assert (pixels.resized(image, 40, 60) == image).all()
    assert (pixels.resized(np.kron(image, np.ones((2, 2, 1), np.uint8)), 40, 60) == image).all()
    small, f = pixels.downscaled(image, 30)
    assert small.shape == (20, 30, 3) and f == 0.5 and pixels.downscaled(image)[1] == 1.0
    assert pixels.cropped(image, 50, 30, 20, 20, box=10).shape == (10, 10, 3)
    boxes, scores = np.array([[0, 0, 10, 10], [1, 1, 10, 10], [30, 30, 5, 5]]), np.array([0.8, 0.9, 0.5])
    assert pixels.suppressed(boxes, scores) == [1, 2]
    turned = pixels.TEMPLATE[:, ::-1] * [1, -1] * 2 + [5, 300]
    m = pixels.similarity(turned)
    assert np.allclose(turned @ m[:, :2].T + m[:, 2], pixels.TEMPLATE, atol=1e-6)
    big = rng.randint(0, 255, (112, 112, 3)).astype(np.uint8)
    assert (pixels.aligned(big, pixels.TEMPLATE) == big).all() and pixels.aligned(image, np.zeros((5, 2))).shape == (112, 112, 3)
    assert pixels.model_input(big).shape == (3, 112, 112) and abs(pixels.model_input(big)).max() <= 1
    df = spark.createDataFrame([(40, 60, 3, bytearray(image.tobytes()), 0, 0, 20, 20), (9, 9, 3, bytearray(b"x"), 0, 0, 1, 1)], "h int, w int, c int, d binary, x int, y int, bw int, bh int")
    got = [r[0] for r in df.select(pixels.thumbnails("h", "w", "c", "d", "x", "y", "bw", "bh")).collect()]
    assert (got[0]["height"], got[0]["width"]) == (24, 24) and got[1]["height"] is None
