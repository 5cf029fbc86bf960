import random

import numpy as np
import pytest

from lightbox.functions import hashes
from lightbox.operators import duplicates, neighbors
from lightbox.operators.hashindex import HashIndex
from lightbox.plans import views


def photos(make, *rows):
    return make([], photos=[{"id": i + 1, "phash": h, "size": s} for i, (h, s) in enumerate(rows)])


def groups(c):
    return {r["id"]: r["duplicate_group_id"] for r in c.photos.collect()}


def test_pairs_and_singles(make):
    c, n = duplicates.detect_duplicates(photos(make, ("8f8f8f8f8f8f8f8f", 50), ("8f8f8f8f8f8f8f8d", 500), ("0000000000000000", 1), (None, 1)))
    assert n == 1 and groups(c) == {1: 1, 2: 1, 3: None, 4: None}
    assert [r["file_size"] for r in views.duplicate_photos(c, 1).collect()] == [500, 50]
    assert [tuple(r) for r in views.duplicate_groups(c).collect()] == [(1, 2)]


def test_threshold_and_rerun(make):
    c = photos(make, ("8f8f8f8f8f8f8f8f", 1), ("8f8f8f8f8f8f8f80", 1))
    assert duplicates.detect_duplicates(c, 2)[1] == 0
    first, n = duplicates.detect_duplicates(c, 4)
    assert n == 1
    again, n = duplicates.detect_duplicates(first, 2)
    assert n == 0 and set(groups(again).values()) == {None} and again.duplicate_groups.count() == 0
    assert duplicates.detect_duplicates(photos(make, ("8f8f8f8f8f8f8f8f", 1)))[1] == 0


@pytest.mark.parametrize("most", [0, 3, 6, 10, 17, 64])
def test_hamming_join_is_exact(spark, most):
    random.seed(most)
    base = [random.getrandbits(64) for _ in range(12)]
    values = [b ^ sum(1 << k for k in random.sample(range(64), random.randint(0, 12))) for b in base for _ in range(8)] + base[:3]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    got = {tuple(r) for r in neighbors.hamming_join(df, most).collect()}
    assert got == {(i, j, (values[i] ^ values[j]).bit_count()) for i in range(len(values)) for j in range(i + 1, len(values)) if (values[i] ^ values[j]).bit_count() <= most}


def test_perceptual_hash_sees_through_scale_and_light(spark):
    rng = np.random.RandomState(2)
    small = rng.rand(8, 8) * 200
    a = np.kron(small, np.ones((16, 16)))
    b = np.kron(small, np.ones((32, 32))) * 0.8 + 10
    other = np.kron(rng.rand(8, 8) * 200, np.ones((16, 16)))
    bits = lambda x, y: (int(hashes.phash_of_gray(x), 16) ^ int(hashes.phash_of_gray(y), 16)).bit_count()
    assert bits(a, b) <= 4 and bits(a, other) > 10 and hashes.phash_of_gray(np.zeros((0, 0))) is None
    df = spark.createDataFrame([(128, 128, 1, bytearray(a.astype(np.uint8).tobytes())), (5, 5, 3, bytearray(b"x"))], "h int, w int, c int, d binary")
    got = [r[0] for r in df.select(hashes.phash64("h", "w", "c", "d")).collect()]
    assert len(got[0]) == 16 and got[1] is None


def test_many_photos_of_one_hash(spark):
    """Groups count equal hashes without a pair of them; labels are those of all photos compared with all."""
    r = random.Random(8)
    base = [r.getrandbits(63) for _ in range(6)]
    values = [base[0]] * 20_000 + [b ^ (1 << r.randrange(63)) for b in base for _ in range(3)] + [r.getrandbits(63) for _ in range(5)] + [base[5]]
    order = list(range(len(values)))
    r.shuffle(order)
    df = spark.createDataFrame([(k, values[i]) for k, i in enumerate(order)], "id long, hash long")
    got = {row["id"]: row["label"] for row in duplicates.duplicate_labels(df, 2, 4).collect()}
    distinct = sorted(set(values))
    weight, first = {}, {}
    for k, i in enumerate(order):
        weight[values[i]] = weight.get(values[i], 0) + 1
        first.setdefault(values[i], k)
    near = {h: [o for o in distinct if (h ^ o).bit_count() <= 2] for h in distinct}
    core = {h for h in distinct if sum(weight[o] for o in near[h]) >= 4}
    label, n = {}, 0
    for h in sorted(core, key=first.get):
        if h not in label:
            stack = [h]
            label[h] = n
            while stack:
                for o in near[stack.pop()]:
                    if o in core and o not in label:
                        label[o] = n
                        stack.append(o)
            n += 1
    for h in distinct:
        if h not in core:
            label[h] = min((label[o] for o in near[h] if o in core), default=-1)
    assert got == {k: label[values[i]] for k, i in enumerate(order)}


def test_kept_groups_equal_a_full_run(spark, tmp_path, monkeypatch):
    """Photos in four batches: copies of known hashes, hashes that join old groups, and a batch that breaks off."""
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(8)]
    values = [b ^ sum(1 << r.randrange(63) for _ in range(r.randrange(7))) for b in base for _ in range(12)] + base + [r.getrandbits(63) for _ in range(20)]
    chain = [base[0]]
    for _ in range(12):  # single steps that join families late
        chain.append(chain[-1] ^ (0b1111 << r.randrange(60)))
    values += chain
    rows = list(enumerate(values + r.choices(values, k=20)))
    r.shuffle(rows)
    df = lambda some: spark.createDataFrame(some, "id long, hash long")
    index, plain = HashIndex(spark, str(tmp_path / "index"), bits=6), HashIndex._append
    cuts = [0, 60, 61, 100, len(rows)]
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if n == 2:
            with monkeypatch.context() as m:
                m.setattr(HashIndex, "_append", lambda self, name, *more: plain(self, name, *more) if name != "moves" else 1 // 0)
                with pytest.raises(ZeroDivisionError):
                    index.add(df(rows[a:b]))
            index.close()
            index = HashIndex(spark, str(tmp_path / "index"))
        assert index.add(df(rows[a:b])) == n + 1
        if n != 1:
            want = {x["id"]: x["label"] for x in duplicates.duplicate_labels(df(rows[:b]), 6).where("label >= 0").collect()}
            assert {x["id"]: x["label"] for x in index.labels(df(rows[:b])).collect()} == want and want
    # the index's side of the look-up isn't shuffled
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        probes = neighbors.band_probes(df([(1, 5)]).select("hash"), 6)
        plan = probes.join(index.table("bands"), ["band", "bits"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1
    index.close()


@pytest.mark.parametrize("most", [6, 10])
def test_probes_are_never_broadcast(spark, tmp_path, most):
    """The planner knows the size of the table of hashes, not that of the many values each is looked up by; a small table's went through the driver."""
    r = random.Random(most)
    values = [r.getrandbits(63) for _ in range(3_000)]
    spark.createDataFrame([(v,) for v in values + [v ^ 3 for v in values[:50]]], "hash long").write.parquet(str(tmp_path / "hashes"))
    near = neighbors.near_hashes(spark.read.parquet(str(tmp_path / "hashes")), most)
    assert near.count() >= 50
    assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
    index = HashIndex(spark, str(tmp_path / "index"), bits=most)
    index.add(spark.createDataFrame([(k, v) for k, v in enumerate(values)], "id long, hash long"))
    index.add(spark.createDataFrame([(k + 5_000, v ^ 3) for k, v in enumerate(values[:50])], "id long, hash long"))
    assert index.groups().count() >= 100
    index.close()
