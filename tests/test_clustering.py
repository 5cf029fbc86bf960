import numpy as np
import pytest
from catalog_helpers import named, near, of, unit

from lightbox.functions import vectors
from lightbox.operators import clustering, density, linkage, neighbors, regions
from lightbox.plans.materialize import written


def brute_labels(m, eps, least):
    """A sequential density clustering in row order."""
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    close = 1 - m @ m.T <= eps
    core = close.sum(axis=1) >= least
    label, n = np.full(len(m), -1), 0
    for i in range(len(m)):
        if core[i] and label[i] < 0:
            stack = [i]
            label[i] = n
            while stack:
                for k in np.flatnonzero(close[stack.pop()]):
                    if label[k] < 0:
                        label[k] = n
                        if core[k]:
                            stack.append(k)
            n += 1
    return label


@pytest.mark.parametrize("block", [2048, 40])
def test_dbscan_is_the_sequential_one(spark, monkeypatch, block):
    monkeypatch.setattr(regions, "BLOCK", block)
    rng = np.random.RandomState(0)
    centres = rng.randn(12, 8)
    m = np.concatenate([c + 0.35 * rng.randn(12, 8) for c in centres] + [rng.randn(40, 8)]).astype(np.float32)
    m = m[rng.permutation(len(m))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    for eps, least in ((0.05, 3), (0.12, 4)):
        found = {r["id"]: r["label"] for r in clustering.dbscan(df, eps, least).collect()}
        assert [found[i] for i in range(len(m))] == brute_labels(m.astype(float), eps, least).tolist()


def clouds(kind):
    r = np.random.RandomState(7)
    unit_rows = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    if kind == "copies and noise":
        m = np.concatenate([np.repeat(r.randn(2, 6), 90, axis=0), r.randn(80, 6)])
    elif kind == "tight clouds":
        m = np.concatenate([c + 0.05 * r.randn(70, 6) for c in unit_rows(r.randn(4, 6))] + [r.randn(60, 6)])
    elif kind == "wide":
        m = np.concatenate([c + 0.75 * r.randn(60, 12) / 12**0.5 * 3 for c in unit_rows(r.randn(4, 12)) * 2] + [r.randn(50, 12)])
    else:  # a chain round a circle, cut twice, and its bridges
        t = np.delete(np.linspace(0, 2 * np.pi, 300, endpoint=False), [0, 1, 2, 3, 150, 151, 152, 153])
        m = np.stack([np.cos(t), np.sin(t), 0 * t], axis=1)
    return m[r.permutation(len(m))].astype(np.float32)


@pytest.mark.parametrize("kind, eps, least", [("copies and noise", 0.1, 4), ("tight clouds", 0.08, 3), ("wide", 0.35, 3), ("chain", 0.0005, 2)])
def test_clusters_over_many_parts(spark, monkeypatch, kind, eps, least):
    """Cells, trees, witnesses and the comparison of what is left give the labels of the sequential search."""
    monkeypatch.setattr(regions, "BLOCK", 32)
    monkeypatch.setattr(regions, "POINTS", 24)
    m = clouds(kind)
    df = spark.createDataFrame([(i * 3 + 1, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    found = {r["id"]: (r["label"], r["is_core"]) for r in density.dbscan(df, eps, least).collect()}
    want = brute_labels(m.astype(float), eps, least)
    assert [found[i * 3 + 1][0] for i in range(len(m))] == want.tolist()
    label, core = density.labels_here(np.arange(len(m)), regions.unit(m), eps, least)
    assert label.tolist() == want.tolist() and core.tolist() == [found[i * 3 + 1][1] for i in range(len(m))]


def test_copies_take_rows_in_proportion(spark, monkeypatch):
    """Copies of one vector, with noise: what is written follows the rows, not their pairs."""
    monkeypatch.setattr(regions, "BLOCK", 64)
    rows = []
    monkeypatch.setattr(density, "written", lambda df, name: (lambda t: (rows.append(t.count()), t)[1])(written(df, name)))
    r = np.random.RandomState(5)
    taken = []
    for n in (1000, 4000):
        m = np.concatenate([np.repeat(r.randn(1, 16), n, axis=0), r.randn(40, 16)])
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
        rows.clear()
        labels = density.dbscan(df, 0.2, 3)
        assert labels.where("label = 0 and is_core").count() == n and labels.where("label = -1").count() >= 30
        taken.append(sum(rows))
    assert taken[1] < 5 * taken[0]


def test_nearest_of_many_centroids(spark, monkeypatch):
    """An index over parts of centroids gives the nearest one, of equal ones the lowest key."""
    monkeypatch.setattr(neighbors, "CENTROIDS", 50)
    monkeypatch.setattr(regions, "BLOCK", 20)
    r = np.random.RandomState(4)
    c = r.randn(400, 8)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    c[200:260] = c[:60]
    keys = r.permutation(1000)[:400]
    cents = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(keys, c, strict=True)], "cluster_id long, centroid array<double>")
    m = np.concatenate([r.randn(150, 8), c[:70]]).astype(np.float32)
    probe = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    u = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    dist = 1 - u @ c.T
    got = {row["id"]: (row["cluster_id"], row["dist"]) for row in neighbors.nearest_centroid(probe, cents).collect()}
    assert len(got) == len(m)
    for i in range(len(m)):
        least = dist[i].min()
        assert abs(got[i][1] - least) < 1e-12
        assert got[i][0] == min(keys[np.abs(dist[i] - least) < 1e-13])
    assert neighbors.nearest_centroid(probe, cents)._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD[id") == 1  # one pass over the vectors


def test_full_clustering_clears_names_and_keeps_nothing_without_faces(make):
    a, b = unit(1), unit(999)
    c = make([{"id": i, "v": near(a, i), "cluster": 7} for i in range(1, 4)] + [{"id": i, "v": near(b, i)} for i in range(4, 7)] + [{"id": 7, "v": unit(70001)}, {"id": 8, "v": near(a, 8), "dismissed": 1}], [(7, "Alice")])
    state, n = clustering.full_clustering(c)
    assert n == 2 and sorted(named(state).values()) == ["Person_001", "Person_002"]
    got = of(state)
    assert len({got[1], got[2], got[3]}) == 1 and got[1] != got[4] == got[5] == got[6] and got[7] is None and got[8] is None
    none = make([{"id": 1, "dismissed": 1}], [(7, "Alice")])
    state, n = clustering.full_clustering(none)
    assert n == 0 and named(state) == {7: "Alice"}


def test_incremental_assigns_finds_and_names(make):
    a, b = unit(42), unit(9999)
    faces = [{"id": i, "v": near(a, i), "cluster": 1} for i in range(1, 4)] + [{"id": 4, "v": near(a, 4)}] + [{"id": i, "v": near(b, i)} for i in range(5, 8)] + [{"id": 8, "v": unit(70002)}]
    state, counts = clustering.incremental_clustering(make(faces, [(1, "Zoe"), (2, "Person_007")]))
    assert counts == {"assigned": 1, "new_clusters": 1, "maybe_clusters": 0, "new_noise": 1}
    assert of(state)[4] == 1 and of(state)[5] == of(state)[6] == of(state)[7] == 3 and named(state)[3] == "Person_008" and of(state)[8] is None
    again, counts = clustering.incremental_clustering(make([f for f in faces if f.get("cluster")], [(1, "Zoe")]))
    assert counts["assigned"] == counts["new_clusters"] == 0
    # nothing within 0.05, but within the tentative radius
    shifted = [{"id": 10 + i, "v": near(near(a, 50, 0.03), i, 0.004)} for i in range(3)]
    state, counts = clustering.incremental_clustering(make(faces[:3] + shifted, [(1, "Zoe")]), eps=0.05, maybe_eps=0.5)
    assert counts["maybe_clusters"] == 1 and named(state)[2] == "maybe Zoe"


def brute_linkage(m, eps):
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    d = 1 - m @ m.T
    groups = [[i] for i in range(len(m))]
    while len(groups) > 1:
        best = min(((np.mean([d[x, y] for x in p for y in q]), i, j) for i, p in enumerate(groups) for j, q in enumerate(groups) if i < j), key=lambda t: t[0])
        if best[0] >= eps:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_merging_in_rounds_equals_the_sequential_one():
    rng = np.random.RandomState(3)
    for n in (1, 2, 17, 30):
        for eps in (0.5, 0.8, 1.1):
            m = rng.randn(n, 5)
            m[: n // 3] = m[: n // 3] * 0.1 + m[0]
            u = m / np.linalg.norm(m, axis=1, keepdims=True)
            roots = linkage.merged(np.arange(n), u, np.ones(n), eps)
            assert {frozenset(np.flatnonzero(roots == k).tolist()) for k in set(roots.tolist())} == brute_linkage(m, eps)


@pytest.mark.parametrize("block", [2048, 6])
def test_average_linkage_over_parts(spark, monkeypatch, block):
    monkeypatch.setattr(regions, "BLOCK", block)
    rng = np.random.RandomState(4)
    m = np.concatenate([c + 0.5 * rng.randn(8, 6) for c in rng.randn(4, 6)])[rng.permutation(32)]
    df = spark.createDataFrame([(10 + i, [float(x) for x in v]) for i, v in enumerate(m)] + [(99, None)], "id long, embedding array<double>")
    found = {r["id"]: r["label"] for r in linkage.average_linkage(df, 0.6).collect()}
    groups = sorted(brute_linkage(m, 0.6), key=min)
    assert found == {10 + i: k for k, g in enumerate(groups) for i in g}
    assert linkage.average_linkage(df.limit(0), 0.6).count() == 0


def test_recluster_splits_and_keeps_the_largest(make):
    a, b = unit(1), unit(999)
    faces = [{"id": i, "v": near(a, i), "cluster": 1} for i in range(1, 5)] + [{"id": i, "v": near(b, i), "cluster": 1} for i in range(5, 8)] + [{"id": 8, "v": unit(70003), "cluster": 1}]
    state, result = clustering.recluster(make(faces, [(1, "Mix"), (2, "Person_010")]), 1)
    assert result == {"original_faces": 8, "new_clusters": 1, "noise": 1}
    got = of(state)
    assert [got[i] for i in range(1, 5)] == [1] * 4 and got[5] == got[6] == got[7] == 3 and got[8] is None and named(state)[3] == "Person_011"
    same, result = clustering.recluster(make(faces[:4], [(1, "One")]), 1)
    assert result == {"original_faces": 4, "new_clusters": 0, "noise": 0} and of(same)[1] == 1
    assert clustering.recluster(make(faces[:1], [(1, "One")]), 1)[1] == {"original_faces": 1, "new_clusters": 0, "noise": 0}
    with pytest.raises(KeyError):
        clustering.recluster(make(faces, [(1, "Mix")]), 99)


def test_automatic_numbers_are_never_given_twice(make):
    c = make([{"id": 1}], [(1, "Person_004"), (2, "Person_008x")]).to(last_auto=20)
    assert clustering.highest_auto(c) == 20 and clustering.highest_auto(c.to(last_auto=0)) == 8


def test_centroids_are_unit_means_and_nearest_takes_the_lowest_of_equals(spark, make):
    c = make([{"id": 1, "v": [1, 0], "cluster": 1}, {"id": 2, "v": [0, 1], "cluster": 1}, {"id": 3, "v": [1, 0], "cluster": 2}, {"id": 4, "v": [-1, 0], "cluster": 2}], [(1, "a"), (2, "b")])
    got = {r["cluster_id"]: r["centroid"] for r in clustering.centroids(c).collect()}
    assert np.allclose(got[1], [0.5**0.5] * 2) and np.allclose(got[2], [0, 0])
    cents = spark.createDataFrame([(5, [1.0, 0.0]), (3, [1.0, 0.0])], "cluster_id long, centroid array<double>")
    probe = spark.createDataFrame([(1, [2.0, 0.0])], "id long, embedding array<float>")
    row = neighbors.nearest_centroid(probe, cents).first()
    assert row["cluster_id"] == 3 and abs(row["dist"]) < 1e-12
    assert neighbors.nearest_centroid(probe, cents.limit(0)).count() == 0


def test_packed_vectors_round_trip(spark):
    df = spark.createDataFrame([(1, [0.5, -2.0]), (2, None)], "id long, v array<float>")
    back = df.select("id", vectors.decode_f32(vectors.encode_f32("v")).alias("v")).orderBy("id").collect()
    assert back[0]["v"] == [0.5, -2.0] and back[1]["v"] is None


@pytest.mark.parametrize("block, most", [(2048, 4096), (16, 4096), (16, 3)])
def test_radius_join_over_parts_of_blocks(spark, monkeypatch, block, most):
    """Blocks larger than BLOCK are dealt to parts; every pair is found once."""
    monkeypatch.setattr(regions, "BLOCK", block)
    monkeypatch.setattr(regions, "MOST_BLOCKS", most)
    r = np.random.RandomState(1)
    m = r.randn(6, 8)[r.randint(0, 6, 150)] + 0.3 * r.randn(150, 8)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, embedding array<float>")
    u = m.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    dist = 1 - u @ u.T
    got = sorted((r["a"], r["b"]) for r in neighbors.radius_join(df, 0.1).collect())
    assert got == sorted((i, j) for i in range(150) for j in range(i + 1, 150) if dist[i, j] <= 0.1)
    assert neighbors.radius_join(df.limit(0), 0.1).count() == 0
