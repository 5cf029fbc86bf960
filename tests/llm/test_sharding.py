import random
import zlib
from collections import Counter, defaultdict

import pytest

from lightbox.llm import sharding


def shards_of(df, **options):
    return [r.asDict() for r in sharding.assign_shards(df, **options).collect()]


def gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    return all(sorted(v) == list(range(len(v))) for v in by.values())


def test_odd_rows(docs, odd):
    rows = shards_of(docs(odd, ids=[None, 1, 1, *range(3, 12), None]))
    assert len(rows) == len(odd) and gapless(rows) and all(0 <= r["shard"] < 8 for r in rows)
    want = Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in odd)
    assert Counter((r["size"], r["text_crc32"]) for r in rows) == want


def test_empty(docs, spark):
    assert shards_of(docs([])) == []


@pytest.mark.parametrize("options, run", [({}, 100_000), ({"units_per_block": 50, "fan_in": 4}, 100_000), ({}, 1)])
def test_balance_with_a_hot_group(docs, prose, monkeypatch, options, run):
    monkeypatch.setattr(sharding, "RUN", run)
    r = random.Random(4)
    texts = [prose(k, r.randint(1, 120)) for k in range(500)] + [prose(9999, 60)] * 260
    rows = shards_of(docs(texts), **options)
    assert gapless(rows)
    sums = {k: Counter() for k in ("bytes", "rows")}
    for x in rows:
        sums["bytes"][x["shard"]] += x["size"]
        sums["rows"][x["shard"]] += 1
    for k, most in (("bytes", 1.02), ("rows", 1.06)):
        assert len(sums[k]) == 8 and max(sums[k].values()) / (sum(sums[k].values()) / 8) < most


def test_copies_stay_together_unless_hot(docs, prose):
    texts = [prose(k, 40) for k in range(1200)] + [prose(3, 40)]
    rows = shards_of(docs(texts))
    crc = zlib.crc32(prose(3, 40).encode())
    assert len({r["shard"] for r in rows if r["text_crc32"] == crc}) == 1


@pytest.mark.parametrize("sf, most", [("sf0.01", 1.005), ("sf0.1", 1.005)])
def test_groups_of_the_tables_stay_whole(spark, sf, most):
    rows = sharding.assign_shards(spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")).collect()
    of, size = defaultdict(set), Counter()
    for r in rows:
        of[bytes(r["digest"])].add(r["shard"])
        size[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in of.values())
    assert max(size.values()) < most * sum(size.values()) / 8 and gapless([r.asDict() for r in rows])


@pytest.mark.parametrize("run", [100_000, 3])
def test_groups_of_several_sizes_stay_whole(docs, prose, monkeypatch, run):
    """Groups of up to a third of a shard's rows, in one block and in many, numbered in runs."""
    monkeypatch.setattr(sharding, "RUN", run)
    texts = [prose(k, 30) for k in range(900)] + [prose(5000 + k, 30) for k in range(9) for _ in range(4 * (k + 1))]
    for options in ({}, {"units_per_block": 100, "fan_in": 3}):
        rows = shards_of(docs(texts), **options)
        of = defaultdict(set)
        for r in rows:
            of[bytes(r["digest"])].add(r["shard"])
        assert gapless(rows) and all(len(s) == 1 for s in of.values())


def test_a_hot_group_without_ids_is_spread(docs, prose):
    rows = shards_of(docs([prose(k, 30) for k in range(200)] + [prose(9999, 30)] * 400, ids=[*range(200), *[None] * 400]))
    sizes = Counter(r["shard"] for r in rows if r["doc_id"] is None)
    assert gapless(rows) and len(sizes) == 8 and max(Counter(r["shard"] for r in rows).values()) < 1.1 * 75


def test_packing_against_a_plain_one():
    """``place`` puts each vector, largest first, where the dot product with what is left of the capacity is highest."""
    r = random.Random(9)
    for n_bins in (2, 3, 8):
        vectors = [(r.randint(1, 50) ** 2, r.randint(0, 90), 1) for _ in range(60)]
        got = sharding.place(vectors, n_bins)
        full = [sum(v[k] for v in vectors) / n_bins for k in range(3)]
        weight = [sharding.BYTE_WEIGHT, 1.0, 1.0]
        used = [[0.0] * 3 for _ in range(n_bins)]
        size = lambda i: max(weight[k] * vectors[i][k] / full[k] for k in range(3))  # noqa: E731, B023
        for i in sorted(range(60), key=lambda i: (-size(i), i)):
            gain = [sum((weight[k] * vectors[i][k] / full[k]) * (weight[k] - weight[k] * used[b][k] / full[k]) for k in range(3)) for b in range(n_bins)]
            assert gain[got[i]] >= max(gain) - 1e-9
            for k in range(3):
                used[got[i]][k] += vectors[i][k]
        sums = [sum(v[0] for v, b in zip(vectors, got, strict=True) if b == k) for k in range(n_bins)]
        assert max(sums) < 1.15 * sum(sums) / n_bins


def test_files_hold_rows_of_null_and_repeated_ids(docs, prose, spark, tmp_path):
    df = docs(["a b", "c", "c", "a b", None, None, prose(1, 9)], ids=[None, None, 1, 1, 1, None, 1])
    for name in ("SHARD", "shard_mark", "shard_copy", "plan_id", "slot", "digest", "x.y"):
        df = df.withColumn(name, df["doc_id"] * 0 + 5)
    df.unionByName(df).write.parquet(str(tmp_path / "in"))  # every row twice
    df = spark.read.parquet(str(tmp_path / "in"))
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(c for c in back.columns if c != "shard") == sorted(c for c in df.columns if c != "SHARD")
    key = lambda r: (str(r["doc_id"]), str(r["text"]), str(r["slot"]), str(r["x.y"]))
    assert Counter(map(key, back.collect())) == Counter(map(key, df.collect()))
    plan = Counter((r["text_crc32"], r["shard"]) for r in shards_of(df))
    assert Counter((zlib.crc32((r["text"] or "").encode()), r["shard"]) for r in back.collect()) == plan


def test_reruns_agree_and_files_hold_all(docs, prose, spark, tmp_path):
    df = docs([prose(k, 20) for k in range(60)])
    assert sorted(map(str, shards_of(df))) == sorted(map(str, shards_of(df.repartition(5))))
    sharding.write_shards(df, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["doc_id"], r["shard"]) for r in back.collect()} == {(r["doc_id"], r["shard"]) for r in shards_of(df)}
