import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lightbox.llm import periodic


def plainly(w, repeats=4, least=6):
    """All runs by trying every period: (start, length, smallest period)."""
    n, found = len(w), {}
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(least, repeats * q):
                found.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def sequences():
    r = random.Random(11)
    for n in list(range(0, 14)) + [30, 64, 100, 257]:
        for letters in (1, 2, 3, 9):
            for _ in range(12):
                yield [r.randrange(letters) for _ in range(n)]
    for _ in range(200):  # repetitions side by side, some broken, in noise
        w = []
        for _ in range(r.randrange(1, 6)):
            p = [r.randrange(4) for _ in range(r.randrange(1, 12))]
            w += p * r.randrange(1, 9) + p[: r.randrange(len(p))] + [r.randrange(1000) for _ in range(r.randrange(4))]
        if r.random() < 0.5 and w:
            w[r.randrange(len(w))] = -1
        yield w
    a, b = [0], [0, 1]
    for _ in range(11):  # Fibonacci word: squares everywhere
        a, b = b, b + a
    yield b
    yield b * 5


def test_runs_are_those_of_the_plain_search():
    for w in sequences():
        numbers = np.unique(np.array(w, dtype=np.int64), return_inverse=True)[1].astype(np.int32) if w else np.zeros(0, np.int32)
        assert periodic.runs(numbers) == plainly(w), w
        assert periodic.runs(numbers, 5, 4) == plainly(w, 5, 4), w


def test_without_leaving_out_stretches(monkeypatch):
    monkeypatch.setattr(periodic, "stretches", lambda numbers, repeats, least: [(0, len(numbers))])
    for w in list(sequences())[::5]:
        if w:
            numbers = np.unique(np.array(w), return_inverse=True)[1].astype(np.int32)
            assert periodic.runs(numbers) == plainly(w), w


def test_z_function():
    for w in sequences():
        assert periodic.z_function(w) == [next((k for k in range(len(w) - i) if w[k] != w[i + k]), len(w) - i) for i in range(len(w))]


def test_a_long_repetition_takes_no_square_of_steps():
    n = 300_000
    assert periodic.runs(np.zeros(n, np.int32)) == [(0, n, 1)]
    assert periodic.runs((np.arange(n) % 1000).astype(np.int32)) == [(0, n, 1000)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plainly(w)
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(x for i, x in enumerate(w) if i not in drop)),
    )


def test_query_against_the_plain_search(spark, docs, odd, prose):
    texts = [*odd[:7], *odd[8:], prose(3, 900), "a b " * 40 + prose(4, 50) + " x" * 30, "\x1ca\x85b\xa0c " * 9, *(prose(k, 25) + " y z" * 5 for k in range(150))]
    ids = [None, *range(50, 50 + len(texts) - 2), -7]
    got = periodic.digests(periodic.find_runs(periodic.planted(docs(texts, ids=ids))))
    assert got.dtypes == [("doc_id", "bigint"), ("n_runs", "bigint"), ("start", "bigint"), ("length", "bigint"), ("period", "bigint"), ("exponent_milli", "bigint"), ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    want = [expected(i, t) for i, t in zip(ids, texts, strict=True)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in ids) > 5


def test_real_outputs_and_other_columns(spark, docs):
    table = docs(["a b a b a b a b c", None, "one"]).withColumn("runs", periodic.F.lit("mine")).withColumn("a.b", periodic.F.lit(1))
    rows = {r["doc_id"]: r for r in periodic.find_runs(table).collect()}
    assert rows[0]["collapsed"] == "a b c" and [tuple(r) for r in rows[0]["runs"]] == [(0, 8, 2)] and rows[0]["a.b"] == 1 and rows[0]["size"] == "extra"
    assert rows[1]["collapsed"] == "" and rows[1]["runs"] == [] and rows[2]["collapsed"] == "one"
    assert periodic.find_runs(table.where("doc_id > 9")).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(table, repeats=2)
