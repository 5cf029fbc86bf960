import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lightbox.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    """Targets by resharing the excess by weight until none is above twice its source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        w = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / w > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / w for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def corpus(prose):
    texts, sources = [], []
    for s, n, size in (("a", 40, 30), ("b", 300, 30), ("c", 3, 900), (None, 20, 10), ("é", 1, 5000), ("", 60, 20)):
        for k in range(n):
            texts.append(prose(hash((s or "none", k)) % 10**6, size + k % 7))
            sources.append(s)
    return texts + [None, "", "  "], sources + ["a", "b", None]


def test_taken_words_meet_the_targets(docs, corpus):
    texts, sources = corpus
    rows = mixing.mix(docs(texts, sources=sources)).collect()
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        t, s = texts[r["doc_id"]], sources[r["doc_id"]]
        assert r["size"] == len(WORD.findall(t or "")) and 0 <= r["taken"] <= 2 * r["size"]
        size[s] += r["size"]
        taken[s] += r["taken"]
        target[s] = r["target"]
    want = brute_targets(size)
    for s in want:
        assert target[s] == pytest.approx(want[s]) and abs(taken[s] - want[s]) <= 1
    assert len(rows) == len(texts) and {r["source_size"] for r in rows} == set(size.values())


def test_reruns_agree(docs, corpus):
    df = docs(*corpus[:1], sources=corpus[1])
    a, b = (sorted((r["doc_id"], r["taken"]) for r in mixing.mix(x).collect()) for x in (df, df.repartition(7)))
    assert a == b


def test_the_tree_keeps_quotas_exact(docs, corpus, spark):
    texts, sources = corpus
    rows = mixing.mix(docs(texts, sources=sources)).collect()
    target = {sources[r["doc_id"]]: r["target"] for r in rows}
    facts = docs(texts, sources=sources).select("source", mixing.n_words(F.col("text")).alias("size"))
    bounds = {r["source"]: r["bounds"] for r in mixing.quotas(mixing.source_targets(facts)).collect()}
    got = defaultdict(Counter)
    for r in rows:
        assert sum(r["shard_words"]) == r["taken"] and len(r["shard_words"]) == 8
        for k, n in enumerate(r["shard_words"]):
            got[sources[r["doc_id"]]][k] += n
    unit = -(-sum(round(t) for t in target.values()) // mixing.UNITS) + 1
    shards = Counter()
    for s, t in target.items():
        # each (source, shard) holds its quota to the word, and quotas sum to the target
        assert [got[s][k] for k in range(8)] == [b - a for a, b in zip(bounds[s], bounds[s][1:], strict=False)]
        assert abs(sum(got[s].values()) - t) <= 1
        shards.update(got[s])
        if t > 200 * unit:  # near an eighth: the spread of a draw without replacement
            n = t / unit
            assert all(abs(got[s][k] / unit - n / 8) <= 5 * (n / 8) ** 0.5 + 1 for k in range(8))
    assert max(shards.values()) - min(shards.values()) <= (3 + len(target)) * unit


def test_intervals_against_a_plain_line(docs, corpus, monkeypatch):
    """Rows of a source, in the order of passes, blocks and documents, fill the shards' quotas one after another."""
    monkeypatch.setattr(mixing, "FAN_OUT", 4)  # several levels of blocks
    df = docs(*corpus[:1], sources=corpus[1])
    facts, sources, plan = mixing._planned(df, 8, 17, 1.5, 2.0)
    placed = mixing._placed(facts, sources, 17)
    bounds = {r["sid"]: r["bounds"] for r in sources.collect()}
    starts = {(r["plan_sid"], r["plan_block"]): r["starts"] for r in plan.collect()}
    rows = placed.withColumn("o", F.xxhash64(F.lit(17), F.lit("doc"), "doc_id", "mark")).collect()
    blocks = defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["sid"], r["block"], r["o"])):
        blocks[r["sid"], r["block"]].append(r)
    for sid, size in {r["sid"]: r["source_size"] for r in rows}.items():
        for p in (0, 1):  # blocks of a pass lie end to end
            spans = sorted((s[p], s[p] + sum(r["size"] for r in blocks[k])) for k, s in starts.items() if k[0] == sid)
            spans = [x for x in spans if x[0] < x[1]]
            assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False)) and (not spans or (spans[0][0], spans[-1][1]) == (p * size, (p + 1) * size))
    want = defaultdict(lambda: [0] * 8)
    for key, some in blocks.items():
        for p in (0, 1):
            at = starts[key][p]
            for r in some:
                for k in range(8):
                    want[r["doc_id"]][k] += max(0, min(at + r["size"], bounds[key[0]][k + 1]) - max(at, bounds[key[0]][k]))
                at += r["size"]
    got = {r["doc_id"]: r["shard_words"] for r in mixing.mix(df).collect()}
    assert all(got[i] == want[i] for i in got)


def test_drawn_texts_hold_the_taken_words(docs, corpus):
    df = docs(corpus[0], sources=corpus[1])
    want = {r["doc_id"]: r["shard_words"] for r in mixing.mix(df).collect() if r["taken"]}
    got, copies = defaultdict(lambda: [0] * 8), defaultdict(Counter)
    out = mixing.draw(df)
    assert out.columns == [*df.columns, "mix_shard"]
    for r in out.collect():
        words, all_words = WORD.findall(r["text"]), WORD.findall(corpus[0][r["doc_id"]])
        (at, *_) = [k for k in range(len(all_words)) if all_words[k : k + len(words)] == words]
        assert r["n_chars"] == len(r["text"]) and at is not None
        got[r["doc_id"]][r["mix_shard"]] += len(words)
        copies[r["doc_id"]].update(all_words if len(words) == len(all_words) else words)
    assert dict(got) == want
    for i, c in copies.items():  # parts of a divided document are disjoint
        assert all(n <= 2 * m for n, m in ((c[w], Counter(WORD.findall(corpus[0][i]))[w]) for w in c))


def test_clashing_columns_stay(docs):
    df = docs(["a b c d"] * 30, sources=["s"] * 30)
    names = ["mix_size", "mix_block", "mix_order", "mix_shard", "sid", "block", "takes", "body", "mark", "starts", "bounds", "words", "target", "x.y"]
    for name in names:
        df = df.withColumn(name, F.lit(777))
    out = mixing.draw(df)
    assert out.columns == [*df.columns, "mix_shard_"] and all(r[c] == 777 for r in out.collect() for c in names)
    assert mixing.mix(df).count() == 30


def test_small_tables(docs):
    assert mixing.mix(docs([])).count() == 0 and mixing.draw(docs([])).count() == 0
    (row,) = mixing.mix(docs([None])).collect()
    assert (row["size"], row["taken"], row["target"]) == (0, 0, 0.0)
    rows = mixing.mix(docs(["a b c"] * 3, ids=[1, 1, None], sources=["s"] * 3)).collect()
    assert sum(r["taken"] for r in rows) == 14 and len(rows) == 3  # 1.5 times 9 words, rounded to even
