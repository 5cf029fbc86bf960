import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lightbox.llm import ngramjoin, shingles


def words(text):
    return [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in (text or "").encode().split()]


def sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(texts, ids):
    s, parent = sets(texts), list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(s)):
        for j in range(i):
            if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j]):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(s)):
        if ids[i] is not None:
            least[root(i)] = min(ids[i], least.get(root(i), ids[i]))
    return Counter((ids[i], len(s[i]), least.get(root(i)) if s[i] else ids[i]) for i in range(len(s)))


def found(df):
    return Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngramjoin.similar_documents(df).collect())


def edits(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = "changed" + str(r.randrange(99))
    return " ".join(w)


def family_corpus(prose):
    r = random.Random(11)
    texts = []
    passage = prose(777, 60)
    for k in range(25):
        base = prose(k, r.choice([4, 6, 30, 90, 200]))
        texts.append(base)
        texts += [edits(r, base, e) for e in (0, 1, 1, 2, 3, 5, 8)]
        texts.append(base.upper().replace(" ", "  \n"))
        texts.append(base + " " + " ".join(prose(k + 5000, 50).split()[: len(base.split()) // 5]))
        texts.append(prose(k + 100, 40) + " " + passage)
    r.shuffle(texts)
    return texts


def test_shingles_equal_plain_sets(odd, prose):
    texts = [t or "" for t in odd] + [prose(k, k) for k in range(40)]
    found_sets, plain = shingles.shingle_sets(texts), sets(texts)
    assert [len(a) for a in found_sets] == [len(b) for b in plain]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(found_sets[i], found_sets[j])) == len(plain[i] & plain[j])


def test_components_equal_brute_force(docs, prose):
    texts = family_corpus(prose)
    assert found(docs(texts)) == brute(texts, list(range(len(texts))))


@pytest.mark.parametrize("name, value", [("BROADCAST_IDS", 0), ("BROADCAST_BYTES", 0), ("ONE_TASK", 0), ("BLOCK", 3), ("HUB", 2), ("BATCH", 10), ("BUCKET", 200), ("MOST_BITS", 64), ("MOST_COUNTERS", 64), ("ID_BITS", 16), ("MOST_SHARED", 1)])
def test_other_ways_give_the_same(docs, prose, monkeypatch, name, value):
    monkeypatch.setattr(ngramjoin, name, value)
    texts = family_corpus(prose)[:150]
    assert found(docs(texts)) == brute(texts, list(range(len(texts))))


@pytest.mark.parametrize("group, bucket, counters", [(4, 2_000_000, 1 << 24), (4, 20, 1 << 24), (3, 10, 256), (16, 5, 1 << 24)])
def test_very_common_shingles_are_dealt_to_parts_and_blocks(docs, prose, monkeypatch, group, bucket, counters):
    for name, value in (("GROUP", group), ("BUCKET", bucket), ("MOST_COUNTERS", counters), ("LEAST_COUNTERS", 256)):
        monkeypatch.setattr(ngramjoin, name, value)
    r = random.Random(1)
    base = prose(5, 50)
    # one family, another one that shares its first half, a chain whose ends don't link, and texts of their own
    texts = [edits(r, base, k % 4) for k in range(40)] + [prose(k, 30) for k in range(20)]
    texts += [base + " " + edits(r, prose(9, 30), k % 3) for k in range(12)]
    chain = [prose(30, 40).split()]
    for k in range(8):
        chain.append([*chain[-1][2:], f"n{k}", f"m{k}"])
    texts += [" ".join(c) for c in chain]
    assert found(docs(texts)) == brute(texts, list(range(len(texts))))


def test_no_group_a_task_sees_is_over_its_bound(docs, prose, monkeypatch):
    monkeypatch.setattr(ngramjoin, "GROUP", 8)
    sizes, plain = [], ngramjoin._pairs

    def seen(groups, *rest):
        sizes.append(max((r["count"] for r in groups.groupBy("group_id").count().collect()), default=0))
        return plain(groups, *rest)

    monkeypatch.setattr(ngramjoin, "_pairs", seen)
    r = random.Random(1)
    base = prose(5, 50)
    texts = [edits(r, base, 1 + k % 9) for k in range(120)]
    assert found(docs(texts)) == brute(texts, list(range(len(texts))))
    assert len(sizes) == 3 and max(sizes) <= 6 * 8  # parts are dealt by a hash, so some are larger; blocks have two


def test_the_sketch_does_not_saturate():
    counts = np.array([0, 1, 2, 3, 65_535, 65_536, 10_000_000, 3_000_000_000])
    assert (ngramjoin.unsqueezed(ngramjoin.squeezed(counts)) == counts).all()
    steps = np.ceil(ngramjoin.STEPS * np.log2(1 + counts)).astype(np.uint8)
    assert (np.diff(steps.astype(int))[[0, 1, 2, 3, 5, 6]] > 0).all() and (np.exp2(steps / ngramjoin.STEPS) > counts).all()


def test_linked_sets_share_that_many_prefix_shingles():
    r = np.random.RandomState(5)
    for n in (5, 8, 16, 17, 24, 31, 32, 39, 40, 41, 100, 300, 900, 2000):
        for _ in range(20):
            both = -(-4 * n // 5) + r.randint(0, n - -(-4 * n // 5) + 1)
            m = r.randint(both, max(both, 5 * both // 4 + both - n) + 1)  # up to the largest that still links
            if 5 * both < 4 * (n + m - both):
                continue
            universe = r.permutation(5000)[: n + m - both]
            a, b = np.sort(universe[:n]), np.sort(universe[n - both :])
            k = len(np.intersect1d(a[: ngramjoin.prefix_length(n)], b[: ngramjoin.prefix_length(m)]))
            assert k >= min(ngramjoin.shared(n), ngramjoin.shared(m)) >= ngramjoin.shared(-(-4 * n // 5))


def test_sets_of_the_same_number_get_others(docs, prose, monkeypatch):
    monkeypatch.setattr(ngramjoin, "ID_BITS", 11)
    texts = [prose(k, 30) for k in range(60)]
    df = docs(texts + texts[:5])
    sketch = df.sparkSession.sparkContext.broadcast(ngramjoin._sketch(df))
    assert ngramjoin._sets(df, sketch, 0).select("set_id").distinct().count() < 60  # some have the same one
    sets, salt = ngramjoin._numbered_sets(df, sketch, False)
    assert salt > 0 and sets.select("set_id").distinct().count() == 60


def test_odd_rows(docs, odd):
    ids = [None, 7, 7, *range(10, 10 + len(odd) - 3)]
    assert found(docs(odd, ids=ids)) == brute(odd, ids)
    assert ngramjoin.similar_documents(docs([])).count() == 0


def test_the_threshold_is_inclusive(docs):
    w = [f"w{k}" for k in range(100)]
    a, b, c = " ".join(w[:49]), " ".join(w[:40]), " ".join(w[:39])  # 45, 36 and 35 shingles: 36/45 = 0.8, 35/45 < 0.8
    rows = {r["doc_id"]: r["component_id"] for r in ngramjoin.similar_documents(docs([a, b])).collect()}
    assert rows == {0: 0, 1: 0}
    rows = {r["doc_id"]: r["component_id"] for r in ngramjoin.similar_documents(docs([a, c])).collect()}
    assert rows == {0: 0, 1: 1}


def test_trees_lose_no_pair():
    r = np.random.RandomState(3)
    universe = r.randint(0, 1 << 62, 400).astype(np.uint64)
    each = []
    for k in range(120):
        base = universe[(k % 6) * 60 : (k % 6) * 60 + 60]
        each.append(np.unique(np.concatenate((r.choice(base, r.randint(40, 60), replace=False), r.choice(universe, 3)))))
    each.sort(key=len)
    n, bits = np.array([len(x) for x in each]), [ngramjoin.signature(x) for x in each]
    ids = np.arange(len(each))
    got = {tuple(p) for pairs in ngramjoin.cross_pairs(ids, n, bits, ids) for p in pairs.T.tolist()}
    want = {(i, j) for j in range(len(each)) for i in range(j) if len(np.intersect1d(each[i], each[j])) >= ngramjoin.needed(n[i] + n[j])}
    assert want and want <= got and len(got) < 120 * 119 // 2 / 3


def test_no_column_is_needed_but_two(docs, prose):
    df = docs([prose(1, 20)] * 3).select("doc_id", "text", F.lit(1).alias("n"), F.lit(2).alias("set_id"))
    assert [(i, c) for i, _, c in sorted(found(df))] == [(0, 0), (1, 0), (2, 0)]


def test_texts_of_one_template_make_few_pairs():
    """600 shingles in common, 100 of their own: not linked, and bitmaps can't tell; what comes after the first common shingle does."""
    r = np.random.RandomState(6)
    common = r.randint(0, 1 << 62, 600).astype(np.uint64)
    for n in (1_500, 5_000):
        sets = [np.concatenate((common, r.randint(0, 1 << 62, 100).astype(np.uint64))) for _ in range(n)]
        sizes = np.full(n, 700)
        bits = [ngramjoin.signature(np.sort(x)) for x in sets]
        made = lambda rest: sum(p.shape[1] for p in ngramjoin.cross_pairs(np.arange(n), sizes, bits, np.arange(n), rest))  # noqa: E731, B023
        assert made(sizes - 100) == 0  # own shingles come first in the order of all, as they are rare
        if n < 2_000:
            assert made(None) > n * n // 4


def test_places_lose_no_link():
    """Every linked pair is let through by the group of its first common shingle."""
    r = np.random.RandomState(8)
    for _ in range(30):
        base = r.permutation(5_000)[:120]
        sets = [np.unique(np.concatenate((r.permutation(base)[: r.randint(90, 121)], r.randint(0, 5_000, r.randint(0, 20))))) for _ in range(12)]
        order = r.permutation(5_000)
        ranked = [x[np.argsort(order[x])] for x in sets]
        for i in range(12):
            for j in range(i):
                both = np.intersect1d(sets[i], sets[j])
                if 100 * len(both) >= 80 * (len(sets[i]) + len(sets[j]) - len(both)):
                    first = both[np.argmin(order[both])]
                    rest = [len(x) - int(np.flatnonzero(x == first)[0]) for x in (ranked[i], ranked[j])]
                    assert min(rest) >= ngramjoin.needed(len(sets[i]) + len(sets[j]))
                    assert all(int(np.flatnonzero(x == first)[0]) < ngramjoin.prefix_length(len(x)) for x in (ranked[i], ranked[j]))


def two_in_smaller_groups_than_their_stars():
    """Two linked texts that share a group of two only; each has two larger groups with texts it doesn't link with."""
    common = [f"w{k}" for k in range(20)]
    fill = lambda name, n: [f"{name}{k}" for k in range(n)]
    texts = [" ".join([f"{x}0", f"{x}1", *common]) for x in "ab"]
    for k in range(7):  # make the beginning of what both hold, and two passages, common
        texts.append(" ".join(fill(f"p{k}x", 40) + common[:17] + fill(f"q{k}x", 40) + fill("f", 15) + fill(f"r{k}x", 40) + fill("g", 15) + fill(f"s{k}x", 40)))
    for x in "ab":
        for start in ([f"{x}0", f"{x}1", *common[:3]], [f"{x}1", *common[:4]]):
            texts += [" ".join(start + fill(passage, 15)) for passage in "fg"]
    return texts


def test_a_pair_that_shares_a_group_of_two_only_is_found(docs):
    texts = two_in_smaller_groups_than_their_stars()
    ids = list(range(len(texts)))
    got = found(docs(texts))
    assert got == brute(texts, ids) and got[(1, 18, 0)] == 1
