import random

import numpy as np
import pytest

from lightbox.llm import quality


def corpus(prose, n=240):
    r = random.Random(2)
    texts, good = [], []
    for k in range(n):
        t = prose(k, r.randint(25, 120))
        good.append(k % 3 != 0)
        if not good[-1]:
            t = [t.upper().replace(" ", "!! "), " ".join(w + r.choice(["###", "***", "$$$"]) for w in t.split()), " ".join(t.split()[:2] * 40)][k % 9 // 3]
        texts.append(t)
    return texts, good


def test_held_out_accuracy(docs, spark, prose):
    texts, good = corpus(prose)
    labels = spark.createDataFrame([(i, int(g), 0) for i, g in enumerate(good) if i % 2] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    df = docs(texts)
    model = quality.fit(df, labels)
    rows = {r["doc_id"]: r for r in quality.score(df, model).collect()}
    assert np.mean([rows[i]["kept"] == good[i] for i in range(0, len(texts), 2)]) > 0.97
    assert all(0 <= rows[i][c] <= 1 for i in rows for c in quality.SCORES[:3]) and rows[0]["size"] == "extra"
    kept = quality.score(df, model, only_kept=True)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in rows if rows[i]["kept"]}


def views(n, seed=0):
    """(text, meta, y): six columns of the text and two kinds of metadata that tell good rows from bad ones, for most rows."""
    r = np.random.RandomState(seed)
    y = r.rand(n) < 0.6
    text = np.zeros((n, quality.N_TEXT), dtype=np.uint8)
    text[:, :6] = np.clip(90 + 30 * r.randn(n, 6) + 50 * y[:, None], 0, 255)
    meta = np.zeros((n, quality.META_KINDS), dtype=np.uint16)
    meta[:, 0] = np.where(r.rand(n) < 0.9, np.where(y, 1, 2), 3)
    meta[:, 1] = quality.N_LANG + r.randint(0, 9, n)
    meta[:, 2] = quality.N_LANG + quality.N_SOURCE + np.where(r.rand(n) < 0.8, 5 + y, 9)
    return text, meta, y


def test_views_teach_each_other():
    text, meta, y = views(1500)
    few = np.arange(len(y)) < 60
    model = quality.co_train(text[few], meta[few], y[few], quality.Arrays(text[~few], meta[~few]))
    # both directions, both classes
    assert len(model.rounds) == quality.ROUNDS and all(sum(r[k] for r in model.rounds) > 20 for k in range(4))
    assert (model.combine[:2] >= 0).all() and all(c[0] >= 0 for c in model.calibrated.values())
    a, b, both = model.score(text[~few], meta[~few])
    acc = lambda p: np.mean((p >= 0.5) == y[~few])
    alone = quality.co_train(text[few], meta[few], y[few], quality.Arrays(text[:0], meta[:0]), rounds=0).score(text[~few], meta[~few])
    assert acc(both) >= max(acc(a), acc(b)) - 0.01 and acc(both) > 0.93 and acc(both) >= acc(alone[2]) - 0.01


def test_lessons_and_limits_against_plain_loops():
    text, meta, y = views(400, 3)
    model = quality.co_train(text[:80], meta[:80], y[:80], quality.Arrays(text[80:], meta[80:]), rounds=1)
    pool = quality.Arrays(text[80:], meta[80:])
    cuts = {v: quality.limits(h, 0.6) for v, h in pool.histograms(model).items()}
    for v, x in pool.x.items():
        z = np.sort(model.view_logits(v, x))
        n_good, n_bad = (z >= cuts[v][0] * 2 * quality.LIMIT / quality.BINS - quality.LIMIT).sum(), (quality.bins(z) <= cuts[v][1]).sum()
        assert n_good >= 0.6 * quality.SHARE * len(z) - 1 and (n_bad >= 0.4 * quality.SHARE * len(z) - 1 or cuts[v][1] == quality.bins(np.log([1.5]))[0] - 1)
    got = pool.lessons(model, cuts, 0.6)
    for teacher, pupil in (("text", "meta"), ("meta", "text")):
        size = quality.VIEWS[pupil].size
        want = np.zeros(2 * size + 3)
        for k in range(len(text) - 80):
            one = lambda v: pool.x[v][k : k + 1]  # noqa: E731, B023
            z = model.view_logits(teacher, one(teacher))
            at, p = int(quality.bins(z)[0]), float(quality.sigmoid(z)[0])
            if at >= cuts[teacher][0] or at <= cuts[teacher][1]:
                w = (p - 0.6) / 0.4 if p >= 0.6 else (0.6 - p) / 0.6
                row = quality.VIEWS[pupil].dense(one(pupil))[0].astype(float)
                q = 1 / (1 + np.exp(-row @ model.weights[pupil]))
                want[:size] += w * (q - p) * row
                want[size : 2 * size] += w * q * (1 - q) * row**2
                want[-3:] += w, at >= cuts[teacher][0], at <= cuts[teacher][1]
        assert np.allclose(got[pupil], want, rtol=1e-3, atol=1e-4)


def test_the_table_learns_what_arrays_do(docs, spark, prose):
    texts, good = corpus(prose, 120)
    df = docs(texts, langs=[("en" if g else "de") if k % 4 else None for k, g in enumerate(good)])
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good) if i % 4 == 0], "doc_id long, quality int")
    model = quality.fit(df.repartition(5), labels)
    meta = lambda i: quality.meta_features(("en" if good[i] else "de") if i % 4 else None, f"s{i % 3}", len(texts[i]), 1)
    order = [r[0] for r in quality.sample(df, labels).collect()]
    rest = [i for i in range(len(texts)) if i % 4]
    side = lambda some: (np.stack([quality.text_features(texts[i]) for i in some]), np.stack([meta(i) for i in some]))
    plain = quality.co_train(*side(order), np.array([good[i] for i in order]), quality.Arrays(*side(rest)))
    assert model.rounds == plain.rounds and all(np.allclose(model.weights[v], plain.weights[v], atol=1e-4) for v in quality.VIEWS)


def test_a_weak_view_never_counts_against_itself():
    r = np.random.RandomState(4)
    y = (r.rand(300) < 0.5).astype(float)
    z = np.stack((6 * (y - 0.5) + r.randn(300), -2 * (y - 0.5) + r.randn(300)), axis=1)
    w = quality.combination(z, y)
    assert w[0] > 0 and w[1] == 0
    for n_bad in (1, 2, 5):
        train, held = quality.held_out(np.array([1] * 20 + [0] * n_bad))
        assert {0, 1} == set(np.array([1] * 20 + [0] * n_bad)[held]) == set(np.array([1] * 20 + [0] * n_bad)[train])


def test_odd_rows_and_missing_labels(docs, odd, spark):
    df = docs(odd, ids=[None, *range(1, len(odd))], langs=[None] * len(odd), sources=[None] * len(odd))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.score(df, quality.fit(df, none)).collect()
    assert len(rows) == len(odd) and all(r["kept"] and r["quality_score"] == 1.0 for r in rows)
    bad = spark.createDataFrame([(i, 0) for i in range(1, 9)], "doc_id long, quality int")
    assert not any(r["kept"] for r in quality.score(df, quality.fit(df, bad)).collect())
    assert quality.score(docs([]), quality.fit(docs([]), none)).count() == 0


def test_one_label_of_a_class_is_enough(docs, spark, prose):
    texts, good = corpus(prose, 60)
    first_bad = good.index(False)
    labels = spark.createDataFrame([(i, 1) for i in range(60) if good[i]] + [(first_bad, 0)], "doc_id long, quality int")
    rows = {r["doc_id"]: r for r in quality.score(docs(texts), quality.fit(docs(texts), labels)).collect()}
    assert not rows[first_bad]["kept"] and np.mean([rows[i]["kept"] for i in range(60) if good[i]]) > 0.9


def test_metadata_of_the_page_count():
    a, b = quality.meta_features("en", "s", 10, 1), quality.meta_features(None, "s", 10, 1)
    assert len(a) == quality.META_KINDS and (a != b).sum() == 1 and a.max() < quality.N_META and quality.text_features("").sum() == 0
    assert quality.meta_features("x", "y", 1 << 40, 1 << 40).max() < quality.N_META
    with pytest.raises(AttributeError):
        quality.text_features(None)


def test_clashing_columns(docs, spark):
    df = docs(["some text of a page", None])
    for name in ("P_TEXT", "quality_score", "quality", "meta", "odd_3", "a.b"):
        df = df.withColumn(name, df["doc_id"] + 70)
    model = quality.fit(df, spark.createDataFrame([], "doc_id long, quality int"))
    out = quality.score(df, model)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "quality", "meta", "odd_3", "a.b", *quality.SCORES]
    kept = quality.score(df, model, only_kept=True)
    assert kept.columns == df.columns and sorted(r["a.b"] for r in kept.collect()) == [70, 71]


def test_a_labelled_id_that_occurs_often_comes_once(docs, prose, spark, monkeypatch):
    texts = [prose(k, 60) for k in range(30)] + ["#$% junk " * 20] * 30
    ids = [*range(60)]
    labels = spark.createDataFrame([(i, int(i < 30), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    seen, plain = [], quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda text, meta, y, pool, *more: (seen.append(y.copy()), plain(text, meta, y, pool, *more))[1])
    one = docs(texts, ids=ids)
    quality.fit(one, labels)
    quality.fit(one.unionByName(docs([prose(1, 60), "another text"] * 50, ids=[1] * 100)), labels)
    assert len(seen[0]) == len(seen[1]) == 60 and (seen[0] == seen[1]).all()
