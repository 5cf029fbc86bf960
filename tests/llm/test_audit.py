import random
import re
from itertools import permutations

import pytest

from lightbox.llm import audit


def plainly(rows, labels):
    """rows: (doc_id, text, lang)."""
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(i, smallest.get(t or "", i))
    told = {}
    for i, good, toxic in labels:
        g, x = told.get(i, (False, False))
        told[i] = (g or good == 1, x or toxic == 1)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        failed = set()
        if len(w) < 100:
            failed.add("A")
        if 100 * len(set(w)) < 80 * len(w):
            failed.add("B")
        if 100 * len(re.findall("[A-Z]", t)) > 10 * len(t):
            failed.add("C")
        if re.search(r"[#$%&*|]", t):
            failed.add("D")
        if t in smallest and (i is None or i > smallest[t]):
            failed.add("E")
        docs.append((lang or "", failed, *(told.get(i, (False, False)) if i is not None else (False, False))))
    out, removals = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order):
                before = set(order[:step])
                live = [d for d in own if not d[1] & before]
                gone = [d for d in live if f in d[1]]
                removals[part, f] = removals.get((part, f), 0) + len(gone)
                out.append([part, "".join(order), step + 1, len(live) - len(gone), len(gone), sum(f in d[1] for d in own) - len(gone), sum(d[1] == {f} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)])
    return sorted((*r, removals[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.fixture(scope="module")
def rows(prose, odd):
    r = random.Random(9)
    texts = [*odd, *(prose(k, r.choice([20, 120, 300])) + r.choice(["", " #tag", " ABC" * 60]) for k in range(60)), *([prose(70, 130)] * 40), " ".join(f"w{k}" for k in range(150)), " ".join(f"w{k}" for k in range(150))]
    r.shuffle(texts)
    ids = [*range(len(texts) - 8), None, None, None, 3, 3, 5, -4, -4]
    return list(zip(ids, texts, [r.choice(["en", "de", None, ""]) for _ in texts], strict=True))


def result(df):
    return sorted(map(tuple, df.collect()))


def labelled(spark, rows):
    r = random.Random(2)
    told = [(i, r.choice([0, 1, None]), r.choice([0, 0, 1])) for i, _, _ in rows if r.random() < 0.6] + [(3, 0, 1), (3, 1, 0), (10_000, 1, 1)]
    return told, spark.createDataFrame(told, "doc_id long, quality int, toxic int")


def test_against_plain_counts(spark, docs, rows, monkeypatch):
    ids, texts, langs = zip(*rows, strict=True)
    told, labels = labelled(spark, rows)
    table = docs(list(texts), ids=list(ids), langs=list(langs))
    want = plainly(rows, told)
    got = audit.audit(table.repartition(5), labels)
    assert result(got) == want
    assert [t for _, t in got.dtypes] == ["string", "string", "int"] + ["bigint"] * 7
    with monkeypatch.context() as m:  # entries sent after every few rows
        m.setattr(audit, "FOLDED", 2_000)
        assert result(audit.audit(table, labels)) == want


def test_unlike_texts_with_one_hash_stay_apart(spark, docs, rows):
    ids, texts, langs = zip(*rows, strict=True)
    table = docs(list(texts), ids=list(ids), langs=list(langs)).repartition(7)
    order = lambda df: sorted(map(str, df.groupBy("doc_id", "part", "mask").sum("n").collect()))
    assert order(audit.masks(table)) == order(audit.masks(table, by_hash=lambda key: key % 3))


def test_a_hot_text_sends_an_entry_a_task(docs):
    checks = tuple(audit.CHECKS.values())
    sent = list(audit._folded(((i, "same text", "en") for i in range(10_000)), checks, 16))
    assert [s[0] for s in sent].count("text") == 1
    facts = [s for s in sent if s[0] == "fact"]
    assert sum(n for _, _, n in facts) == 9_999


def test_filters_of_ones_own(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    table = docs(["x", "y y", "x", "y y", "zz"])
    found = {(r["filter_order"], r["step"]): r for r in audit.audit(table, labels, part="source", checks={"L": lambda t: len(t.text) > 1}).where("part = 's0'").collect()}
    assert set(found) == {("LE", 1), ("LE", 2), ("EL", 1), ("EL", 2)}  # s0: documents 0 and 3
    assert (found["EL", 1]["removed"], found["EL", 2]["removed"], found["LE", 1]["removed"], found["LE", 2]["redundant"]) == (1, 0, 1, 1)
    assert found["LE", 1]["shapley"] == 1
    with pytest.raises(ValueError):
        audit.audit(table, labels, checks={"E": audit.has_marks})


def test_empty_table(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs(["x"]).where("doc_id < 0"), labels).count() == 0
