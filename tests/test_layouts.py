import random
import re

import pytest
from pyspark.sql import functions as F

from lightbox.plans.names_index import NamesIndex, pieces_of
from lightbox.plans.pages import write_pages


def test_a_page_reads_one_folder(spark, tmp_path):
    r = random.Random(1)
    rows = [(i, f"name {r.randrange(400):03d}", i % 7) for i in range(1100)]
    df = spark.createDataFrame(rows, "id long, name string, n int").repartition(5)
    pages = write_pages(df, str(tmp_path / "p"), {"falling": -F.col("n"), "name": F.col("name"), "id": F.col("id")}, page_size=20, folder=10)
    want = sorted(rows, key=lambda x: (-x[2], x[1], x[0]))
    for k in (0, 1, 9, 10, 54):
        assert [x["id"] for x in pages.page(k).collect()] == [w[0] for w in want[k * 20 : k * 20 + 20]]
    assert pages.page(55).count() == 0 and pages.bounds().count() == 6 and pages.page(0).columns == ["id", "name", "n", "falling"]
    plan = spark._jvm.PythonSQLUtils.explainString(pages.page(31)._jdf.queryExecution(), "formatted")
    assert re.search(r"PartitionFilters: \[[^\]]*folder#\d+ = 3\)", plan) and "GreaterThanOrEqual(place,620)" in plan
    for at in (0, 199, 200, 777):
        key = (-want[at][2], want[at][1], want[at][0])
        assert [x["id"] for x in pages.from_key(*key).collect()] == [w[0] for w in want[at : at + 20]]
    assert [x["id"] for x in pages.from_key(-9, "", 0).collect()] == [w[0] for w in want[:20]]
    with pytest.raises(ValueError):
        write_pages(df.withColumn("place", F.lit(1)), str(tmp_path / "q"), {"id": F.col("id")})


def test_search_by_pieces_equals_a_look_at_all(spark, tmp_path):
    r = random.Random(2)
    names = ["", "a", "Ann", "anna", "Hanna Müller", "MÜLLER", "banana", "ananas", "naan", "50% off", "a_b", "x" * 300, None]
    names += ["".join(r.choice("abn ü") for _ in range(r.randrange(9))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(names)), "id long, name string")
    index = NamesIndex.create(df, str(tmp_path / "n"))
    for q in ("", "a", "An", "ann", "anana", "müll", "0% ", "_", "zzz", "nan nan", "x" * 40, "ü"):
        want = sorted(i for i, n in enumerate(names) if not q or (n is not None and q.lower() in n.lower()))
        assert sorted(x["id"] for x in index.search(df, q).collect()) == want, q
    assert pieces_of("anana") == ["ana", "nan"] and pieces_of("AB") == ["ab"]
    assert len(index.candidates("anna").join(df, "id").collect()) < len(names)
