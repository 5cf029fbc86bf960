import random

import public_tokenizers as P
from pyspark.sql import functions as F
from test_ngramjoin import brute, two_in_smaller_groups_than_their_stars

import corpus_pipeline
from lightbox.llm import bpe, mixing, ngramjoin, quality, queries

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_copies", "pii", "mixing", "encode"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = corpus_pipeline.written(corpus_pipeline.reject_low_quality(spark, docs, SF), "t")
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert sum((i in ids) == bool(q) for i, q in labels.items()) / len(labels) > 0.95
    left = corpus_pipeline.written(corpus_pipeline.drop_near_copies(spark, kept, SF), "t")
    want = {r["component_id"] for r in ngramjoin.similar_documents(kept).collect()}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want) and left.columns == docs.columns
    clean = corpus_pipeline.written(corpus_pipeline.mask_personal_data(spark, left, SF), "t")
    assert clean.count() == left.count() and clean.where("text like '%@mail%'").count() == 0
    mixed = corpus_pipeline.written(corpus_pipeline.mix_sources(spark, clean, SF), "t")
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(clean).collect() if r["taken"]}
    assert mixed.columns == docs.columns and {r["doc_id"] for r in mixed.collect()} == set(taken)
    encoded = corpus_pipeline.encode(spark, mixed, SF)
    back = bpe.decode_documents(encoded.select("doc_id", "ids"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in mixed.collect())


def test_repeated_and_null_ids_leave_one_of_each_group(spark, docs, prose):
    texts = [prose(1, 40)] * 4 + [prose(2, 40), prose(3, 40), prose(3, 40), None]
    df = docs(texts, ids=[4, 4, 9, None, 5, None, None, 6])
    left = corpus_pipeline.drop_near_copies(spark, df, SF).collect()
    assert sorted(r["doc_id"] for r in left if r["doc_id"] is not None) == [4, 5, 6]


def test_each_component_keeps_exactly_one_row(spark, docs, prose):
    def near(k):
        return prose(k, 200) + " end"

    families = [[prose(k, 200), near(k), prose(k, 200)] for k in range(6)]
    # a null id beside an id; ids only null; an id with two unrelated texts; one row twice; alone with a null id
    ids = [[1, None, None], [None, None, None], [7, 2, None], [7, 7, 8], [3, 3, 3], [None, 7, 9]]
    alone = [(None, prose(50, 60)), (None, prose(51, 60)), (7, prose(52, 60)), (None, ""), (None, None), (6, None), (6, ""), (5, " ")]
    rows = [(i, t) for texts, some in zip(families, ids, strict=True) for i, t in zip(some, texts, strict=True)] + alone
    df = docs([t for _, t in rows], ids=[i for i, _ in rows])
    left = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()]
    for texts, some in zip(families, ids, strict=True):
        kept = [i for i, t in left if t in texts]
        assert kept == [min((i for i in some if i is not None), default=None)]
    for i, t in alone[:3]:
        assert left.count((i, t)) == 1
    assert sorted((str(i) for i, t in left if not (t or "").strip())) == ["5", "6", "None", "None"]
    assert len(left) == 13


def test_near_copies_whose_stars_leave_their_pair_out(spark, docs):
    texts = two_in_smaller_groups_than_their_stars()
    left = corpus_pipeline.drop_near_copies(spark, docs(texts), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({least for _, _, least in brute(texts, range(len(texts)))} - {1})


def test_near_copies_outside_the_groups_that_stars_take(spark, docs):
    """Texts made of a few common passages, most with their ends changed, so that a set lies in many groups and its links in any of them."""
    r, texts = random.Random(2), []
    for c in range(10):
        passages = [[f"c{c}p{k}w{i}" for i in range(r.randrange(2, 9))] for k in range(20)]
        some = lambda: passages[min(int(r.paretovariate(0.7)) - 1, 19)]  # noqa: E731, B023
        for _ in range(30):
            base = [w for _ in range(r.randrange(2, 8)) for w in some()]
            texts += [" ".join(w) for w in (base, base[r.randrange(3) :], base + some()[:2], some()[-1:] + base)]
    left = corpus_pipeline.drop_near_copies(spark, docs(texts), SF)
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({least for _, _, least in brute(texts, range(len(texts)))})


def test_stages_keep_columns_of_any_name(spark, docs, prose, odd):
    names = ["row_digest", "key_id", "KEY_DIGEST", "pii", "masked", "mix_shard", "mix_order", "sid", "quality", "meta", "digest", "top", "a.b"]
    texts = [prose(k, 40 + k) for k in range(12)] + [prose(3, 43), f"mail a.b@c.de {prose(99, 50)}", *odd[3:7], "", None]
    df = docs(texts, ids=[*range(17), None, None, 3])
    for name in names:
        df = df.withColumn(name, F.lit(7))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = corpus_pipeline.written(stage(spark, df, SF), f"t-{name}")
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "kept", *names], name
        assert all(r[c] == 7 for r in df.collect() for c in names)
    assert df.count() and corpus_pipeline.encode(spark, df, SF).columns == ["doc_id", "source", "n_tokens", "ids"]


def test_empty(spark, docs, tmp_path):
    docs([]).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_queries_run_and_the_sql_agrees(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = queries.queries()
    assert [n.split("_")[0] for n in found] == [f"op{k}" for k in range(1, 11)]
    n_docs = c.execute("SELECT count(*) FROM documents").fetchone()[0]
    for name, f in found.items():
        df = f(spark, SF)
        rows = df.collect()
        assert len(rows) == (n_docs if name != "op4_url_filter" else c.execute("SELECT count(*) FROM pages").fetchone()[0])
        if name in queries.oracle_sql():
            cur = c.execute(queries.oracle_sql()[name])
            names = [d[0] for d in cur.description]
            assert sorted(map(str, (tuple(r[k] for k in names) for r in rows))) == sorted(map(str, cur.fetchall()))


def test_quality_model_is_small(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    assert len(model.weights["text"]) == quality.N_TEXT + 1 and len(model.weights["meta"]) == quality.N_META + 1
    assert sum(r[0] + r[1] for r in model.rounds) and sum(r[2] + r[3] for r in model.rounds)
