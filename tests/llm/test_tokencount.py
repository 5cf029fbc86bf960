import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from lightbox.llm import tokencount


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "word_bpe_49k.json"])
def test_counts_are_the_librarys(docs, odd, tmp_path, name):
    path = P.path(name)
    if name.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    else:
        model = Tokenizer.from_file(path)
        count = lambda t: len(model.encode(t, add_special_tokens=False).ids)
    texts = odd + ["special <s> </s> <unk> <|endoftext|> strings"]
    rows = {r["doc_id"]: r for r in tokencount.count_tokens(docs(texts), str(tmp_path / "cache"), path).collect()}
    assert {i: (r["n_bytes"], r["n_tokens"]) for i, r in rows.items()} == {i: (len((t or "").encode()), count(t or "")) for i, t in enumerate(texts)}


def test_only_distinct_misses_are_encoded_and_appended(docs, spark, tmp_path, prose):
    cache, path = str(tmp_path / "cache"), P.path("piece_bpe_32k.model")
    first = [prose(1, 20), prose(1, 20), prose(2, 20), None, ""]
    tokencount.count_tokens(docs(first), cache, path).collect()
    assert spark.read.parquet(cache).count() == 3
    rows = tokencount.count_tokens(docs(first + [prose(3, 20)] * 3), cache, path).collect()
    assert len(rows) == 8 and spark.read.parquet(cache).count() == 4
    # counts that are stored are used, not counted again; those of another version are not
    version = tokencount.tokenizer_version(path)
    spark.createDataFrame([(version, b"k" * 32, 7)], tokencount.CACHE).write.mode("append").parquet(cache)
    tokencount.append_misses(spark.createDataFrame([(b"k" * 32, "many words here")], "key binary, text string"), cache, path)
    assert spark.read.parquet(cache).where("n_tokens = 7").count() == 1 and spark.read.parquet(cache).count() == 5
    spark.createDataFrame([("other", b"j" * 32, 9)], tokencount.CACHE).write.mode("append").parquet(cache)
    tokencount.append_misses(spark.createDataFrame([(b"j" * 32, "x")], "key binary, text string"), cache, path)
    assert spark.read.parquet(cache).where(f"tokenizer = '{version}'").count() == 6


def test_empty(docs, tmp_path):
    assert tokencount.count_tokens(docs([]), str(tmp_path / "c"), P.path("piece_bpe_32k.model")).count() == 0
