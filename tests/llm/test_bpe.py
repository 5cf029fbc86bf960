import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from lightbox.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_are_the_librarys(library, odd):
    r = random.Random(3)
    alphabet = "abAB  \t\n'strve01.,é漢\x1c\x1d\x85  🙂\x00<|endoftext|>"
    texts = [t or "" for t in odd] + ["a" * 5001, "ab" * 3000, " " * 1000, "'s 're"]
    texts += ["".join(r.choice(alphabet) for _ in range(r.randint(0, 80))) for _ in range(4000)]
    texts += ["".join(chr(r.choice([r.randint(0, 0x2FFF), r.randint(0x10000, 0x1FFFF)])) for _ in range(60)) for _ in range(500)]
    coder = bpe.MergeReplay(PATH, P.PATTERN)
    for k in range(0, len(texts), 700):  # several chunks share what was learnt
        part = texts[k : k + 700]
        ids, counts = coder.encode(part)
        ends = np.cumsum([0, *counts])
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)] == [library.encode_ordinary(t) for t in part]
        assert [bytes(x) for x in coder.decode(ids, counts)] == [t.encode() for t in part]


def test_forgetting_changes_nothing(monkeypatch, library, prose):
    monkeypatch.setattr(bpe, "KEPT_WORDS", 20)
    coder = bpe.MergeReplay(PATH, P.PATTERN)
    for k in range(5):
        ids, _ = coder.encode([prose(k, 50)])
        assert ids.tolist() == library.encode_ordinary(prose(k, 50))


def test_documents(docs, odd, library):
    df = docs(odd).drop("kept")
    rows = {r["doc_id"]: r for r in bpe.encode_documents(df, PATH, P.PATTERN).collect()}
    for i, t in enumerate(odd):
        ids = library.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() and rows[i]["size"] == "extra"
    assert bpe.encode_documents(docs([]), PATH, P.PATTERN).count() == 0


def test_round_trip(docs, odd):
    df = docs(odd).select("doc_id", "text")
    ids = bpe.encode_documents(df, PATH, P.PATTERN, digests=False)
    back = {r["doc_id"]: r["text"] for r in bpe.decode_documents(ids.select("doc_id", "ids"), PATH, P.PATTERN).collect()}
    assert back == {i: t or "" for i, t in enumerate(odd)}


def test_clashing_columns(docs):
    df = docs(["a b", None])
    for name in ("n_tokens", "IDS", "ids_sha256", "decoded_sha256", "odd_0", "a.b"):
        df = df.withColumn(name, df["doc_id"] + 70)
    out = bpe.encode_documents(df, PATH, P.PATTERN)
    assert out.columns == ["doc_id", "lang", "source", "n_chars", "size", "kept", "IDS", "odd_0", "a.b", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r["IDS"], r["a.b"], r["n_tokens"]) for r in out.collect()) == [(70, 70, 2), (71, 71, 0)]
    ids = bpe.encode_documents(df, PATH, P.PATTERN, digests=False)
    assert "IDS" not in ids.columns and [r["text"] for r in bpe.decode_documents(ids, PATH, P.PATTERN).orderBy("doc_id").collect()] == ["a b", ""]
