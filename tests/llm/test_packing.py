import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from lightbox.llm import packing

PATH, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return packing.encoder(PATH, RANKS, public_tokenizers.PATTERN)


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\n\n  b c", "a \xa0b", "a\xa0 b", "a \x85b", "\n", " \n ", "a \x1c b", "don't  we'll I'M", "x<|endoftext|>y <|endoftext|> z", "<|endoftext|>",
    "é漢字 ok 漢", "٣ ² ½ª", "🙂 🙂🙂  🙂", "tab\tand \t tab", "é combining ́", "ა Ა ꟑ", "a  b  c", "1234 567,89  #$%", "a b" * 500,
]


def test_ids_are_the_librarys(encoder, library, odd):
    texts = [*TEXTS, *(t for t in odd if t is not None)]
    r = random.Random(5)
    pool = [" ", "  ", "\n", " \n", "\t", "word", "Word's", ",", "12", "漢", "\xa0", "é", "…", "　", "<|endoftext|>", "²"]
    texts += ["".join(r.choice(pool) for _ in range(r.randrange(40))) for _ in range(400)]
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def checked(rows, texts_by_row, library, window):
    """Each id in one piece, gapless windows of ``window`` or a power of two."""
    want = {}
    for doc_id, text in texts_by_row:
        want.setdefault(doc_id, []).append([*library.encode(text or "", add_special_tokens=False).ids, packing.END])
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(want)
    for doc_id, lists in want.items():
        pieces = got[doc_id]
        assert sum(p["length"] for p in pieces) == sum(map(len, lists))
        if len(lists) == 1:
            ids, end = lists[0], 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == end and p["doc_tokens"] == len(ids) and p["length"] > 0
                assert p["ids_crc32"] == zlib.crc32(np.array(ids[end : end + p["length"]], "<u4").tobytes())
                end += p["length"]
            assert end == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    short = 0
    for spans in sequences.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end == window or (end < window and end & (end - 1) == 0)
        short += end != window
    return sequences, short


def test_every_id_lies_in_one_piece(spark, docs, odd, library):
    ids = [*range(100, 100 + len(odd) - 2), None, None]
    table = docs(odd, ids=ids)
    rows = packing.pieces(table, PATH, RANKS, public_tokenizers.PATTERN).collect()
    checked(rows, list(zip(ids, odd, strict=True)), library, 2048)
    assert rows == packing.pieces(table, PATH, RANKS, public_tokenizers.PATTERN).collect()


def test_small_windows_many_shards_and_ids(spark, docs, prose, library):
    texts = [prose(i, 5 + i * 7 % 300) for i in range(120)] + [prose(500, 40)] * 60 + [None, ""]
    rows = packing.pieces(docs(texts), PATH, RANKS, public_tokenizers.PATTERN, window=64, shard=5_000, with_ids=True).collect()
    sequences, short = checked(rows, list(enumerate(texts)), library, 64)
    shards = {s >> 32 for s in sequences if s < 1 << 62}
    assert len(shards) > 3 and short <= 6 * len(shards)
    assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] for r in rows)


def test_one_route_is_dealt_to_all_its_shards(spark, docs, prose):
    """One text in most rows: shards stay about as large."""
    rows = packing.pieces(docs([prose(1, 60)] * 600 + [prose(i, 60) for i in range(300)]), PATH, RANKS, public_tokenizers.PATTERN, shard=20_000).where("sequence_id < 4611686018427387904").collect()
    size = {}
    for r in rows:
        size[r["sequence_id"] >> 32] = size.get(r["sequence_id"] >> 32, 0) + r["length"]
    assert len(size) > 4 and max(size.values()) < 2 * sum(size.values()) / len(size)


def test_windows_hold_texts_with_words_in_common(spark, docs, library):
    r = random.Random(3)
    words = sorted(w[1:] for w in library.get_vocab() if w[:1] == "Ġ" and w[1:].isascii() and w[1:].isalpha() and len(w) > 6)
    r.shuffle(words)
    topics = [words[k * 30 : k * 30 + 30] for k in range(8)]
    texts, of = [], []
    for i in range(400):
        k = r.randrange(len(topics))
        of.append(k)
        texts.append(" ".join(r.choice(topics[k]) if r.random() < 0.4 else r.choice(["the", "of", "and", "in", "a", "to", "is"]) for _ in range(40)))
    rows = packing.pieces(docs(texts), PATH, RANKS, public_tokenizers.PATTERN).collect()
    windows = {}
    for p in rows:
        windows.setdefault(p["sequence_id"], []).append(of[p["doc_id"]])
    pairs = [(a, b) for w in windows.values() for a, b in zip(w, w[1:], strict=False)]
    assert sum(a == b for a, b in pairs) > 0.8 * len(pairs)


def test_scores_are_those_of_bm25():
    r = np.random.default_rng(2)
    counts = r.integers(0, 40, 50)
    ids, idf = r.integers(0, 30, counts.sum()), r.random(30) + 0.1
    index, at = packing.Index(ids, counts, idf, 17.0), packing.starts_of(counts)
    runs = [ids[a : a + n].tolist() for a, n in zip(at, counts, strict=True)]

    def weight(run, token):
        tf = run.count(token)
        return idf[token] * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(run) / 17.0)) if tf else 0.0

    for k, run in enumerate(runs):
        asked = sorted(set(run), key=lambda t: (-weight(run, t), t))[: packing.LOOKED_UP]
        assert np.allclose(index.scores(k), [sum(weight(other, t) for t in asked) for other in runs])


def test_order_takes_each_once_and_best_first():
    ids = np.array([1, 2, 1, 2, 5, 6, 1, 3, 9])
    counts = np.array([2, 2, 2, 2, 1])
    index = packing.Index(ids, counts, np.ones(10), 2.0)
    assert list(packing.order_of(index, counts, 100)) == [0, 1, 3, 2, 4]
    empty = packing.Index(np.zeros(0, np.int64), np.zeros(0, np.int64), np.ones(3), 1.0)
    assert list(packing.order_of(empty, np.zeros(0, np.int64), 8)) == []


def test_empty_table(spark, docs):
    got = packing.pieces(docs(["x"]).where("doc_id < 0"), PATH, RANKS, public_tokenizers.PATTERN)
    assert got.count() == 0 and got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
