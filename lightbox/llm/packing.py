"""Packing of documents into windows of a fixed number of tokens by lexical retrieval.

A document's ids, with an end id, fill windows of their own as far as they go; what is left of it, its tail, is packed
with others. Tails are routed by their documents' two weightiest tokens, so that tails with words in common lie in one of the
shards, which hold about ``SHARD`` tokens each, however often a token occurs. A shard is an inverted
index of BM25 weights, with document frequencies of the whole corpus. A seed's weightiest tokens are looked up in it; the
unused neighbours fill the seed's window, best first; the one that passes its end is cut there, and
the rest of it is the next seed. If nothing unused shares a token, the next unused tail in the shard's order follows. What is left
at a shard's end is cut into windows of powers of two, so no window needs padding.

Encoding is by the tokenizers library's file, where a text has common characters by a faster library with the same vocabulary; texts that have others are cut before
spaces that a word follows, where no pre-token reaches across, and only the pieces with such characters go through the first library.

Defined results: a null or empty text is the end id alone; rows are packed one by one, so repeated rows, ties and null ids
are rows like any other; a very long text gives as many windows as it fills; an empty table gives an empty result; other
columns than doc_id and text aren't read.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import chunks
from .common import lean, written

#: Tokens of a window, id after each document.
WINDOW, END = 2048, 1
#: Tokens and documents (each counts as so many tokens) in a shard about.
SHARD, DOCUMENT = 2_000_000, 100
#: BM25's two constants, tokens of a seed that are looked up, and neighbours taken from one look-up.
K1, B, LOOKED_UP, NEIGHBOURS = 1.2, 0.75, 12, 32
#: Characters whose classes all versions of Unicode agree on, and the string that the library takes for a special token.
COMMON = re.compile(r"[\x00-\x7f\xa1-\xa9\xab-\xb1\xb4-\xb8\xbb\xbf-ɏΑ-ΡΣ-ωА-я‐-‧€]*")
SPECIAL = "<|endoftext|>"
#: Where no pre-token reaches across: before a space that a word follows.
PIECES = re.compile(r"(?= \S)")


def is_common(text: str) -> bool:
    return COMMON.fullmatch(text) is not None and SPECIAL not in text


class Encoder:
    """Ids by a file of the tokenizers library. Common characters go through a library for the file of ranks with the same vocabulary, which
    is faster; pieces of a text with others go through the first."""

    def __init__(self, path: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import tiktoken
        from tokenizers import Tokenizer

        with open(ranks, "rb") as f:
            vocabulary = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.library = Tokenizer.from_file(path)
        self.common = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if is_common(text):
            ids = self.common(text)
        else:
            ids = []
            for common, pieces in groupby(PIECES.split(text), is_common):
                joined = "".join(pieces)
                ids += self.common(joined) if common else self.library.encode(joined, add_special_tokens=False).ids
        return array("I", ids).tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, ranks: str, pattern: str) -> Encoder:
    """A worker's own, kept from task to task."""
    return Encoder(path, ranks, pattern)


def starts_of(lengths: np.ndarray) -> np.ndarray:
    return np.cumsum(lengths) - lengths


def unbinary(column) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and each row's number of ids."""
    rows = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    _, offsets, data = rows.buffers()
    ends = np.frombuffer(offsets, np.int32)[rows.offset : rows.offset + len(rows) + 1] if len(rows) else np.zeros(1, np.int32)
    held = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(held.tobytes(), "<u4").astype(np.int64), np.diff(ends).astype(np.int64) // 4


def terms(ids: np.ndarray, counts: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, token, times) of the distinct tokens of each run, by run, then token."""
    small = len(counts) * vocabulary < 1 << 31  # sorts faster
    keys = np.repeat(np.arange(len(counts), dtype=np.int32 if small else np.int64), counts) * (np.int32 if small else np.int64)(vocabulary) + ids.astype(np.int32 if small else np.int64)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    found = keys[first].astype(np.int64)
    return found // vocabulary, found % vocabulary, np.diff(np.concatenate((first, [len(keys)])))


def routes(owner: np.ndarray, token: np.ndarray, times: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The two weightiest tokens of each of ``n`` runs; -1 if there is none. A byte-pair vocabulary is numbered by frequency, so a token's
    number stands for its rarity here: routing needs no table of frequencies."""
    weight = times / (times + K1) * np.log1p(token)
    starts = np.searchsorted(owner, np.arange(n))
    held = np.flatnonzero(np.diff(np.concatenate((starts, [len(owner)]))))

    def heaviest() -> np.ndarray:
        out = np.full(n, -1, np.int64)
        if len(owner):
            most = np.zeros(n)
            most[held] = np.maximum.reduceat(weight, starts[held])
            out[held] = np.maximum.reduceat(np.where((weight == most[owner]) & (weight > 0), token, -1), starts[held])
        return out

    first = heaviest()
    weight[token == first[owner]] = 0
    return first, heaviest()


def encoded_rows(docs: DataFrame, path: str, ranks: str, pattern: str, window: int, vocabulary: int) -> DataFrame:
    """A row for each document: row and first_window (numbers of its own), n (ids), ids, tail and the tail's routes; and rows with
    token and documents: how many of a task's documents have it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        end = END.to_bytes(4, "little")
        coder, row, full, frequency = encoder(path, ranks, pattern), base, base, np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for rows, texts in chunks(batch):
                found = [coder.encode(t) + end for t in texts]
                ids, counts = np.frombuffer(b"".join(found), dtype="<u4"), np.array([len(x) // 4 for x in found], dtype=np.int64)
                owner, token, times = terms(ids, counts, vocabulary)
                frequency += np.bincount(token, minlength=vocabulary)
                first, second = routes(owner, token, times, len(counts))
                left, windows = counts % window, starts_of(counts // window) + full
                n = len(texts)
                nothing = pa.nulls(n, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), *map(pa.array, (np.arange(row, row + n), windows, counts, left, first, second)), pa.array(found, pa.binary()), nothing, nothing], names=names
                )
                row, full = row + n, full + int((counts // window).sum())
        seen = np.flatnonzero(frequency)
        gap = [pa.nulls(len(seen), f.type) for f in pa.schema([("d", kind), *[(x, pa.int64()) for x in names[1:7]], ("ids", pa.binary())])]
        yield pa.RecordBatch.from_arrays([*gap, pa.array(seen), pa.array(frequency[seen])], names=names)

    from pyspark.sql.pandas.types import to_arrow_type

    doc_id = docs.schema["doc_id"].dataType
    kind = to_arrow_type(doc_id)
    names = ["doc_id", "row", "first_window", "n", "tail", "route", "route2", "ids", "token", "documents"]
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {doc_id.simpleString()}, row long, first_window long, n long, tail long, route long, route2 long, ids binary, token long, documents long")


class Index:
    """An inverted index of BM25 weights over runs of ids."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float):
        self.n = len(counts)
        owner, token, times = terms(ids, counts, len(idf))
        weight = idf[token] * times * (K1 + 1) / (times + K1 * (1 - B + B * counts[owner] / mean))
        order = np.argsort(token.astype(np.uint16) if len(idf) <= 1 << 16 else token, kind="stable")
        self.docs, self.weights = owner[order], weight[order]
        self.at = np.concatenate(([0], np.cumsum(np.bincount(token, minlength=len(idf)))))
        # each run's weightiest tokens
        order = np.argsort(owner - weight / (2 * weight.max(initial=1.0)), kind="stable")
        of = owner[order]
        place = np.arange(len(of)) - np.searchsorted(of, np.arange(self.n))[of]
        kept = place < LOOKED_UP
        self.asked, asked_of = token[order][kept], of[kept]
        self.asks = np.searchsorted(asked_of, np.arange(self.n + 1))

    def scores(self, run: int) -> np.ndarray:
        """Each run's sum of weights of the tokens that ``run`` asks for."""
        spans = [slice(self.at[t], self.at[t + 1]) for t in self.asked[self.asks[run] : self.asks[run + 1]]]
        if not spans:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.docs[s] for s in spans]), np.concatenate([self.weights[s] for s in spans]), minlength=self.n)


def order_of(index: Index, lengths: np.ndarray, window: int) -> Iterator[int]:
    """All runs in the order in which they fill windows."""
    free = np.ones(index.n, dtype=bool)
    filled, after, seed = 0, 0, -1
    while True:
        if seed < 0:
            while after < index.n and not free[after]:
                after += 1
            if after == index.n:
                return
            seed, free[after] = after, False
            filled = (filled + int(lengths[seed])) % window
            yield seed
        scores = index.scores(seed) * free
        best = np.argpartition(-scores, NEIGHBOURS)[:NEIGHBOURS] if index.n > NEIGHBOURS else np.arange(index.n)
        best = best[np.lexsort((best, -scores[best]))]
        best = best[scores[best] > 0]
        if not len(best):
            seed = -1
            continue
        for run in best.tolist():
            free[run] = False
            yield run
            filled += int(lengths[run])
            if filled >= window:  # the window is full: the last one, cut or not, is the next seed
                filled %= window
                seed = run
                break


def cut(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs laid one after another and cut into windows, the rest into powers of two: (run, start in it, length,
    window's number, offset in it) of each piece."""
    total = int(lengths.sum())
    edges = np.arange(0, total - total % window + 1, window).tolist()
    for bit in reversed(range((total % window).bit_length())):
        if total % window >> bit & 1:
            edges.append(edges[-1] + (1 << bit))
    edges = np.array(edges, dtype=np.int64)
    ends = np.cumsum(lengths)
    cuts = np.union1d(edges, np.concatenate(([0], ends)))
    start, length = cuts[:-1], np.diff(cuts)
    run = np.searchsorted(ends, start, side="right")
    number = np.searchsorted(edges, start, side="right") - 1
    return run, start - (ends[run] - lengths[run]), length, number, start - edges[number]


def pieces(docs: DataFrame, path: str, ranks: str, pattern: str, window: int = WINDOW, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece of each document, with ``with_ids`` also its
    ids (binary, little-endian unsigned 32-bit integers). ``path`` (tokenizers) and ``ranks`` must be readable on the executors."""
    import json

    with open(path) as f:
        found = json.load(f)
    vocabulary = 1 + max([END, *found["model"]["vocab"].values(), *(t["id"] for t in found["added_tokens"])])
    del found
    rows = written(encoded_rows(docs, path, ranks, pattern, window, vocabulary), "packing-rows")
    encoded = rows.where("n is not null")
    size = encoded.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("n"), F.lit(1.0)).alias("mean")).first()
    frequency = np.zeros(vocabulary)
    for token, n in rows.where("token is not null").groupBy("token").agg(F.sum("documents")).collect():  # a row a token of the vocabulary
        frequency[token] = n
    idf, mean = np.log1p((size["n"] - frequency + 0.5) / (frequency + 0.5)), float(size["mean"])
    # shards are stretches of the tails in the order of their routes; a route's tails lie in it by a hash, so each of its shards gets its share
    tails = encoded.where("tail > 0")
    mass = tails.groupBy("route").agg(F.sum(F.col("tail") + DOCUMENT).cast("double").alias("mass")).orderBy("route").collect()  # a row a token at most
    before = np.concatenate(([0.0], np.cumsum([r["mass"] for r in mass])))
    placed = docs.sparkSession.createDataFrame([(r["route"], float(b), r["mass"]) for r, b in zip(mass, before[:-1], strict=True)], "route long, before double, mass double")
    n_shards = int(max(1, -(-before[-1] // shard)))
    share = F.pmod(F.xxhash64("row"), F.lit(1 << 30)) / float(1 << 30)
    at = F.least(F.floor((F.col("before") + F.col("mass") * share) / (before[-1] / n_shards if before[-1] else 1.0)), F.lit(n_shards - 1))
    dealt = tails.join(F.broadcast(placed), "route").select(
        at.cast("long").alias("shard"), "route", "route2", "row", "doc_id", "n", F.expr("substring(ids, (n - tail) * 4 + 1)").alias("ids")
    )
    more = ", ids binary" if with_ids else ""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {doc_id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}"
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]

    def made(doc_ids, tokens: np.ndarray, data: np.ndarray, first: np.ndarray, start, length, sequence, offset) -> list:
        """``first``: places of the pieces' first ids in ``data``; ``start``: their places in their documents."""
        raw = memoryview(data.astype("<u4").tobytes())
        parts = [raw[a * 4 : (a + k) * 4] for a, k in zip(first.tolist(), length.tolist(), strict=True)]
        crcs = pa.array([zlib.crc32(p) for p in parts], pa.int64())
        return [doc_ids, pa.array(start, pa.int64()), pa.array(length, pa.int64()), crcs, pa.array(tokens, pa.int64()), pa.array(sequence, pa.int64()), pa.array(offset, pa.int64()), *([pa.array(map(bytes, parts), pa.binary())] if with_ids else [])]

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("route", "ascending"), ("route2", "ascending"), ("row", "ascending")])
        ids, counts = unbinary(table.column("ids"))
        tokens = table.column("n").to_numpy()
        order = np.fromiter(order_of(Index(ids, counts, idf, mean), counts, window), dtype=np.int64, count=len(counts))
        run, start, length, number, offset = cut(counts[order], window)
        doc = order[run]
        sequence = (table.column("shard").to_numpy()[0] << 32) + number
        out = made(table.column("doc_id").combine_chunks().take(pa.array(doc)), tokens[doc], ids, starts_of(counts)[doc] + start, tokens[doc] - counts[doc] + start, length, sequence, offset)
        return pa.table(out, names=names)

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, counts = unbinary(batch.column(3))
            windows = counts // window
            doc = np.repeat(np.arange(len(counts)), windows)
            number = np.arange(len(doc)) - np.repeat(starts_of(windows), windows)
            start = number * window
            sequence = (1 << 62) + batch.column(1).to_numpy()[doc] + number
            out = made(batch.column(0).take(pa.array(doc)), counts[doc], ids, starts_of(counts)[doc] + start, start, np.full(len(doc), window), sequence, np.zeros(len(doc), np.int64))
            yield pa.RecordBatch.from_arrays(out, names=names)

    long_ones = encoded.where(F.col("n") >= window).select("doc_id", "first_window", "n", "ids").mapInArrow(lean(whole), schema)
    return long_ones.unionByName(dealt.groupBy("shard").applyInArrow(pack, schema))
