"""Byte-level BPE by corpus-level merge replay, and decoding.

A task reads its documents in chunks of bounded size. The distinct pre-tokens of a chunk
that the task hasn't met are laid out one after another, and all merges are replayed over
the whole layout: an inverted index holds, for each merge rank, the positions where its pair
stands; ranks are taken in order, every position of a rank is merged at once (overlaps:
leftmost first), and only the pairs with the left and right neighbours are looked up again
and entered in the index. Pairs are those of adjacent tokens whose joined bytes are a token,
so the ids are those of the tiktoken library. A document's ids are then gathered from its
pre-tokens' ids.

Defined results: a null text is an empty one (no ids); rows are encoded one by one, so nulls,
ties and repeated rows in other columns change nothing; very long texts are one chunk each; an empty table gives an
empty result; other columns pass through, but for those with the results' names, which are left out.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import lean, named, other_names, plain

#: Pre-tokens that a worker keeps with their ids before it starts anew, and characters in a chunk.
KEPT_WORDS = 150_000
CHUNK_CHARS = 1_000_000
#: Unicode's White_Space as in the tiktoken library; ``\s`` of Python's regex module has four characters more.
WHITE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
NONE = np.int64(1 << 40)
EDGE = (1 << 17) - 1


class _Index(dict):
    """Numbers for strings in order of first use; ``new`` collects those just numbered."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        number = self[word] = len(self)
        return number


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the runs ``starts[i] : starts[i] + lengths[i]`` one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total < 1 << 31 and (not len(starts) or int(starts.max()) + total < 1 << 31) else np.int64
    out = np.arange(total, dtype=kind)
    out += np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    return out


class MergeReplay:
    """Encoder and decoder for one file of ranks."""

    def __init__(self, path: str, pattern: str):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.find = regex.compile(pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 17 | right] = rank
        self.pair_keys = np.array(sorted(pairs), dtype=np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], dtype=np.int64)
        size = max(ranks.values()) + 1
        token_bytes = [b""] * size
        for token, rank in ranks.items():
            token_bytes[rank] = token
        self.token_len = np.array([len(t) for t in token_bytes], dtype=np.int64)
        self.token_at = np.cumsum(self.token_len) - self.token_len
        self.token_bytes = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index = _Index()
        self.ids = np.zeros(0, dtype=np.int32)
        self.at = np.zeros(0, dtype=np.int64)
        self.len = np.zeros(0, dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 17 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], NONE)

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words one after another, and the number of ids of each word."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        n = int(lengths.sum()) + len(words) + 1
        token = np.full(n, EDGE, dtype=np.int64)  # an edge before each word and after the last
        starts = np.cumsum(lengths + 1) - lengths
        token[gather(starts, lengths)] = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = token != EDGE
        rank = np.full(n, NONE)
        rank[:-1] = self.rank_of(token[:-1], token[1:])
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def enter(at: np.ndarray) -> None:
            ranks = rank[at]
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            for r, some in zip(ranks[np.concatenate(([0], cuts))].tolist(), np.split(at, cuts), strict=True):
                if r in waiting:
                    waiting[r].append(some)
                else:
                    waiting[r] = [some]
                    heapq.heappush(queue, r)

        if len(first := np.flatnonzero(rank != NONE)):
            enter(first)
        while queue:
            r = heapq.heappop(queue)
            some = waiting.pop(r)
            at = np.sort(some[0] if len(some) == 1 else np.concatenate(some))
            at = at[rank[at] == r]
            if len(at) > 1:
                at = at[np.concatenate(([True], at[1:] != at[:-1]))]
                meets = after[at[:-1]] == at[1:]
                if meets.any():  # of a run of overlapping pairs every second one is merged
                    head = np.concatenate(([True], ~meets))
                    place = np.arange(len(at))
                    at = at[(place - np.maximum.accumulate(np.where(head, place, 0))) % 2 == 0]
            if not len(at):
                continue
            right = after[at]
            beyond = after[right]
            token[at], after[at], before[beyond] = r, beyond, at
            alive[right], rank[right] = False, NONE
            left = before[at]
            rank[left], rank[at] = self.rank_of(token[left], token[at]), self.rank_of(token[at], token[beyond])
            touched = np.concatenate((left, at))
            if len(touched := touched[rank[touched] != NONE]):
                enter(touched)
        counts = np.add.reduceat(alive, starts) if len(words) else np.zeros(0, dtype=np.int64)
        return token[alive].astype(np.int32), np.where(lengths > 0, counts, 0)

    def learn(self) -> None:
        """Ids for the pre-tokens just numbered: whole tokens as they are, others by replay."""
        words = [w.encode() for w in self.index.new]
        self.index.new = []
        if not words:
            return
        whole = np.array([self.ranks.get(w, -1) for w in words], dtype=np.int64)
        rest = np.flatnonzero(whole < 0)
        ids, counts = self.replay([words[i] for i in rest.tolist()])
        lengths = np.ones(len(words), dtype=np.int64)
        lengths[rest] = counts
        at = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), dtype=np.int32)
        flat[at[whole >= 0]] = whole[whole >= 0]
        flat[gather(at[rest], counts)] = ids
        self.at = np.concatenate((self.at, at + len(self.ids)))
        self.len = np.concatenate((self.len, lengths))
        self.ids = np.concatenate((self.ids, flat))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and each text's number of ids."""
        if len(self.index) > KEPT_WORDS:
            self.forget()
        number = self.index.__getitem__
        words = []
        for text in texts:
            found = self.find(text)
            words.append(np.fromiter(map(number, found), dtype=np.int32, count=len(found)))
        self.learn()
        each = np.concatenate(words) if words else np.zeros(0, dtype=np.int32)
        lengths = self.len[each]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        bounds = np.cumsum([0] + [len(w) for w in words])
        return self.ids[gather(self.at[each], lengths)], np.diff(ends[bounds])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """The bytes of each text."""
        lengths = self.token_len[ids]
        data = memoryview(self.token_bytes[gather(self.token_at[ids], lengths)].tobytes())
        ends = np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts)))].tolist()
        return [data[a:b] for a, b in zip(ends, ends[1:], strict=False)]


@lru_cache(maxsize=4)
def replayer(path: str, pattern: str) -> MergeReplay:
    """A worker's own, kept from task to task."""
    return MergeReplay(path, pattern)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), about ``limit`` characters or one row each."""
    texts = batch.column(batch.schema.get_field_index(column))
    start, size, held = 0, 0, []
    for i, value in enumerate(texts):
        text = value.as_py() or ""
        if held and size + len(text) > limit:
            yield batch.slice(start, i - start), held
            start, size, held = i, 0, []
        held.append(text)
        size += len(text)
    if held:
        yield batch.slice(start), held


def encode_documents(docs: DataFrame, path: str, pattern: str, digests: bool = True) -> DataFrame:
    """The columns of ``docs`` other than text, with n_tokens, and with ``digests`` ids_sha256 and
    decoded_sha256, else ids (an array of ints); columns of ``docs`` with these names are left out. ``path`` must be readable on the executors."""
    made_here = ["n_tokens", *(["ids_sha256", "decoded_sha256"] if digests else ["ids"])]
    others = other_names(docs, "text", *made_here)
    schema = docs.select(*named(*others)).schema.add("n_tokens", "long")
    schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string") if digests else schema.add("ids", ArrayType(IntegerType()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        coder = replayer(path, pattern)
        for batch in batches:
            for rows, texts in chunks(batch):
                ids, counts = coder.encode(texts)
                keep = rows.columns[:-1]
                made = [pa.array(counts, pa.int64())]
                if digests:
                    raw = memoryview(ids.astype("<u4").tobytes())
                    ends = np.concatenate(([0], np.cumsum(counts) * 4)).tolist()
                    made.append(pa.array([sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:], strict=False)], pa.string()))
                    made.append(pa.array([sha256(x).hexdigest() for x in coder.decode(ids, counts)], pa.string()))
                else:
                    made.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(keep + made, names=others + schema.names[len(others) :])

    return plain(docs.select(*named(*others), "text")).mapInArrow(lean(run), schema)


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """Replaces ``ids`` by ``text``; another column text is left out. Ids that don't make valid UTF-8 give U+FFFD there; null ids a null text."""
    others = other_names(encoded, "ids", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = replayer(path, pattern)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1).to_pylist()
            texts = [None if x is None else bytes(coder.decode(np.array(x, dtype=np.int64), np.array([len(x)]))[0]).decode(errors="replace") for x in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*others, "text"])

    return plain(encoded.select(*named(*others), "ids")).mapInArrow(lean(run), encoded.select(*named(*others)).schema.add("text", "string"))
