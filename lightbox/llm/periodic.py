"""Periodic runs in the words of each text, by divide and conquer after Main and Lorentz.

Words are numbered within their text. A stretch of words is halved again and again; the Z-function of the right half gives
the squares that start at its first word, that of the left half read backwards those that end at its last, and each such period is extended over the
middle. Periods that repeat a smaller one are passed over, so a middle has few. A repetition is kept by the smallest
stretch that holds it whole, once, with its smallest period.

Only words from which the next equal word is near can lie in a run: in a run of period q each word but the last q has its next equal one
at most q words on. Stretches too short for that at every power of two of q hold no run and are left out, which costs nothing of the result.

Defined results: null and empty texts, and texts of white space, have no words, no runs and an empty collapsed text; rows are
looked at one by one, so repeated rows, ties and null ids change nothing; a long text takes n log n steps; an empty table gives an empty result; other columns pass through,
but for those with the results' names, which are left out.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .bpe import _Index, chunks
from .common import SPACE, lean, let, named, other_names, plain

#: Repetitions of the period in a run, and words in it, at least.
REPEATS, LEAST = 4, 6


def z_function(s: list[int]) -> list[int]:
    """For each place how many elements from there on equal the first ones; for place 0 all."""
    n = len(s)
    z = [0] * n
    if not n:
        return z
    z[0] = n
    head, left, right = s[0], 0, 0
    for i in range(1, n):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        elif s[i] != head:
            continue
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i], left, right = k, i, i + k
    return z


def _squares(half: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(period, how far it holds) of squares at the start of ``half`` that repeat no smaller period."""
    n = min(len(half) // 2, most)
    if not n or half[0] not in half[1 : n + 1]:
        return
    z = z_function(half)
    held: list[tuple[int, int]] = []
    for p in range(1, n + 1):
        if z[p] >= p and not any(p % q == 0 and q + z[q] >= 2 * p for q, _ in held):
            held.append((p, p + z[p]))
    yield from held


def _crossing(w: list[int], low: int, middle: int, high: int, repeats: int, least: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions over ``middle`` within ``low`` to ``high`` that can't be extended there."""
    most = (high - low) // repeats
    for p, held in _squares(w[middle:high], most):
        start, end = middle, middle + held
        while start > low and w[start - 1] == w[start - 1 + p]:
            start -= 1
        if start < middle and end - start >= max(least, repeats * p):
            yield start, end, p
    back = w[low:middle]
    back.reverse()
    for p, held in _squares(back, most):
        start, end = middle - held, middle
        while end < high and w[end] == w[end - p]:
            end += 1
        if end > middle and end - start >= max(least, repeats * p):
            yield start, end, p
    # runs that end or start at the middle are found by the halves


def stretches(numbers: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int]]:
    """Stretches of words that hold all runs, in order and apart."""
    n = len(numbers)
    order = np.argsort(numbers, kind="stable")
    ahead = np.full(n, n, dtype=np.int64)  # words to the next equal one
    same = numbers[order[1:]] == numbers[order[:-1]]
    ahead[order[:-1][same]] = (order[1:] - order[:-1])[same]
    steps = np.zeros(n + 1, dtype=np.int64)
    far = 1
    while far <= max(1, 2 * (n // repeats)):  # periods over far / 2 up to far
        near = np.concatenate(([False], ahead <= far, [False]))
        edges = np.flatnonzero(near[1:] != near[:-1])
        start, end = edges[::2], edges[1::2]
        q = far // 2 + 1
        kept = end - start >= max(least - far, (repeats - 1) * q, 1)
        np.add.at(steps, start[kept], 1)
        np.add.at(steps, np.minimum(end[kept] + far, n), -1)
        far *= 2
    inside = np.concatenate(([False], np.cumsum(steps[:-1]) > 0, [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs(numbers: np.ndarray, repeats: int = REPEATS, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start, then period: stretches of at least ``repeats`` times their smallest
    period, and ``least`` elements, that no neighbour extends. ``repeats`` is 4 or more, ``least`` too."""
    if len(numbers) < least:
        return []
    w: list[int] | None = None
    found: dict[tuple[int, int], int] = {}
    for first, last in stretches(numbers, repeats, least):
        w = numbers.tolist() if w is None else w
        waiting = [(first, last)]
        while waiting:
            low, high = waiting.pop()
            if high - low < least:
                continue
            middle = (low + high) // 2
            for start, end, p in _crossing(w, low, middle, high, repeats, least):
                if (start > 0 and w[start - 1] == w[start - 1 + p]) or (end < len(w) and w[end] == w[end - p]):
                    continue  # goes on beyond this part: a larger one holds it whole
                found[start, end] = min(p, found.get((start, end), p))
            waiting += [(low, middle), (middle, high)]
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def kept_words(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay when of each run only the first period does."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, p in found:
        steps[start + p] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:-1]) == 0


def words_of(text: Column) -> Column:
    """The words of a text as an array; none of a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def planted(docs: DataFrame) -> DataFrame:
    """``docs`` in which about a tenth of the texts end in a repetition, by the CRC-32 of their doc_id: h. If h % 10 is 0, word i of n becomes
    word a + (i - a) % p from a = g % n on, with g = h // 10 and p = 1 + (n - a) // (3 + g % 8). Texts of a null doc_id stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def text(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = F.pmod(g, n)
        p = F.floor((n - a) / (F.pmod(g, F.lit(8)) + 3)).cast("long") + 1
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    return docs.withColumn("text", F.when(h % 10 == 0, let(words_of(F.col("text")), text)).otherwise(F.col("text")))


def find_runs(docs: DataFrame, repeats: int = REPEATS, least: int = LEAST) -> DataFrame:
    """The columns of ``docs`` other than text, with ``runs`` (an array of start, length, period) and ``collapsed`` (the text with one
    period of each run, its words joined by spaces)."""
    if repeats < 4 or least < 4:
        raise ValueError("repeats and least must be 4 or more")
    others = other_names(docs, "text", "runs", "collapsed")
    schema = docs.select(*named(*others)).schema.add("runs", ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("period", LongType()))).add("collapsed", "string")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
    names = [*others, "runs", "collapsed"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in chunks(batch):
                every, left = [], []
                for text in texts:
                    words = text.encode().split()  # of bytes: at ASCII white space only
                    index = _Index()
                    numbers = np.fromiter(map(index.__getitem__, words), dtype=np.int32, count=len(words))
                    found = runs(numbers, repeats, least) if len(index) < len(words) else []
                    every.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    if found:
                        stay = kept_words(len(words), found).tolist()
                        words = [w for w, s in zip(words, stay, strict=True) if s]
                    left.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(every, kind), pa.array(left, pa.string())], names=names)

    return plain(docs.select(*named(*others), "text")).mapInArrow(lean(run), schema)


def digests(found: DataFrame) -> DataFrame:
    """Of ``find_runs``: doc_id, n_runs, the run of the greatest length by period (ties: smallest start, then period) and digests."""

    def better(best: Column, r: Column) -> Column:
        more = best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"])  # runs come by start, then period
        return F.when(more, r).otherwise(best)

    best = F.aggregate("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"), better)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
