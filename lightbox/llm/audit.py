"""Interaction audit of filters: what each removes in every order of application, and what only it would remove.

Each text is checked once, in the task that reads it. Exact copies are found by routed fingerprints: texts go to
partitions by their xxhash, sorted by it, and each hash's chain holds full texts with the smallest doc_id, so equal hashes of unlike texts stay apart. A
task first folds its own rows: of a text it sends one entry, for its smallest doc_id, and marks larger ones at once; so
a text that a third of all rows hold sends an entry a task. There are as many partitions as the bytes of all texts need. Rows, as small facts by then, meet their labels in a join, and
``combineByKey`` adds up vectors of counts: for each set of failed filters the documents, the good and the toxic ones.
All orders follow from such a vector of 2 ** filters counts, without another look at the texts.

Defined results: a null text is an empty one and a null part an empty string; a null doc_id is larger than any other, so it's a copy of each equal text
that has an id, and not of another null one; rows of one doc_id and text aren't copies of each other; labels of a doc_id
that has several count as good or toxic if one of them says so, and a document without labels as neither; long texts are checked whole; an empty table gives an empty
result; other columns aren't read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby, permutations
from math import factorial
from operator import itemgetter

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import trim

#: Bytes of texts that a task folds before it sends them on, and that a partition of routed texts holds about.
FOLDED, ROUTED = 32_000_000, 64_000_000
UPPER, MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
COUNTS = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()


@dataclass(frozen=True)
class Text:
    """What checks look at: the text, its bytes in UTF-8 and its words."""

    text: str
    data: bytes
    words: list[bytes]


def few_words(t: Text) -> bool:
    return len(t.words) < 100


def repeated_words(t: Text) -> bool:
    return 100 * len(set(t.words)) < 80 * len(t.words)


def many_capitals(t: Text) -> bool:
    return 100 * (len(t.data) - len(t.data.translate(None, UPPER))) > 10 * len(t.text)


def has_marks(t: Text) -> bool:
    return len(t.data.translate(None, MARKS)) < len(t.data)


#: Filters by letter; the copies' filter comes after them, with the letter of its own.
CHECKS: dict[str, Callable[[Text], bool]] = {"A": few_words, "B": repeated_words, "C": many_capitals, "D": has_marks}
COPIES = "E"


def _order(doc_id: int | None) -> tuple[bool, int]:
    return doc_id is None, doc_id or 0


def _folded(rows: Iterable, checks: tuple[Callable[[Text], bool], ...], copy: int) -> Iterator[tuple]:
    """("fact", (doc_id, part, mask), rows) of rows that are copies within the task, and ("text", hash, text, doc_id, {(part, mask): rows}) of the smallest
    doc_id of each text."""
    held: dict[str, list] = {}
    facts: dict[tuple, int] = defaultdict(int)
    size = 0

    def sent() -> Iterator[tuple]:
        yield from (("text", xxhash.xxh3_64_intdigest(text.encode(errors="surrogatepass")), text, doc_id, dict(least)) for text, (_, doc_id, least) in held.items())
        yield from (("fact", key, n) for key, n in facts.items())
        held.clear()
        facts.clear()

    for doc_id, text, part in rows:
        text = text or ""
        found = held.get(text)
        if found is None:
            data = text.encode(errors="surrogatepass")
            whole = Text(text, data, data.split())
            found = held[text] = [sum(1 << k for k, check in enumerate(checks) if check(whole)), doc_id, defaultdict(int)]
            size += len(data) + 200
        mask, least, of_least = found
        if _order(doc_id) < _order(least):
            for (p, m), n in of_least.items():
                facts[least, p, m | copy] += n
            of_least.clear()
            found[1] = doc_id
        if _order(doc_id) > _order(found[1]):
            facts[doc_id, part or "", mask | copy] += 1
        else:
            of_least[part or "", mask] += 1
        if size + 200 * len(facts) > FOLDED:
            yield from sent()
            size = 0
    yield from sent()


def _chains(entries: Iterable[tuple], copy: int) -> Iterator[tuple]:
    """(doc_id, part, mask, rows) of entries that come sorted by hash; of a hash the chain of its texts is held."""
    for _, same in groupby(entries, key=itemgetter(0)):
        chain: dict[str, tuple] = {}
        for _, (text, doc_id, rows) in same:
            least = chain.get(text)
            if least is not None and _order(least[0]) == _order(doc_id):
                for key, n in rows.items():
                    least[1][key] = least[1].get(key, 0) + n
                continue
            if least is not None and _order(least[0]) < _order(doc_id):
                late = (doc_id, rows)
            else:
                late, chain[text] = least, (doc_id, rows)
            if late is not None:
                yield from ((late[0], part, mask | copy, n) for (part, mask), n in late[1].items())
        for doc_id, rows in chain.values():
            yield from ((doc_id, part, mask, n) for (part, mask), n in rows.items())


def masks(docs: DataFrame, part: str = "lang", checks: dict[str, Callable[[Text], bool]] | None = None, by_hash=None) -> DataFrame:
    """(doc_id, part, mask, n): how many rows of a doc_id and part fail just the filters of ``mask`` (a bit for each check in turn, then
    one for copies)."""
    run = tuple((CHECKS if checks is None else checks).values())
    copy = 1 << len(run)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(-(-size // ROUTED), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text"), F.col(f"`{part}`")).rdd

    def fold(rows: Iterable) -> Iterator[tuple]:
        for kind, *rest in _folded(map(tuple, rows), run, copy):
            if kind == "text":
                key, text, doc_id, of_least = rest
                yield (key if by_hash is None else by_hash(key)), (text, doc_id, of_least)
            else:  # nothing more is asked of it: any partition will do
                (doc_id, p, mask), times = rest
                yield -1 - (doc_id or 0) % n, (doc_id, p, mask, times)
        trim()

    def chained(entries: Iterable) -> Iterator[tuple]:
        for fact, some in groupby(entries, key=lambda e: e[0] < 0):
            yield from (e[1] for e in some) if fact else _chains(some, copy)
        trim()

    routed: RDD = rows.mapPartitions(fold).repartitionAndSortWithinPartitions(n, lambda key: key % n)
    return docs.sparkSession.createDataFrame(routed.mapPartitions(chained), "doc_id long, part string, mask int, n long", verifySchema=False)


def _orders(letters: str) -> list[tuple[str, int, int, int]]:
    """(order, step, mask of the step's filter, mask of those before it)."""
    bit = {f: 1 << k for k, f in enumerate(letters)}
    return [(order, step + 1, bit[f], sum(bit[b] for b in order[:step])) for order in map("".join, permutations(letters)) for step, f in enumerate(order)]


def report(part: str, counts: np.ndarray, letters: str) -> Iterator[tuple]:
    """A part's rows: one for each order and step. ``counts``: documents, good and toxic ones (rows) for each mask."""
    mask = np.arange(1 << len(letters))
    n, good, toxic = counts
    total = {1 << k: sum(int(n[m]) * factorial(len(letters)) // m.bit_count() for m in mask.tolist() if m >> k & 1) for k in range(len(letters))}
    for order, step, own, before in _orders(letters):
        fails, gone = mask & own != 0, mask & before != 0
        removed = fails & ~gone
        yield (
            part, order, step, int(n[~fails & ~gone].sum()), int(n[removed].sum()), int(n[fails & gone].sum()), int(n[own]),
            int(good[removed].sum()), int(toxic[removed].sum()), total[own],
        )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", checks: dict[str, Callable[[Text], bool]] | None = None) -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each value of ``part``, all
    orders of the filters and their steps. ``checks``: functions of a Text by letter, six at most; E stands for copies."""
    checks = CHECKS if checks is None else checks
    if COPIES in checks or any(len(c) != 1 for c in checks) or len(checks) > 6:
        raise ValueError(f"filters need one letter each, other than {COPIES}, and may be six at most")
    letters = "".join(checks) + COPIES
    size = 1 << len(letters)
    facts = masks(docs, part, checks).groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max((F.col(c) == 1).cast("int")).alias(c) for c in ("quality", "toxic")))
    counts = facts.join(told, "doc_id", "left").select("part", "mask", "n", F.coalesce("quality", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))

    def add(sums: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        sums[:, mask] += (n, n * good, n * toxic)
        return sums

    def started(row: tuple[int, int, int, int]) -> np.ndarray:
        return add(np.zeros((3, size), dtype=np.int64), row)

    by_part = counts.rdd.map(lambda r: (r["part"], (r["mask"], r["n"], r["good"], r["toxic"]))).combineByKey(started, add, np.add)
    rows = by_part.flatMap(lambda kv: report(kv[0], kv[1], letters))
    return docs.sparkSession.createDataFrame(rows, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
