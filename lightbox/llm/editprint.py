"""Document fingerprints from a randomised edit embedding.

A text is cut into segments of ``SEGMENT`` characters. In each, a walk reads the character
at its place and moves on by 0 or 1 as a random bit says that is shared by all texts and
depends on step and character only; where two texts differ by few edits, their walks meet
again soon, so edit distance becomes Hamming distance of the characters read. Each character
read adds a shared random sign to one of ``BITS`` sums, whatever the length of the text; the
sums' signs are the fingerprint, and the share of equal bits estimates how much of the two
walks agrees. A short text is walked several times, with other bits, to fill all sums. All
segments of a chunk of documents walk in step, as arrays.

Near copies are found by sampled bits: equal fingerprints are one item; a route samples some bits, which deal all items to groups, and
within a group inner bands sample more of them, so that one shuffled copy of an item serves many bands. Items with all sampled bits
equal are verified by all their bits, leaders first. The numbers of bits grow with the number of items (groups stay as
large) and the numbers of bands follow from them, so that two items at the threshold meet with probability ``RECALL``, and
nearer ones with more. Links join items to groups of near copies.

Defined results: null and empty texts have the fingerprint of no steps (all bits 0), which is
like itself only; equal texts have equal fingerprints; documents are ordered by doc_id, null
last, then a hash of the text, then the text, and the next of the last is the first; a single document is its own next;
an empty table gives an empty result; other columns than doc_id and text are not read by ``with_neighbours``, and
pass through ``fingerprint_documents`` and ``near_copies`` but for those with their results' names, which are left out.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .common import lean, named, other_names, plain, written

SEGMENT, BITS = 1024, 256
#: A text of one segment is walked until about this many steps; walks have STRETCH steps a character.
STEPS, STRETCH = 2048, 3
WIDTH = 4096
#: Ranges of doc_id at most: the driver holds a number and a place of each.
MOST_BUCKETS = 1 << 14
#: Fingerprints in a group about and at most, bits that deal them at least, and bits of an inner band.
GROUP, MOST_IN_GROUP, LEAST_ROUTE_BITS, INNER_BITS = 16_384, 131_072, 8, 12
#: Likeness of near copies, and the share of pairs at that threshold that all bands, or the inner ones, find.
NEAR, RECALL, INNER_RECALL = 0.9, 0.95, 0.97
#: Rows that are compared with all others of a band first, and rows of a tile of the comparison.
LEADERS, TILE = 16, 512
#: Rows of an inner band's key up to which all pairs of all such keys are compared at once; fingerprints in a task about, and tasks at most.
FEW, IN_TASK, MOST_TASKS = 16, 65_536, 16_384
#: Links that one task joins to groups; more take rounds over the cluster.
ONE_TASK = 200_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x + np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1024)
def _tables(walk: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """For each step of the walk and character class: how far it moves, and the sign it adds."""
    at = (np.uint64(walk) << np.uint64(40)) + (np.arange(steps, dtype=np.uint64)[:, None] << np.uint64(10)) + np.arange(256, dtype=np.uint64)[None, :]
    h = _mix(at)
    return (h & np.uint64(1)).astype(np.uint8), (((h >> np.uint64(1)) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int8)


def _walk(chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray, walk: int, sums: np.ndarray) -> None:
    """One walk over all segments, which come longest first; adds to ``sums`` (BITS, segments)."""
    if not len(lengths) or not lengths[0]:
        return
    steps = STRETCH * int(lengths[0])
    full = STRETCH * (SEGMENT if int(lengths[0]) > 64 else 64)
    moves, signs = _tables(walk, full)
    at, last = starts.astype(np.int64), starts + lengths
    # segments are only dropped from the end, when all of them there have come to theirs
    live = len(lengths)
    for j in range(steps):
        while STRETCH * lengths[live - 1] <= j:  # a walk has STRETCH steps a character, whatever its company
            live -= 1
        c = chars[at[:live]]
        inside = at[:live] < last[:live]
        sums[j % BITS, :live] += signs[j][c] * inside
        at[:live] += moves[j][c] & inside
        if j & 63 == 63:
            going = np.flatnonzero(at[:live] < last[:live])
            live = int(going[-1]) + 1 if len(going) else 0
            if not live:
                return


def fingerprints(texts: list[str]) -> list[bytes]:
    """The fingerprint of each text, BITS / 8 bytes."""
    if not texts:
        return []
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    chars = np.concatenate((((points * np.uint32(2654435761)) >> np.uint32(24)).astype(np.uint8), np.zeros(1, np.uint8)))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    offsets = np.cumsum(sizes) - sizes
    pieces = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = offsets[owner] + number * SEGMENT
    lengths = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
    order = np.argsort(-lengths, kind="stable")
    total = np.zeros((len(texts), BITS), dtype=np.int64)
    for a in range(0, len(order), WIDTH):
        some = order[a : a + WIDTH]
        sums = np.zeros((BITS, len(some)), dtype=np.int16)
        _walk(chars, starts[some], lengths[some], 0, sums)
        short = np.flatnonzero((pieces[owner[some]] == 1) & (lengths[some] * 2 < STEPS))
        wants = -(-STEPS // (2 * lengths[some][short]))
        for walk in range(1, int(wants.max(initial=0))):
            again = short[wants > walk]
            more = np.zeros((BITS, len(again)), dtype=np.int16)
            _walk(chars, starts[some][again], lengths[some][again], walk, more)
            # walks of few steps start at other sums each time
            sums[:, again] += np.roll(more, walk * 67, axis=0)
        # each segment number has its own order and signs of the sums, so that segments don't stand in for each other
        for s in np.unique(number[some]).tolist():
            mine = np.flatnonzero(number[some] == s)
            turn = int(_mix(np.array([s + 77], dtype=np.uint64))[0] % np.uint64(BITS)) if s else 0
            flip = (_mix(np.arange(BITS, dtype=np.uint64) + np.uint64(BITS * (s + 1))) & np.uint64(1)).astype(np.int64) * 2 - 1
            np.add.at(total, owner[some][mine], (np.roll(sums[:, mine], turn, axis=0).T * flip[None, :]))
    return [x.tobytes() for x in np.packbits(total > 0, axis=1)]


def likeness(a: bytes, b: bytes) -> float:
    """From the share of equal bits, the cosine of the angle it stands for; 1 if equal, 0 if unrelated."""
    if a == b:
        return 1.0
    if not any(a) or not any(b):
        return 0.0
    apart = (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_count() / (8 * len(a))
    return max(0.0, float(np.cos(np.pi * apart)))


def fingerprint_documents(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` without ``column``, with ``fingerprint`` (hex)."""
    others = other_names(docs, column, "fingerprint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in _sized(batch, "text"):
                made = pa.array([f.hex() for f in fingerprints(texts)], pa.string())
                yield pa.RecordBatch.from_arrays([*rows.columns[:-1], made], names=[*others, "fingerprint"])

    return plain(docs.select(*named(*others), F.col(column).alias("text"))).mapInArrow(lean(run), docs.select(*named(*others)).schema.add("fingerprint", "string"))


def _sized(batch: pa.RecordBatch, column: str):
    from .bpe import chunks

    return chunks(batch, column, 4_000_000)


# ---------------------------------------------------------------- a document, its edit and its neighbour


def _buckets(docs: DataFrame, per_bucket: int) -> tuple[DataFrame, DataFrame]:
    """(docs with ``bucket``, buckets in the order of doc_id, null last, then mark; the first doc_id and mark of each bucket that has rows).
    A doc_id that fills several quantiles, and null, is dealt to several buckets by mark."""
    n, n_known = docs.agg(F.count(F.lit(1)), F.count("doc_id")).first()
    n_buckets = min(MOST_BUCKETS, max(1, -(-n_known // per_bucket)))
    found = docs.approxQuantile("doc_id", [i / n_buckets for i in range(1, n_buckets)], 0.2 / n_buckets) if n_buckets > 1 else []
    times = Counter(int(c) for c in found)
    cuts = sorted({*times, *(c + 1 for c, k in times.items() if k > 1)})
    parts = [1, *(times[c] + 1 if times[c] > 1 else 1 for c in cuts), min(MOST_BUCKETS, max(1, -(-(n - n_known) // per_bucket)))]
    starts = np.cumsum([0, *parts]).tolist()
    number = F.lit(0)
    if cuts:  # binary search for the number of cuts at or below the doc_id
        jumps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
        table = F.array(*(F.lit(c).cast("long") for c in cuts))
        number = F.aggregate(
            F.array(*(F.lit(j) for j in jumps)), F.lit(0), lambda low, j: F.when(low + j <= len(cuts), F.when(F.element_at(table, F.least(low + j, F.lit(len(cuts)))) <= F.col("doc_id"), low + j).otherwise(low)).otherwise(low)
        )
    number = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(number).cast("int")
    of = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("range"))
    ranged = docs.withColumn("range", number)
    part = F.shiftright(F.shiftright("mark", 32) * of(parts), 31)
    bucketed = ranged.withColumn("bucket", (of(starts[:-1]) + part).cast("int")).drop("range")
    first = F.min(F.struct("doc_id", "mark"))
    return bucketed, bucketed.groupBy("bucket").agg(first.alias("first"))


def with_neighbours(docs: DataFrame, per_bucket: int = 4_000) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents are dealt to ranges of doc_id (of one doc_id or none: of a hash of the text); the first document of each range also goes, as a
    closing row, to the range before, so each range knows its last document's next one. Only the
    number of a range and its first place are gathered, one row for ``per_bucket`` documents and
    MOST_BUCKETS in all; ranges grow beyond that, which their sort spills."""
    mark = F.shiftrightunsigned(F.xxhash64(F.coalesce("text", F.lit(""))), 1)
    rows, firsts = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), mark.alias("mark")), per_bucket)
    heads = sorted((r["bucket"], r["first"]["doc_id"], r["first"]["mark"]) for r in firsts.collect())
    if not heads:
        return docs.sparkSession.createDataFrame([], NEIGHBOURS)
    closes = [(*h, heads[i - 1][0]) for i, h in enumerate(heads)]  # bucket, its first place, the bucket before (for the first, the last)
    head = docs.sparkSession.createDataFrame(closes, "bucket int, first_id long, first_mark long, closes int")
    own = F.struct(F.col("bucket"), F.lit(0).alias("closing"))
    before = F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("closing"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
    dealt = rows.join(F.broadcast(head), "bucket").select("doc_id", "text", "mark", F.explode(F.when(is_first, F.array(own, before)).otherwise(F.array(own))).alias("to"))
    in_order = dealt.select("to.bucket", "to.closing", "doc_id", "text", "mark").repartition("bucket")
    in_order = in_order.sortWithinPartitions("bucket", "closing", F.col("doc_id").asc_nulls_last(), "mark", "text").drop("mark")
    return in_order.mapInArrow(lean(_neighbours), NEIGHBOURS)


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    """The last quarter of ``text`` replaced by as many first characters of ``following``, or all it has."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in NEIGHBOURS.split(", ")]
    held: tuple[int, int | None, str, bytes] | None = None  # the document that waits for its next one
    closed = None

    def rows() -> Iterator[list[tuple[int, int, int | None, str]]]:
        some, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = tuple(c[i].as_py() for c in batch.columns)
                some.append(row)
                size += len(row[3])
                if size > 2_000_000:
                    yield some
                    some, size = [], 0
        if some:
            yield some

    def marked(texts: list[str]) -> list[bytes]:
        once = list(dict.fromkeys(texts))  # copies are walked once
        found = dict(zip(once, fingerprints(once), strict=True))
        return [found[t] for t in texts]

    for some in rows():
        prints = marked([r[3] for r in some])
        pairs = []
        for (bucket, closing, doc_id, text), mark in zip(some, prints, strict=True):
            if held is not None and held[0] == bucket:
                pairs.append((held[1], held[2], held[3], text, mark))
                held = None
            if closing:
                closed = bucket  # only the first closing row counts
            elif closed != bucket:
                held = (bucket, doc_id, text, mark)
        changed = [edited(t, nxt) for _, t, _, nxt, _ in pairs]
        edits = marked(changed)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p[0] for p in pairs], pa.int64()),
                pa.array([len(p[1]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed], pa.string()),
                pa.array([p[2].hex() for p in pairs], pa.string()),
                pa.array([e.hex() for e in edits], pa.string()),
                pa.array([likeness(p[2], e) for p, e in zip(pairs, edits, strict=True)], pa.float64()),
                pa.array([likeness(p[2], p[4]) for p in pairs], pa.float64()),
            ],
            names=names,
        )


# ---------------------------------------------------------------- near copies by sampled bands


def bits_apart(least: float) -> int:
    """The most bits that two fingerprints of likeness ``least`` or more are apart."""
    return max(d for d in range(BITS + 1) if max(0.0, float(np.cos(np.pi * d / BITS))) >= least)


def all_equal(n_bits: int, sampled: int, apart: int) -> float:
    """The probability that two marks of ``n_bits`` that are ``apart`` in some have the same in ``sampled`` random ones."""
    return float(np.prod([max(0, n_bits - apart - i) / (n_bits - i) for i in range(sampled)]))


def times_needed(p: float, recall: float) -> int:
    """How often something of probability p must be tried to come true at least once with probability ``recall``."""
    return 1 if p >= recall else int(np.ceil(np.log(1 - recall) / np.log(1 - p)))


@dataclass(frozen=True)
class Bands:
    """Which bits are sampled: of each route those that deal fingerprints to groups, and of each inner band those
    that must be equal too. Both are drawn without replacement from the same 256, so a route's bits aren't in its inner bands."""

    routes: tuple[tuple[int, ...], ...]
    inner: tuple[tuple[tuple[int, ...], ...], ...]

    @classmethod
    def of(cls, n: int, most: int, recall: float = RECALL) -> Bands:
        """For n fingerprints, of which those at most ``most`` bits apart are to be found with probability ``recall`` or more."""
        n_route = max(LEAST_ROUTE_BITS, int(np.ceil(np.log2(max(1, n) / GROUP))))
        n_inner = times_needed(all_equal(BITS - n_route, INNER_BITS, most), INNER_RECALL)
        n_routes = times_needed(all_equal(BITS, n_route, most) * INNER_RECALL, recall)
        rng = np.random.RandomState(BITS)
        orders = [rng.permutation(BITS) for _ in range(n_routes)]
        inner = tuple(tuple(tuple(rng.choice(o[n_route:], INNER_BITS, replace=False).tolist()) for _ in range(n_inner)) for o in orders)
        return cls(tuple(tuple(o[:n_route].tolist()) for o in orders), inner)


def keys_of(bits: np.ndarray, sampled: tuple[int, ...]) -> np.ndarray:
    """The sampled bits (columns of ``bits``) of each row as a number."""
    return bits[:, list(sampled)].astype(np.int64) @ (1 << np.arange(len(sampled), dtype=np.int64))


class _Sets:
    """Which rows are joined so far."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = int(self.parent[x])
        return x

    def join(self, a: int, b: int) -> bool:
        x, y = self.root(a), self.root(b)
        if x != y:
            self.parent[max(x, y)] = min(x, y)
        return x != y


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits apart of each row of ``a`` and each of ``b`` (rows of 64-bit words)."""
    out = np.zeros((len(a), len(b)), dtype=np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


def joined_near(words: np.ndarray, some: np.ndarray, most: int, sets: _Sets) -> list[tuple[int, int]]:
    """Joins the rows ``some`` of ``words`` that are at most ``most`` bits apart, and returns the pairs that did it. Leaders first: the first row
    with all near it, the first of the rest with all near that, and so on, which takes a family of near copies at linear cost; then what is
    in different sets still, in tiles. Rows in one set aren't compared again."""
    links = []
    rest = some
    for _ in range(LEADERS if len(some) > TILE else 0):
        if len(rest) < 2:
            break
        near = apart(words[rest[:1]], words[rest])[0] <= most
        links += [(int(rest[0]), int(x)) for x in rest[near][1:] if sets.join(int(rest[0]), int(x))]
        rest = rest[~near]
    roots = np.array([sets.root(int(x)) for x in some])
    order = np.argsort(roots, kind="stable")
    some, roots = some[order], roots[order]
    for i in range(0, len(some), TILE):
        for j in range(i, len(some), TILE):
            if roots[i] == roots[min(len(some), i + TILE) - 1] == roots[j] == roots[min(len(some), j + TILE) - 1]:
                continue
            near = (apart(words[some[i : i + TILE]], words[some[j : j + TILE]]) <= most) & (roots[i : i + TILE, None] != roots[None, j : j + TILE])
            links += [(int(some[i + x]), int(some[j + y])) for x, y in zip(*np.nonzero(near), strict=True) if sets.join(int(some[i + x]), int(some[j + y]))]
    return links


def group_links(words: np.ndarray, inner: tuple[tuple[int, ...], ...], most: int) -> list[tuple[int, int]]:
    """Links of a group's distinct fingerprints by its inner bands: a forest that joins all that are found to be near."""
    bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1)
    sets, links = _Sets(len(words)), []
    for sampled in inner:
        keys = keys_of(bits, sampled)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        sizes = np.diff(cuts)
        # most keys have a few rows: all their pairs at once, those of neighbours in order, then of those two places apart, and so on
        few = np.repeat(sizes <= FEW, sizes)
        for step in range(1, min(FEW, len(order))):
            at = np.flatnonzero((keys[step:] == keys[:-step]) & few[step:])
            if not len(at):
                break
            a, b = order[at], order[at + step]
            near = np.bitwise_count(words[a] ^ words[b]).sum(axis=1, dtype=np.int64) <= most
            links += [(int(x), int(y)) for x, y in zip(a[near], b[near], strict=True) if sets.join(int(x), int(y))]
        for k in np.flatnonzero(sizes > FEW).tolist():
            links += joined_near(words, order[cuts[k] : cuts[k + 1]], most, sets)
    return links


def links(marks: DataFrame, n: int, least: float) -> DataFrame:
    """(a, b): pairs of fingerprints of ``marks`` (fingerprint: binary, distinct, n of them) that are alike by ``least`` or more, enough of those that the
    bands find to join all of them. A route's key that more than MOST_IN_GROUP fingerprints have is dealt by its inner bands instead, a copy to each, and an inner key that
    still has more is dealt to parts of which each meets each, so what a band finds in a small group it finds in a large one."""
    most, bands, most_in_group = bits_apart(least), Bands.of(n, bits_apart(least)), MOST_IN_GROUP
    packs = "route int, band int, key long, inner long, n long, marks binary"
    names = [x.split()[0] for x in packs.split(", ")]

    def packed(out: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names=names)

    def dealt_by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(keys, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], keys[order[1:]] != keys[order[:-1]], [True])))
        return ((int(keys[order[a]]), order[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.frombuffer(b"".join(batch.column(0).to_pylist()), dtype=np.uint8).reshape(-1, BITS // 8)
            bits = np.unpackbits(rows, axis=1)
            for r, sampled in enumerate(bands.routes):
                yield packed([(r, -1, key, 0, len(some), rows[some].tobytes()) for key, some in dealt_by(keys_of(bits, sampled))])

    def by_band(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, key, data in zip(*(batch.column(names.index(x)).to_pylist() for x in ("route", "key", "marks")), strict=True):
                rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, BITS // 8)
                bits = np.unpackbits(rows, axis=1)
                yield packed([(r, k, key, inner, len(some), rows[some].tobytes()) for k, sampled in enumerate(bands.inner[r]) for inner, some in dealt_by(keys_of(bits, sampled))])

    group = ["route", "band", "key", "inner"]

    def hot(of: DataFrame) -> DataFrame:
        """Groups of more than MOST_IN_GROUP, with the parts they need."""
        sizes = of.groupBy(*group).agg(F.sum("n").alias("size")).where(F.col("size") > most_in_group)
        return written(sizes.select(*group, F.ceil(2 * F.col("size") / most_in_group).cast("int").alias("parts")), "editprint-hot")

    def parted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each part's rows for its meetings with all parts of the group."""
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            out = []
            for r, k, key, inner, data, parts in zip(*columns, strict=True):
                rows = np.frombuffer(data, dtype=np.uint64).reshape(-1, BITS // 64)
                of = (_mix(rows[:, 0] ^ _mix(rows[:, 1])) % np.uint64(parts)).astype(np.int64)
                for p, some in dealt_by(of):
                    out += [(r, k, key, inner, min(p, q) * parts + max(p, q), rows[some].tobytes()) for q in range(parts)]
            yield packed(out)

    def compare(table: pa.Table) -> pa.Table:
        words = np.frombuffer(b"".join(table.column("marks").to_pylist()), dtype=np.uint64).reshape(-1, BITS // 64)
        words = words[np.lexsort(words.T)]
        r, band = table.column("route")[0].as_py(), table.column("band")[0].as_py()
        found = group_links(words, bands.inner[r], most) if band < 0 else joined_near(words, np.arange(len(words)), most, _Sets(len(words)))
        return pa.table([pa.array([words[x[k]].tobytes() for x in found], pa.binary()) for k in (0, 1)], names=["a", "b"])

    def compared(of: DataFrame, tasks: int, *more: str) -> DataFrame:
        return of.repartition(tasks, *group, *more).groupBy(*group, *more).applyInArrow(compare, "a binary, b binary")

    dealt = marks.select("fingerprint").mapInArrow(lean(route), packs)
    n_tasks = max(1, min(MOST_TASKS, n * len(bands.routes) // IN_TASK))
    large = hot(dealt)  # at most n * routes / MOST_IN_GROUP rows
    if not large.limit(1).count():
        return compared(dealt, n_tasks)
    inner = written(dealt.join(large.drop("parts"), group, "left_semi").select(*names).mapInArrow(lean(by_band), packs), "editprint-inner")
    larger = hot(inner)
    met = inner.join(larger, group).select(*group, "marks", "parts").mapInArrow(lean(parted), packs)
    small = dealt.join(large, group, "left_anti")
    return compared(small, n_tasks).unionByName(compared(inner.join(larger, group, "left_anti"), n_tasks)).unionByName(compared(met, n_tasks, "n")).distinct()


def leaders(prints: DataFrame, least: float = NEAR) -> DataFrame:
    """(fingerprint, leader_id, likeness) of each distinct fingerprint of ``prints``: the smallest doc_id, null last, of its group of near
    copies, and the likeness with that row's fingerprint. Groups are joined by links of ``least`` or more."""
    own = prints.groupBy(F.unhex("fingerprint").alias("fingerprint")).agg(F.min("doc_id").alias("doc_id")).withColumn("node", F.monotonically_increasing_id())
    own = written(own, "editprint-marks")  # numbers stay as they are written
    filled = own.where(F.col("fingerprint") != F.lit(bytes(BITS // 8)))  # the empty one is like itself only
    pairs = written(links(filled, filled.count(), least), "editprint-links")
    ends = own.join(pairs.select(F.col("a").alias("fingerprint")).union(pairs.select("b")).distinct(), "fingerprint").select("fingerprint", "node")
    ends = written(ends, "editprint-ends")
    numbered = pairs.join(ends.toDF("a", "node_a"), "a").join(ends.toDF("b", "node_b"), "b")
    roots = connected_components(numbered.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")), small=ONE_TASK)
    near = written(own.join(roots, "node").select("fingerprint", "doc_id", "root"), "editprint-near")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fingerprint")).alias("best")
    led = near.join(near.groupBy("root").agg(best), "root").select("fingerprint", F.col("best.doc_id").alias("leader_id"), F.col("best.fingerprint").alias("leader"))
    rest = own.join(roots, "node", "left_anti").select("fingerprint", F.col("doc_id").alias("leader_id"), F.col("fingerprint").alias("leader"))

    def alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, lead = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([x.hex() for x in mark], pa.string()), batch.column(1), pa.array([likeness(x, y) for x, y in zip(mark, lead, strict=True)], pa.float64())], names=["fingerprint", "leader_id", "likeness"])

    return led.unionByName(rest).mapInArrow(lean(alike), "fingerprint string, leader_id long, likeness double")


def near_copies(prints: DataFrame, least: float = NEAR) -> DataFrame:
    """Every row of ``prints`` (with doc_id and fingerprint) with ``leader_id`` and ``likeness`` of
    its ``leaders``; columns of these names are left out. A row that leads itself has its own doc_id and likeness 1."""
    found = written(leaders(prints, least), "editprint-leaders")
    others = other_names(prints, "leader_id", "likeness")
    return prints.select(*named(*others)).join(found, "fingerprint").select(*named(*others), "leader_id", "likeness")
