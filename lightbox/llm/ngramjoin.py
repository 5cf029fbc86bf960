"""N-gram Jaccard join with signature trees.

Two documents link if the Jaccard similarity of their sets of five-word shingles is 0.8 or more.
No link is lost:

1. Equal sets are one item. All shingles have one global order, rare ones first by a counting
   sketch over all documents (the order decides speed only; any order is exact). Two linked
   sets share k shingles among the first n - ceil(0.8 n) + k of each, so items that share such a
   prefix shingle form groups, and an item that has fewer than k of them in common with others leaves
   (k grows with the size). Equal groups are kept once. Of a group with more than ``GROUP`` members,
   as counted, parts of that size stand in for it, and what parts don't see is left to step 3.
2. Each group becomes a signature tree: leaves are items, nodes hold the OR of their items'
   bitmaps, the range of their sizes and of what bitmaps miss (shingles that share a bit). The
   common bits of two nodes plus what the bitmap misses bound the overlap of any two of their
   items, and so does what their items have from the group's shingle on, in the order of all; a dual traversal drops pairs of nodes whose bound is below the least overlap that
   their sizes need.
3. First the largest groups of each item link their items to leaders only (stars, verified exactly), which joins
   large families of near copies at linear cost; some members of each part of a divided group form a group
   of their own that joins the parts; and large groups that are still apart are compared with
   a few more leaders. Then the trees are traversed again for pairs
   of items not yet in the same component; nodes that lie in one component are dropped. A divided group that is
   still apart is dealt to blocks: all items outside its largest component meet each other and that
   component's, whose own items needn't meet. The pairs that are left are verified exactly, and components follow.

All groups a task sees are bounded by ``GROUP`` at each side, and the entries of a bucket by ``BUCKET``
and a few groups, whatever a shingle's count: one that may have more entries is spread over buckets.
The sketch has about as many counters as the corpus has shingles, up to ``MOST_COUNTERS`` (a byte each when broadcast);
with more shingles, only those well above the average counter are seen as common, and groups grow.
Sets have 64-bit numbers; a second number of each shows if two sets got the same, and then all get others.

Defined results: a null or empty text has an empty set and links with nothing, its
component is itself; fewer than five words are one shingle; a null doc_id gets the
component of its text; equal rows get a row each; an empty table gives an empty result; other
columns than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import blake2b, md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from .bpe import chunks
from .common import lean, trim, written
from .shingles import mix, shingle_sets

#: Children of a tree node, items of a group, prefix entries in a bucket, memberships of a batch of groups.
FAN_OUT, GROUP, BUCKET, BATCH = 8, 20_000, 500_000, 20_000
#: Prefix shingles that linked sets of 64 or more have in common at least; smaller ones have one for each 8, large ones one for each LONG_SHARE.
MOST_SHARED, LONG_SHARE = 8, 40
#: A signature has a power of two of bits, at least twice the set's size, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 16
#: Counters of the sketch, and those summed together.
LEAST_COUNTERS, MOST_COUNTERS, SLICE = 1 << 16, 1 << 24, 1 << 15
#: The sketch holds this many steps for each doubling of a count.
STEPS = 8
#: Sets whose shingles are fetched by a broadcast of their numbers (8 bytes each); more are joined.
BROADCAST_IDS = 4_000_000
#: Bytes of the pairs to verify that are broadcast; more are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
CHUNK = 500_000
#: Groups of each set that take part in the first step.
STAR_GROUPS = 2
#: Sets of a large group that are compared with all others before its trees are traversed.
LEADERS = 16
#: Hubs in a block of the verification, and pairs of a hub in a task.
BLOCK, HUB = 500, 20_000
#: Links that one task joins to components (two numbers each); more take rounds over the cluster.
ONE_TASK = 200_000
#: Tasks that buckets are dealt to at most.
MOST_TASKS = 16_384
#: Places in a set's order that entries tell apart; later ones count as this, which bounds less.
MOST_PLACE = (1 << 16) - 1
#: Bits of a set's number.
ID_BITS = 64
U = np.uint64


def needed(sizes):
    """The least overlap of two linked sets from the sum of their sizes: i >= 4/9 (n + m)."""
    return (4 * sizes + 8) // 9


def shared(n: int) -> int:
    """How many shingles of its prefix a set of n shingles and a linked set of n or more have in common at least."""
    return max(1, min(MOST_SHARED, n // 8), n // LONG_SHARE)


def prefix_length(n: int) -> int:
    return n - (4 * n + 4) // 5 + shared(n) if n else 0


def width(n: int) -> int:
    """Bits of the signature of a set of n shingles: linked sets' differ by a factor of two at most."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * n - 1).bit_length()))


def signature(shingles: np.ndarray) -> np.ndarray:
    """A bitmap of a set as 64-bit words. A narrower one is the OR of the parts of a wider one."""
    n = width(len(shingles))
    bits = np.zeros(n, dtype=np.uint8)
    bits[(shingles >> U(20)) & U(n - 1)] = 1
    return np.packbits(bits).view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A bitmap at the width of ``words`` 64-bit words."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def numbers(shingles: np.ndarray, salt: int = 0, bits: int = 64) -> tuple[int, int]:
    """A set's number, and a second one that tells it from another set with the same number; 0 if it is empty."""
    if not len(shingles):
        return 0, 0
    digest = blake2b(shingles.tobytes(), digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return int.from_bytes(digest[:8], "little", signed=True) % (1 << (bits - 1)) or 1, int.from_bytes(digest[8:], "little", signed=True)


# ---------------------------------------------------------------- the order of shingles


def squeezed(counts: np.ndarray) -> bytes:
    """Counts in the narrowest unsigned numbers that hold them, compressed."""
    kind = np.min_scalar_type(int(counts.max(initial=0)))
    return bytes([kind.itemsize]) + zlib.compress(counts.astype(kind).tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), dtype=f"u{data[0]}").astype(np.int64)


def _sketch(docs: DataFrame) -> np.ndarray:
    """For each counter a byte that grows with the logarithm of how often its shingles occur, over all documents."""
    n_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    size = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << int(n_bytes // 6).bit_length()))
    piece = min(SLICE, size)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, dtype=np.uint32)
        for batch in batches:
            for _, texts in chunks(batch, limit=CHUNK):
                for found in shingle_sets(texts):
                    counts[found & U(size - 1)] += 1  # a set has a counter twice at times; the order is a heuristic
        for k in range(0, size, piece):
            part = counts[k : k + piece]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k // piece], pa.int32()), pa.array([squeezed(part)], pa.binary())], names=["slice", "counts"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum((unsqueezed(x) for x in pdf["counts"]), np.zeros(1, np.int64))
        return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "counts": [squeezed(total)]})

    schema = "slice int, counts binary"
    parts = docs.select("text").mapInArrow(lean(count), schema)
    n_tasks = docs.rdd.getNumPartitions()
    while n_tasks > 512:  # so that a sum reads the parts of some hundred tasks at most
        n_tasks = -(-n_tasks // 256)
        dealt = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(n_tasks)))
        parts = dealt.groupBy("slice", "part").applyInPandas(lambda pdf: add(pdf[["slice", "counts"]]), schema)
    sums = parts.groupBy("slice").applyInPandas(add, schema)
    out = np.zeros(size, dtype=np.uint8)
    for row in sums.toLocalIterator():
        out[row["slice"] * piece : (row["slice"] + 1) * piece] = np.ceil(STEPS * np.log2(1 + unsqueezed(bytes(row["counts"]))))
    return out


# ---------------------------------------------------------------- sets and groups


def _sets(docs: DataFrame, sketch, salt: int, digests: bool = False) -> DataFrame:
    """(doc_id, set_id, other, n, prefix) for each row, with ``digests`` the MD5 of its text too; ``sketch`` is a broadcast."""
    schema = docs.select("doc_id").schema.add("set_id", "long").add("other", "long").add("n", "integer").add("prefix", "binary")
    schema = schema.add("digest", "binary") if digests else schema
    id_bits = ID_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            for rows, texts in chunks(batch, limit=CHUNK):
                ids, sizes, prefixes = [], [], []
                for found in shingle_sets(texts):
                    n = len(found)
                    # by count, then hash: the found hashes are sorted, so a stable sort by count does
                    prefix = found[np.argsort(counts[found & U(len(counts) - 1)], kind="stable")[: prefix_length(n)]]
                    ids.append(numbers(found, salt, id_bits))
                    sizes.append(n)
                    prefixes.append(prefix.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([i for i, _ in ids], pa.int64()), pa.array([o for _, o in ids], pa.int64()), pa.array(sizes, pa.int32()), pa.array(prefixes, pa.binary())]
                    + [pa.array([md5(t.encode(), usedforsecurity=False).digest() for t in texts], pa.binary())] * digests,
                    names=["doc_id", "set_id", "other", "n", "prefix"] + ["digest"] * digests,
                )

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def _numbered_sets(docs: DataFrame, sketch, digests: bool) -> tuple[DataFrame, int]:
    """``_sets``, written, and the salt with which no two different sets have the same number."""
    for salt in range(64):
        sets = written(_sets(docs, sketch, salt, digests), "join-sets")
        twice = sets.groupBy("set_id").agg(F.min("other").alias("low"), F.max("other").alias("high")).where("low <> high")
        if not twice.limit(1).count():
            return sets, salt
    raise RuntimeError("sets of the same number with 64 salts")


def _groups(sets: DataFrame, sketch, n_entries: int) -> DataFrame:
    """(group_id, set_id, least, divided, tokens, place): the sets that share a prefix shingle, equal groups once with their number of
    shingles and the place of the first in each set's order. Sets of a shingle with more than GROUP of them, or that may have more than BUCKET, are ``divided`` rows with the shingle as group_id."""
    n_buckets = max(1, -(-n_entries // BUCKET))
    most, bucket_size = GROUP, BUCKET

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for batch in batches:
            seen = {}
            for i, p in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen[i] = p
            if not seen:
                continue
            each = [np.frombuffer(p.as_buffer(), dtype=np.uint64) for p in seen.values()]
            owners = np.repeat(np.array(list(seen), dtype=np.int64), [len(p) for p in each])
            tokens = np.concatenate(each)
            places = np.concatenate([np.minimum(np.arange(len(p)), MOST_PLACE) for p in each]).astype(np.uint16)
            bucket = (mix(tokens + U(7)) % U(n_buckets)).astype(np.int64)
            bound = np.exp2(counts[tokens & U(len(counts) - 1)] / STEPS)  # a counter never holds less than its shingles' counts
            if len(wide := np.flatnonzero(bound > bucket_size)):
                spread = mix(owners[wide].view(np.uint64)) % np.ceil(bound[wide] / bucket_size).astype(np.uint64)
                bucket[wide] = n_buckets + (mix(tokens[wide] + U(7) + mix(spread + U(1))) % U(n_buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            tokens, owners, places, bucket = tokens[order], owners[order], places[order], bucket[order]
            cuts = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
            spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)) if len(bucket) else []
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(bucket[a]) for a, _ in spans], pa.int32()), *(pa.array([x[a:b].tobytes() for a, b in spans], pa.binary()) for x in (tokens, owners, places))],
                names=["bucket", "tokens", "owners", "places"],
            )

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        tokens = np.concatenate([np.frombuffer(x, dtype=np.uint64) for x in pdf["tokens"]])
        owners = np.concatenate([np.frombuffer(x, dtype=np.int64) for x in pdf["owners"]])
        places = np.concatenate([np.frombuffer(x, dtype=np.uint16) for x in pdf["places"]]).astype(np.int32)
        order = np.lexsort((owners, tokens))
        tokens, owners, places = tokens[order], owners[order], places[order]
        new = np.concatenate(([True], (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])))
        tokens, owners, places = tokens[new], owners[new], places[new]
        cuts = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1], [True])))
        sizes = np.diff(cuts)
        large = sizes > most if pdf["bucket"].iloc[0] < n_buckets else np.ones(len(sizes), dtype=bool)
        lists, times, first = {}, {}, {}
        for k in np.flatnonzero((sizes > 1) & ~large).tolist():
            members = owners[cuts[k] : cuts[k + 1]]
            number = numbers(members.view(np.uint64))[0]
            lists.setdefault(number, members)
            times[number] = times.get(number, 0) + 1
            first[number] = np.minimum(first.get(number, MOST_PLACE), places[cuts[k] : cuts[k + 1]])
        lengths = [len(m) for m in lists.values()]
        divided = np.repeat(large, sizes)
        return pd.DataFrame({
            "group_id": np.concatenate((np.repeat(np.array(list(lists), dtype=np.int64), lengths), tokens[divided].view(np.int64))),
            "set_id": np.concatenate((*lists.values(), owners[divided])),
            "least": np.concatenate((np.repeat(np.array([m.min() for m in lists.values()], dtype=np.int64), lengths), tokens[divided].view(np.int64))),
            "divided": np.concatenate((np.zeros(sum(lengths), dtype=bool), np.ones(int(divided.sum()), dtype=bool))),
            "tokens": np.concatenate((np.repeat(np.array(list(times.values()), dtype=np.int64), lengths), np.ones(int(divided.sum()), dtype=np.int64))),
            "place": np.concatenate((*first.values(), places[divided])),
        })

    packed = sets.where("n > 0").select("set_id", "prefix").mapInArrow(lean(pack), "bucket int, tokens binary, owners binary, places binary")
    packed = packed.repartition(min(n_buckets, MOST_TASKS), "bucket")  # so that a task's buckets don't grow with the corpus
    groups = packed.groupBy("bucket").applyInPandas(gather, "group_id long, set_id long, least long, divided boolean, tokens long, place int")
    return groups.groupBy("group_id", "set_id", "least", "divided").agg(F.sum("tokens").alias("tokens"), F.min("place").alias("place"))


def _strong(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """``groups`` without the sets that have too few prefix shingles in common with others, and without groups that this leaves with one set."""
    n = sets.where("n > 0").groupBy(F.col("set_id").alias("of")).agg(F.first("n").alias("n"))
    common = groups.groupBy("set_id").agg(F.sum("tokens").alias("tokens")).join(n, F.col("set_id") == F.col("of"))
    smallest = F.ceil(F.col("n") * 4 / 5)  # the smallest set that links
    least = F.greatest(F.lit(1), F.least(F.lit(MOST_SHARED), F.floor(smallest / 8)), F.floor(smallest / LONG_SHARE))  # as shared() has it
    strong = written(groups.join(common.where(F.col("tokens") >= least).select("set_id"), "set_id", "left_semi").drop("tokens"), "join-strong")
    single = strong.where("not divided").groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where("size = 1").select("group_id", F.lit(False).alias("divided"))
    return strong.join(single, ["group_id", "divided"], "left_anti").select("group_id", "set_id", "least", "divided", "place")


def _parts(divided: DataFrame) -> DataFrame:
    """(group_id, set_id, least, place): parts of at most about GROUP members for the ``divided`` groups, and for each group some
    members of all its parts, level by level until they are one part."""
    out, level = None, divided.select("group_id", "set_id", "least", "place")
    for number in range(64):
        sizes = level.groupBy(F.col("group_id").alias("of")).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts"))
        dealt = level.join(sizes, level["group_id"] == sizes["of"]).withColumn("part", F.pmod(F.xxhash64(F.lit(number), "set_id"), "parts"))
        dealt = written(dealt.select(F.xxhash64(F.lit(number), "group_id", "part").alias("part_id"), "group_id", "set_id", "least", "place", "parts"), "join-parts")
        some = dealt.select(F.col("part_id").alias("group_id"), "set_id", "least", "place")
        out = some if out is None else out.unionByName(some)
        # of each part those with the least hashes go on, a share that leaves LEADERS of a whole part
        rest = dealt.where(F.col("parts") > 1).where(F.pmod(F.xxhash64(F.lit(number + 1000), "set_id"), F.lit(max(2, GROUP // LEADERS))) == 0)
        level = rest.select("group_id", "set_id", "least", "place")
        if not level.limit(1).count():
            return out
    return out


# ---------------------------------------------------------------- signature trees


class SignatureTree:
    """Levels of nodes over items, the items first: OR of bitmaps, size range, largest number of
    shingles that a bitmap misses, the component, or -1 where items of several meet, and the largest ``rest``: the shingles of an item from the group's own on, in
    the order of all shingles. Two items whose first shingle in common is the group's share no more than either's rest, and every linked pair has such a group."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, component: np.ndarray, rest: np.ndarray | None = None):
        missed = sizes - np.bitwise_count(bits).sum(axis=1)
        self.levels = [(bits, sizes, sizes, missed, component, sizes if rest is None else rest)]
        while len(self.levels[-1][1]) > FAN_OUT:
            bits, low, high, missed, component, rest = self.levels[-1]
            cuts = np.arange(0, len(low), FAN_OUT)
            same = np.minimum.reduceat(component, cuts) == np.maximum.reduceat(component, cuts)
            self.levels.append((
                np.bitwise_or.reduceat(bits, cuts, axis=0), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts),
                np.maximum.reduceat(missed, cuts), np.where(same & (component[cuts] >= 0), component[cuts], -1), np.maximum.reduceat(rest, cuts),
            ))

    def may_link(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        bits, low, high, missed, component, rest = self.levels[level]
        ok = (np.minimum(rest[a], rest[b]) >= needed(low[a] + low[b])) & (5 * high[a] >= 4 * low[b]) & (5 * high[b] >= 4 * low[a]) & ((component[a] != component[b]) | (component[a] < 0))
        at = np.flatnonzero(ok)
        rows = max(1, (1 << 20) // bits.shape[1])  # some megabytes of bitmaps at a time
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            x, y = a[some], b[some]
            most = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64) + np.minimum(missed[x], missed[y])
            ok[some] = np.minimum(most, np.minimum(high[x], high[y])) >= needed(low[x] + low[y])
        return ok

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of items (a < b) of different components that bounds don't exclude, in batches."""
        top = len(self.levels) - 1
        n = len(self.levels[top][1])
        waiting = [(top, *np.triu_indices(n))]
        while waiting:
            level, a, b = waiting.pop()
            if level == 0:
                a, b = a[a < b], b[a < b]
            keep = self.may_link(level, a, b)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            width = len(self.levels[level - 1][1])
            i, j = np.divmod(np.arange(FAN_OUT * FAN_OUT), FAN_OUT)
            for k in range(0, len(a), 4096):  # depth first, so that few pairs wait at a time
                x = (a[k : k + 4096, None] * FAN_OUT + i).ravel()
                y = (b[k : k + 4096, None] * FAN_OUT + j).ravel()
                inside = (x < width) & (y < width) & (x <= y)
                waiting.append((level - 1, x[inside], y[inside]))


def _trees(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], component: np.ndarray, rest: np.ndarray | None = None):
    """For a group's sets, in order of size: (places, SignatureTree) of each class of signature width, with
    the sets of the next class folded to it. Pairs with the smaller set in the class are the tree's."""
    words = np.array([len(b) for b in bits])
    for w in np.unique(words).tolist():
        at = np.flatnonzero((words == w) | (words == 2 * w))
        yield at, words[at] == w, SignatureTree(sizes[at], np.stack([folded(bits[i], w) for i in at]), component[at], None if rest is None else rest[at])


def star_pairs(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], rest: np.ndarray | None = None) -> list[np.ndarray]:
    """Pairs of a group's sets with a leader: the first set leads all that bounds allow, then the first of the rest."""
    out = []
    for at, own, tree in _trees(ids, sizes, bits, np.arange(len(ids)), rest):
        left = np.arange(len(at))
        while len(left) > 1 and own[left[0]]:
            lead, left = left[0], left[1:]
            ok = tree.may_link(0, np.full(len(left), lead), left)
            out.append(np.stack((np.full(int(ok.sum()), ids[at[lead]]), ids[at[left[ok]]])))
            left = left[~ok]
    return out


def leader_pairs(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], component: np.ndarray, rest: np.ndarray | None = None) -> list[np.ndarray]:
    """Pairs of LEADERS of a large group's sets, the first ones by a hash, so much the same ones in all groups
    of a family, with its sets in other components."""
    out = []
    if len(ids) <= 2 * LEADERS or (component == component[0]).all():
        return out
    for at, _, tree in _trees(ids, sizes, bits, component, rest):
        for lead in np.argsort(mix(ids[at].view(np.uint64)), kind="stable")[:LEADERS].tolist():
            others = np.flatnonzero(component[at] != component[at[lead]])
            ok = tree.may_link(0, np.full(len(others), lead), others)
            out.append(np.stack((np.full(int(ok.sum()), ids[at[lead]]), ids[at[others[ok]]])))
    return out


def cross_pairs(ids: np.ndarray, sizes: np.ndarray, bits: list[np.ndarray], component: np.ndarray, rest: np.ndarray | None = None) -> list[np.ndarray]:
    """Pairs of a group's sets in different components, by dual traversal of its trees."""
    out = []
    if (component == component[0]).all():
        return out
    component = np.unique(component, return_inverse=True)[1]
    for at, own, tree in _trees(ids, sizes, bits, component, rest):
        for a, b in tree.pairs():
            keep = own[a]
            out.append(np.stack((ids[at[a[keep]]], ids[at[b[keep]]])))
    return out


def _pairs(groups: DataFrame, signatures: DataFrame, n_members: int, of_group) -> DataFrame:
    """The distinct pairs (a, b), a < b, that ``of_group`` makes of ``groups`` (group_id, set_id, least, component, place) with the
    sets' ``signatures`` (set_id, n, bits). Groups with the same least set come in the same batch, which
    gets a set's signature once and keeps a pair once."""
    n_batches = max(1, -(-n_members // BATCH))

    def run(members: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
        sets = sets.sort_values(["n", "bits", "set_id"], kind="stable").reset_index(drop=True)  # like ones side by side
        place = pd.Series(np.arange(len(sets)), index=sets["set_id"])
        at = place.loc[members["set_id"]].to_numpy()
        group, component, place_of = (members[c].to_numpy() for c in ("group_id", "component", "place"))
        order = np.lexsort((at, group))
        at, group, component, place_of = at[order], group[order], component[order], place_of[order]
        ids, sizes = sets["set_id"].to_numpy(dtype=np.int64), sets["n"].to_numpy(dtype=np.int64)
        bits = [np.frombuffer(x, dtype=np.uint64) for x in sets["bits"]]
        cuts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        found = [np.zeros((2, 0), np.int64)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            some = at[a:b]
            found += [np.sort(pairs, axis=0) for pairs in of_group(ids[some], sizes[some], [bits[k] for k in some.tolist()], component[a:b], sizes[some] - place_of[a:b])]
            if sum(p.shape[1] for p in found[1:]) > CHUNK:  # groups of a family tell the same pairs
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": a, "b": b})

    # a family of near copies has many groups with the same least set: beyond a bound they are dealt to several batches
    parts = groups.groupBy(F.col("least").alias("of")).agg((F.count(F.lit(1)) / (4 * BATCH)).cast("long").alias("parts")).where("parts > 0")
    batch = F.pmod(F.xxhash64("least", F.pmod(F.xxhash64("group_id"), F.coalesce("parts", F.lit(0)) + 1)), F.lit(n_batches)).alias("batch")
    dealt = groups.join(parts, groups["least"] == parts["of"], "left").select("group_id", "set_id", "component", "place", batch)
    sets = dealt.select(F.col("batch").alias("of_batch"), F.col("set_id").alias("of_set")).distinct()
    sets = sets.join(signatures, sets["of_set"] == signatures["set_id"]).select("of_batch", F.col("of_set").alias("set_id"), F.col("n").alias("n"), F.col("bits").alias("bits"))
    return dealt.groupBy("batch").cogroup(sets.groupBy("of_batch")).applyInPandas(run, "a long, b long").distinct()


def _for_stars(groups: DataFrame) -> DataFrame:
    """Of each set's memberships those in its STAR_GROUPS largest groups. A family of near copies shares many groups with nearly the same
    members, whose stars would all tell the same; what these few leave apart is found by later steps."""
    sizes = groups.groupBy(F.col("group_id").alias("of")).agg(F.count(F.lit(1)).alias("size"))
    sized = groups.join(sizes, groups["group_id"] == sizes["of"]).select("set_id", F.struct("size", "group_id", "least", "place").alias("g"))
    largest = sized.groupBy("set_id").agg(F.slice(F.sort_array(F.collect_list("g"), asc=False), 1, STAR_GROUPS).alias("gs"))
    return largest.select("set_id", F.inline("gs")).select("group_id", "set_id", "least", "place")


def _blocks(divided: DataFrame, roots: DataFrame) -> DataFrame:
    """(group_id, set_id, least, place, component): ``divided`` groups that lie in several components, as blocks of two parts. Sets
    of the largest component meet only those outside it."""
    joined = divided.join(roots, divided["set_id"] == roots["node"], "left").select("group_id", "set_id", "least", "place", F.coalesce("root", "set_id").alias("component"))
    each = joined.groupBy("group_id", "component").agg(F.count(F.lit(1)).alias("size"))
    most = each.groupBy(F.col("group_id").alias("of")).agg(F.max(F.struct("size", "component")).alias("main"), F.sum("size").alias("all")).where(F.col("all") > F.col("main.size"))
    n_main, n_rest = F.ceil(F.col("main.size") / GROUP), F.ceil((F.col("all") - F.col("main.size")) / GROUP)
    sided = joined.join(most, joined["group_id"] == most["of"]).withColumns({"is_main": F.col("component") == F.col("main.component"), "n_main": n_main, "n_rest": n_rest})
    part = F.pmod(F.xxhash64("set_id"), F.when(F.col("is_main"), F.col("n_main")).otherwise(F.col("n_rest")))
    sided = sided.withColumn("part", part)
    one_to = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    with_rest = F.transform(one_to(F.col("n_rest")), lambda j: F.when(F.col("is_main"), F.struct(F.lit(1).alias("kind"), j.alias("x"), F.col("part").alias("y"))).otherwise(F.struct(F.lit(0).alias("kind"), F.least("part", j).alias("x"), F.greatest("part", j).alias("y"))))
    with_main = F.transform(one_to(F.col("n_main")), lambda j: F.struct(F.lit(1).alias("kind"), F.col("part").alias("x"), j.alias("y")))
    block = F.explode(F.when(F.col("is_main"), with_rest).otherwise(F.concat(with_rest, with_main)))
    return sided.select("group_id", "set_id", "least", "place", "component", block.alias("block")).select(F.xxhash64("group_id", "block.kind", "block.x", "block.y").alias("group_id"), "set_id", "least", "place", "component")


# ---------------------------------------------------------------- exact verification


def _grouped_sets(docs: DataFrame, ids: DataFrame, salt: int) -> DataFrame:
    """(set_id, n, bits, shingles) of the sets in ``ids``, each once. Their numbers are broadcast if there are at
    most BROADCAST_IDS of them; else the shingles of all sets meet them in a join."""
    n = ids.count()
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy())) if n <= BROADCAST_IDS else None
    id_bits = ID_BITS

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for _, texts in chunks(batch, limit=CHUNK):
                some = {}
                for found in shingle_sets(texts):
                    i = numbers(found, salt, id_bits)[0]
                    if i in some or i in seen or not len(found):
                        continue
                    if wanted is not None:
                        at = int(np.searchsorted(wanted.value, i))
                        if at == len(wanted.value) or wanted.value[at] != i:
                            continue
                        seen.add(i)
                    some[i] = found
                if some:
                    made = [pa.array(list(some), pa.int64()), pa.array([len(x) for x in some.values()], pa.int32())]
                    made += [pa.array([f(x) for x in some.values()], pa.binary()) for f in (lambda x: signature(x).tobytes(), lambda x: x.tobytes())]
                    yield pa.RecordBatch.from_arrays(made, names=["set_id", "n", "bits", "shingles"])

    found = docs.select("text").mapInArrow(lean(run), "set_id long, n int, bits binary, shingles binary")
    if wanted is None:
        found = found.join(ids, "set_id", "left_semi")
    return found.groupBy("set_id").agg(*(F.first(c).alias(c) for c in ("n", "bits", "shingles")))


def _verified(pairs: DataFrame, signatures: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link, by the shingles of ``signatures``. Of a pair the set with more pairs is its hub. Hubs are hashed to
    blocks of about BLOCK, which a task holds; the others' shingles stream by, each once for all its
    hubs of a block. A hub of more than HUB pairs is held by several tasks, which share its pairs."""
    degree = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).groupBy("set_id").agg(F.count(F.lit(1)).alias("degree"))
    degree = written(degree, "join-degrees")
    n_blocks = max(1, -(-degree.count() // BLOCK))
    both = pairs.join(degree.toDF("a", "da"), "a").join(degree.toDF("b", "db"), "b")
    first = F.col("da") >= F.col("db")
    hubs = both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.ceil(F.greatest("da", "db") / HUB).alias("parts"))
    keyed = hubs.select(F.pmod(F.xxhash64("hub"), F.lit(n_blocks)).cast("int").alias("block"), F.pmod(F.xxhash64("other"), "parts").cast("int").alias("part"), "hub", "other")
    held = keyed.select("block", "part", F.lit(0).alias("kind"), F.col("hub").alias("of"), F.lit(None).cast("array<long>").alias("hubs")).distinct()
    passing = keyed.groupBy("block", "part", F.col("other").alias("of")).agg(F.collect_list("hub").alias("hubs")).select("block", "part", F.lit(1).alias("kind"), "of", "hubs")
    needs = written(held.unionByName(passing), "join-needs")
    n_bytes = needs.agg(F.sum(40 + 8 * F.coalesce(F.size("hubs"), F.lit(0)))).first()[0] or 0
    needs = F.broadcast(needs) if n_bytes <= BROADCAST_BYTES else needs.hint("shuffle_merge")
    rows = signatures.select("set_id", "shingles").join(needs, F.col("set_id") == F.col("of")).select("block", "part", "kind", "of", "hubs", "shingles")
    in_order = rows.repartition("block", "part").sortWithinPartitions("block", "part", "kind", "of")

    def link(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, hubs_of = None, {}
        for batch in batches:
            out = []
            block, part, kind, of, wanted = (batch.column(k).to_pylist() for k in range(5))
            for k in range(batch.num_rows):
                if at != (block[k], part[k]):
                    at, hubs_of = (block[k], part[k]), {}
                mine = np.frombuffer(batch.column(5)[k].as_py(), dtype=np.uint64)
                if kind[k] == 0:
                    hubs_of[of[k]] = mine
                    continue
                for hub in wanted[k]:
                    other = hubs_of[hub]
                    merged = np.sort(np.concatenate((mine, other)))
                    if int((merged[1:] == merged[:-1]).sum()) >= needed(len(mine) + len(other)):
                        out.append((min(hub, of[k]), max(hub, of[k])))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return in_order.mapInArrow(lean(link), "a long, b long").distinct()


# ---------------------------------------------------------------- the join


def similar_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    return components(docs).select("doc_id", "n_shingles", "component_id")


def components(docs: DataFrame, digests: bool = False) -> DataFrame:
    """``similar_documents`` with ``top``, the component's own number, which rows of null doc_id have too (0 for
    all empty sets), and with ``digests`` the MD5 of each row's text, that of an empty one for null."""
    spark = docs.sparkSession
    sketch = spark.sparkContext.broadcast(_sketch(docs))
    sets, salt = _numbered_sets(docs, sketch, digests)
    n_entries = sets.agg(F.sum(F.octet_length("prefix") / 8)).first()[0] or 0
    found = written(_strong(written(_groups(sets, sketch, int(n_entries)), "join-groups"), sets), "join-groups")
    signatures = written(_grouped_sets(docs, written(found.select("set_id").distinct(), "join-grouped"), salt), "join-signatures")
    sketch.unpersist()
    trim()
    own, divided = found.where("not divided").drop("divided"), found.where("divided").drop("divided")
    n_divided = divided.count()
    parts = _parts(divided) if n_divided else None
    groups = own if parts is None else written(own.unionByName(parts), "join-groups")
    n_members = groups.count()

    first = _for_stars(own) if parts is None else _for_stars(own).unionByName(parts)
    alone = written(first.withColumn("component", F.col("set_id")), "join-first")
    stars = written(_pairs(alone, signatures, alone.count(), lambda ids, sizes, bits, _, rest: star_pairs(ids, sizes, bits, rest)), "join-stars")
    links = written(_verified(stars, signatures), "join-links")
    roots = written(connected_components(links, small=ONE_TASK), "join-roots")

    def apart(more_than: int, of: DataFrame, but: DataFrame | None = None) -> DataFrame:
        """Groups of more sets than that which lie in several components, without those in ``but``."""
        joined = of.join(roots, of["set_id"] == roots["node"], "left")
        joined = joined.select("group_id", "set_id", "least", "place", F.coalesce("root", "set_id").alias("component"))
        some = joined.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"), F.min("component").alias("low"), F.max("component").alias("high"))
        some = some.where(f"size > {more_than} and low <> high").select("group_id", "size")
        some = some if but is None else some.join(but, ["group_id", "size"], "left_anti")
        return joined.join(some.select("group_id"), "group_id", "left_semi")

    # families whose leader doesn't reach all: a few more leaders, else what is left would meet in pairs
    more = written(_pairs(apart(2 * LEADERS, groups), signatures, n_members, leader_pairs).join(stars, ["a", "b"], "left_anti"), "join-more")
    if more.limit(1).count():
        links = links.unionByName(written(_verified(more, signatures), "join-links"))
        roots = written(connected_components(links, small=ONE_TASK), "join-roots")
    tested = stars.unionByName(more)
    # (a group of two sets has one pair, which its star has tested or excluded, if it is among the largest groups of both)
    last = apart(1, own, alone.groupBy("group_id").agg(F.count(F.lit(1)).alias("size")).where("size = 2"))
    if n_divided:
        blocks = written(_blocks(divided, roots), "join-blocks")
        last, n_members = last.unionByName(blocks), n_members + blocks.count()
    crossing = written(_pairs(last, signatures, n_members, cross_pairs).join(tested, ["a", "b"], "left_anti"), "join-crossing")
    crossed = _verified(crossing, signatures)
    contracted = crossed.join(roots.toDF("a", "root_a"), "a", "left").join(roots.toDF("b", "root_b"), "b", "left").select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b"))
    over = connected_components(contracted, small=ONE_TASK)

    # all empty sets have the number 0, and their rows are each on their own
    least = sets.where("n > 0").groupBy("set_id").agg(F.min("doc_id").alias("least"))
    labelled = least.join(roots.toDF("set_id", "root"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    labelled = labelled.join(over.toDF("root", "top"), "root", "left").select("set_id", "least", F.coalesce("top", "root").alias("top"))
    ids = labelled.groupBy("top").agg(F.min("least").alias("component_id"))
    of_set = labelled.join(ids, "top").select("set_id", "component_id", "top")
    digest = ["digest"] if digests else []
    size = F.col("n").cast("long").alias("n_shingles")
    full = sets.where("n > 0").join(of_set, "set_id").select("doc_id", size, "component_id", "top", *digest)
    return full.unionByName(sets.where("n = 0").select("doc_id", size, F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("top"), *digest))
