"""URL filtering: a blocked Bloom filter before an exact hash join.

The list holds canonical URLs, ``host/path``; an entry with the path ``/`` lists its host and
all subdomains. The filter is a table of blocks (one row: block number and eight 64-bit
words); a key sets one bit in each word of a single block. Pages probe it by a join on the
block number, which is broadcast only if a count proves it small, and the few possible hits
meet the list in an exact equi-join, so false positives never reach the result.

Defined results: a url that is null or has no ``://`` has empty host and path, fits no rule
and is allowed; repeated rows are judged alike; an empty list or table works as expected;
columns other than page_id and url are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The rules of the contract, (host, path, verdict).
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
# Listed sites (each with all its subdomains).
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
LISTED_SUFFIXES = ["example.com", "example.net", "example.org"]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: A filter with more blocks than this is joined by a shuffle instead of a broadcast (72 bytes a block).
BROADCAST_BLOCKS = 1 << 18


def listed_urls() -> list[str]:
    return [f"{site}.{suffix}/" for site in LISTED_SITES for suffix in LISTED_SUFFIXES]


def with_parts(pages: DataFrame) -> DataFrame:
    """Adds host (A-Z lower-cased) and path: host from after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end, path from there up to ``?``, ``#`` or the end."""
    url = F.coalesce("url", F.lit(""))
    parsed = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return pages.withColumns({"host": F.translate(F.regexp_extract(url, parsed, 1), UPPER, LOWER), "path": F.regexp_extract(url, parsed, 2)})


def canonical(host: Column, path: Column) -> Column:
    """``host/path`` without user, port, a dot after the host, and slashes or ``.html`` at the end."""
    bare = F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    return F.concat(bare, F.lit("/"), F.regexp_replace(F.regexp_replace(path, r"^/+|/+$", ""), r"\.html$", ""))


def _bits(key: Column) -> list[Column]:
    """A mask with one bit for each word of the key's block."""
    h = F.xxhash64(F.lit(1), key)
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.shiftrightunsigned(h, 6 * k), F.lit(64)).cast("int")) for k in range(WORDS)]


def _block(key: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), key), F.lit(n_blocks))


def build_filter(listed: DataFrame, n_keys: int, keys_per_block: int = 32) -> tuple[DataFrame, int]:
    """The filter's blocks (block, w0..w7) for the ``key`` column of ``listed``, and their number:
    a power of two, so that a block has 512 bits for about ``keys_per_block`` keys."""
    n_blocks = 1 << max(0, (max(1, n_keys) // keys_per_block).bit_length())
    masks = listed.select(_block(F.col("key"), n_blocks).alias("block"), *(m.alias(f"w{k}") for k, m in enumerate(_bits(F.col("key")))))
    return masks.groupBy("block").agg(*(F.bit_or(f"w{k}").alias(f"w{k}") for k in range(WORDS))), n_blocks


def listed_hits(urls: DataFrame, listed: DataFrame) -> DataFrame:
    """The distinct values of ``url`` in ``urls`` (url, host, path) that ``listed`` (key) lists."""
    listed = listed.select("key").where("key is not null").distinct()
    n_keys = listed.count()
    blocks, n_blocks = build_filter(listed, n_keys)
    host = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r"\.?(:[0-9]*)?$", "")
    labels = F.split(host, r"\.")
    sites = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    keys = F.array_distinct(F.concat(F.array(canonical(F.col("host"), F.col("path"))), sites))
    probes = urls.where("host <> ''").select("url", F.explode(keys).alias("key"))
    probes = probes.withColumn("block", _block(F.col("key"), n_blocks))
    possible = probes.join(F.broadcast(blocks) if n_blocks <= BROADCAST_BLOCKS else blocks, "block")
    all_set = reduce(lambda a, b: a & b, (F.col(f"w{k}").bitwiseAND(m) != 0 for k, m in enumerate(_bits(F.col("key")))))
    return possible.where(all_set).select("url", "key").join(listed, "key", "left_semi").select("url").distinct()


def judge(pages: DataFrame, listed: DataFrame, rules=None) -> DataFrame:
    """(page_id, host, path, rule, verdict, listed): the longest fitting rule's verdict, else
    block if the list holds the url, else allow."""
    parts = with_parts(pages.select("page_id", "url"))
    hits = listed_hits(parts, listed).withColumn("listed", F.lit(True))
    rule = verdict = F.lit(None).cast("string")
    for host, path, what in sorted(RULES if rules is None else rules, key=lambda r: len(r[0] + r[1])):  # longer ones last: they win
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.startswith("path", F.lit(path))
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return parts.join(hits, "url", "left").select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("listed", F.lit(False)).alias("listed"),
    )
