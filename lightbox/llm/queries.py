"""The registered queries of this subpackage, over whole tables with production parameters."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, bpe, editprint, fertility, mixing, ngramjoin, packing, periodic, pii, quality, sharding, tokencount, urlfilter
from .common import shared_dir, written


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(_table(spark, sf_dir, "documents"), n_shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("pii_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *(count(k) for k in pii.BASE_KINDS), F.sha2(pii.listed(F.col("pii_base")), 256).alias("base_sha256"),
        pii.listed(F.concat("pii_base", "pii_added")).alias("spans"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in urlfilter.listed_urls()], "key string")
    return urlfilter.judge(_table(spark, sf_dir, "pages"), listed).select("page_id", "host", "path", "rule", "verdict")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"  # a cache of this run's own: it shows the work of a first run
    counted = tokencount.count_tokens(_table(spark, sf_dir, "documents"), cache, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 4096)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "shard_words")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text", "lang", "source"), model).select("doc_id", *quality.SCORES)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.similar_documents(_table(spark, sf_dir, "documents"))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = fertility.judge(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chars_per_token", "byte_share", "entropy")


def op10_edit_prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editprint.near_copies(written(editprint.with_neighbours(_table(spark, sf_dir, "documents")), "editprint-rows"))


def op11_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    library, ranks = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pieces(_table(spark, sf_dir, "documents"), library, ranks, public_tokenizers.PATTERN)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return periodic.digests(periodic.find_runs(periodic.planted(docs)))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    made = (
        op1_sharding, op2_pii, op3_bpe, op4_url_filter, op5_token_counts, op6_mixing, op7_quality, op8_ngram_join, op9_fertility, op10_edit_prints,
        op11_retrieval_packing, op12_periodic_runs, op13_filter_audit,
    )
    return {f.__name__: f for f in made}


def oracle_sql() -> dict[str, str]:
    listed = ", ".join(f"'{u[:-1]}'" for u in urlfilter.listed_urls())
    return {
        "op8_ngram_join": rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urlfilter.UPPER}', '{urlfilter.LOWER}'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS shingle
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.least, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.a = d.doc_id""",
        "op4_url_filter": rf"""
WITH p AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '{urlfilter.UPPER}', '{urlfilter.LOWER}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule,
    regexp_replace(regexp_replace(host, '^.*@', ''), '\.?(:[0-9]*)?$', '') AS bare
  FROM p)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN EXISTS (SELECT 1 FROM (SELECT unnest([{listed}]) AS site) WHERE bare = site OR ends_with(bare, '.' || site)) THEN 'block'
  ELSE 'allow' END AS verdict
FROM r""",
        "op12_periodic_runs": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
bits AS (
  SELECT doc_id, flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1), lambda k: list_transform(range(8), lambda b: (ascii(substr(CAST(doc_id AS VARCHAR), k, 1)) >> b) & 1))) AS bs
  FROM d WHERE doc_id IS NOT NULL),
h AS (
  SELECT doc_id, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(bs, lambda x: x::BIGINT)), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h
  FROM (SELECT DISTINCT doc_id, bs FROM bits)),
p AS (
  SELECT d.doc_id, ws, h % 10 = 0 AND len(ws) > 0 AS plant, len(ws) AS n, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a
  FROM d LEFT JOIN h USING (doc_id)),
q AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM p),
w AS (SELECT doc_id, CASE WHEN plant THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM q),
x AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM w),
e AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM x JOIN x y ON x.doc_id = y.doc_id AND x.word = y.word AND x.i < y.i),
s AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM e),
m AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM s GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
r AS (SELECT doc_id, start, length, min(q) AS period FROM m GROUP BY doc_id, start, length),
f AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    list({'s': start, 'l': length, 'p': period} ORDER BY start, period) AS rs
  FROM r GROUP BY doc_id),
b AS (
  SELECT doc_id, start, length, period FROM r
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
k AS (
  SELECT doc_id, list_filter(range(len(ws)), lambda i: len(list_filter(rs, lambda z: z.s + z.p <= i AND i < z.s + z.l)) = 0) AS stay
  FROM w JOIN f USING (doc_id))
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN stay IS NULL THEN ws ELSE list_transform(stay, lambda i: ws[i + 1]) END, ' ')) AS collapsed_sha256
FROM w LEFT JOIN f USING (doc_id) LEFT JOIN b USING (doc_id) LEFT JOIN k USING (doc_id)""",
        "op13_filter_audit": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
m AS (
  SELECT d.doc_id, part, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN d.doc_id > min(d.doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END AS failed,
    coalesce(quality = 1, false) AS good, coalesce(toxic = 1, false) AS toxic
  FROM d LEFT JOIN labels l ON l.doc_id = d.doc_id),
o AS (SELECT '' AS filter_order, 0 AS n UNION ALL SELECT filter_order || f, n + 1 FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE n < 5 AND NOT contains(filter_order, f)),
s AS (SELECT filter_order, step, filter_order[step] AS f, filter_order[1 : step - 1] AS before FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o WHERE n = 5)),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, failed),
t AS (
  SELECT part, filter_order, step, f, n, good, toxic, contains(failed, f) AS fails, failed = f AS only_f,
    len(list_filter(range(1, len(before) + 1), lambda i: contains(failed, before[i]))) > 0 AS gone
  FROM c, s),
a AS (
  SELECT part, filter_order, step, f, coalesce(sum(n) FILTER (NOT fails AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (fails AND NOT gone), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (only_f), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (fails AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM t GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM a""",
    }
