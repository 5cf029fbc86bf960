"""Quality rules: tokeniser fertility within bands per language.

Base rules count words, symbols, repeated lines and repeated windows as their contract says.
The method encodes each whole text with a public vocabulary and measures characters per token,
the share of byte-fallback tokens and the entropy of its tokens in bits. What is usual depends
on the language and on a text's length, so all distinct texts that pass the base rules set, for each
language and half a doubling of token count, the quartiles of each measure, copies counting once;
quartiles are set again without what lay far off. A text is rejected whose joint distance from the medians (fertility
on both sides, entropy below, byte fallback above) is over ``BAND`` robust deviations. A cell
with under ``LEAST`` distinct texts uses those of the whole doubling, of its language, or of all texts,
the first that has enough.

Defined results: a null text has no words and fails the base rules, as an empty one does; a
null lang is a language of its own; repeated rows are judged alike; an empty table gives an
empty result; other columns than doc_id, text and lang are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache, reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import chunks
from .common import lean, written

# The characters that count as symbols, the window, and the base rules' limits.
SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS, MAX_REPEATED = 20, 0.30

BAND, LEAST = 6.0, 50
#: Quartiles are those of bins of these widths, counted exactly.
BINS = {"chars_per_token": 1 / 512, "entropy": 1 / 512, "byte_share": 1 / 4096}
#: Deviations are at least this, so that uniform corpora don't reject what hardly differs.
FLOORS = {"chars_per_token": 0.01, "entropy": 0.03, "byte_share": 0.004}

MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, chars_per_token double, byte_share double, entropy double, digest binary"


class _Numbers(dict):
    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """How many words lie in windows of ``window`` words that the list holds at least twice."""
    if len(words) <= window:
        return 0
    ids = np.fromiter(map(_Numbers().__getitem__, words), dtype=np.uint64, count=len(words))
    if int(ids.max()) + 1 == len(words):
        return 0
    n = len(words) - window + 1
    mixed = (ids + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    keys = np.zeros(n, dtype=np.uint64)
    for k in range(window):
        keys = keys * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
        keys ^= keys >> np.uint64(31)
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_measures(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


@lru_cache(maxsize=2)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def token_measures(ids: list[int], n_chars: int, is_byte: np.ndarray) -> tuple[int, float, float, float]:
    """n_tokens, characters per token, byte-fallback share, entropy in bits; zeros without tokens."""
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    found = np.sort(np.array(ids, dtype=np.int32))
    counts = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], found[1:] != found[:-1]))), [n])))
    share = counts / n
    return n, n_chars / n, float(is_byte[found].mean()), float(-(share * np.log2(share)).sum())


def measure(docs: DataFrame, path: str) -> DataFrame:
    """``MEASURES`` of each row; ``path`` is a sentencepiece model readable on the executors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, is_byte = _model(path)
        for batch in batches:
            for rows, texts in chunks(batch, limit=1_000_000):
                encoded = model.encode(texts, num_threads=1)
                made = [(*base_measures(t), *token_measures(ids, len(t), is_byte), blake2b(t.encode(), digest_size=16).digest()) for t, ids in zip(texts, encoded, strict=True)]
                kinds = [pa.int64()] * 6 + [pa.float64()] * 3 + [pa.binary()]
                columns = [pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), *columns], names=[f.split()[0] for f in MEASURES.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "lang", "text").mapInArrow(lean(run), MEASURES)


def _binned(texts: DataFrame, keys: list[str]) -> DataFrame:
    """How many texts of each cell of ``keys`` have a measure in each bin: partial counts keep what is shuffled small."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), F.floor(F.col(m) / w).cast("long").alias("bin")) for m, w in BINS.items())))
    return texts.select(*keys, each.alias("at")).groupBy(*keys, "at.measure", "at.bin").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(binned: DataFrame, keys: list[str]) -> DataFrame:
    """(of_<key>..., n, each measure's median and robust deviation) of the cells of ``keys`` from counts by bin; a bin stands
    for its middle."""
    sums = binned.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    cell = Window.partitionBy(*keys, "measure")  # no more rows than a measure has bins
    placed = sums.withColumns({"upto": F.sum("n").over(cell.orderBy("bin")), "all": F.sum("n").over(cell)})
    at = [F.min(F.when(F.col("upto") >= F.ceil(F.col("all") * q), F.col("bin"))) for q in (0.25, 0.5, 0.75)]
    width = F.create_map(*(x for m, w in BINS.items() for x in (F.lit(m), F.lit(w))))[F.col("measure")]
    floor = F.create_map(*(x for m, w in FLOORS.items() for x in (F.lit(m), F.lit(w))))[F.col("measure")]
    found = placed.groupBy(*keys, "measure").agg(F.max("all").alias("n"), *(q.alias(f"q{k}") for k, q in enumerate(at)))
    band = F.struct(((F.col("q1") + 0.5) * width).alias("mid"), ((F.col("q2") - F.col("q0")) * width / 1.349 + floor).alias("dev"))
    found = found.withColumn("band", band).groupBy(*keys).agg(F.max("n").alias("n"), *(F.max(F.when(F.col("measure") == m, F.col("band"))).alias(m) for m in BINS))
    return found.select(*(F.col(k).alias(f"of_{k}") for k in keys), "n", *BINS)


def _bands(usual: DataFrame, cells: DataFrame) -> DataFrame:
    """``cells`` (lang, octave, half) with the bands that ``usual`` sets for each: those of the smallest part around the cell that has
    LEAST distinct texts. ``usual`` has a text once a language; all texts together count it once."""
    binned = written(_binned(usual, ["lang", "octave", "half"]), "fertility-bins")
    whole = written(_binned(usual.dropDuplicates(["digest"]), []), "fertility-bins")
    out = cells
    for level, keys in enumerate((["lang", "octave", "half"], ["lang", "octave"], ["lang"], [])):
        part = _quartiles(binned if keys else whole, keys)
        part = part.where(F.col("n") >= LEAST) if keys else part
        part = part.select(*(f"of_{k}" for k in keys), F.struct(*BINS).alias(f"level_{level}"))
        same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys), F.lit(True))
        out = out.join(part if keys else F.broadcast(part), same, "left").drop(*(f"of_{k}" for k in keys))  # without keys it is a single row
    return written(out.select("lang", "half", F.coalesce(*(f"level_{k}" for k in range(4))).alias("band")), "fertility-cells")


def _far(measures: DataFrame, usual: DataFrame, cells: DataFrame) -> DataFrame:
    """``measures`` with ``far``, the joint distance from the bands that ``usual`` sets."""
    bands = _bands(usual, cells).withColumnsRenamed({"lang": "cell_lang", "half": "cell_half"})
    joined = measures.join(bands, F.col("lang").eqNullSafe(F.col("cell_lang")) & (F.col("half") == F.col("cell_half")), "left")
    z = lambda m: (F.col(m) - F.col("band")[m]["mid"]) / F.col("band")[m]["dev"]
    zero = F.lit(0.0)
    off = F.pow(z("chars_per_token"), 2) + F.pow(F.least(z("entropy"), zero), 2) + F.pow(F.greatest(z("byte_share") / 2, zero), 2)
    return joined.withColumn("far", F.coalesce(F.sqrt(off), zero)).select(*measures.columns, "far")


def judge(docs: DataFrame, path: str) -> DataFrame:
    """Base measures, base_failed, kept, and the method's measures with ``far``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))
    measures = measure(docs, path).withColumns({"base_failed": failed, "half": F.floor(2 * F.log2(F.greatest(F.col("n_tokens"), F.lit(1)))).cast("int")})
    measures = measures.withColumn("octave", F.floor(F.col("half") / 2).cast("int"))  # a cell is a language and a half
    measures = written(measures, "fertility")
    usual = measures.where(~F.col("base_failed")).select("lang", "half", "octave", "digest", *FLOORS).dropDuplicates(["lang", "digest"])
    usual = written(usual, "fertility-usual")
    cells = written(measures.select("lang", "octave", "half").distinct(), "fertility-cells")
    for _ in range(2):
        usual = _far(usual, usual, cells).where(F.col("far") <= 4).drop("far")
    return _far(measures.drop("digest"), usual, cells).withColumn("kept", ~F.col("base_failed") & (F.col("far") <= BAND))
