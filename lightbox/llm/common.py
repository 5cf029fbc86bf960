"""Shared helpers: names that can't clash, let-bindings for columns, running sums."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.materialize import shared_dir, written

__all__ = ["SPACE", "WORD", "fresh", "let", "named", "other_names", "plain", "lean", "shared_dir", "sums_before", "trim", "written"]

#: ASCII white space as the contracts define it, and its complement (a word).
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def fresh(docs: DataFrame, stem: str) -> str:
    """``stem``, or it with underscores after it: a column name that ``docs`` doesn't have in any case."""
    taken = {c.lower() for c in docs.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def other_names(docs: DataFrame, *names: str) -> list[str]:
    """The columns of ``docs`` that have none of ``names`` in any case."""
    left_out = {n.lower() for n in names}
    return [c for c in docs.columns if c.lower() not in left_out]


def named(*names: str) -> list[Column]:
    """Columns by their plain names, whatever characters these hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain(df: DataFrame) -> DataFrame:
    """``df`` with its columns in their order, those with odd names (``a.b``) renamed, as mapInArrow needs it."""
    return df.select(*(c.alias(n if n.isidentifier() else f"odd_{i}") for i, (n, c) in enumerate(zip(df.columns, named(*df.columns), strict=True))))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for a row, however often it is used."""
    return F.transform(F.array(value), body)[0]


def sums_before(lengths: Column, block: int = 256) -> Column:
    """For an array of longs, the sum of all elements before each one. Blocks keep the
    cost near linear where a plain fold would copy its array for each element."""

    def fold(values: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("before"))
        return F.aggregate(
            values,
            zero,
            lambda s, x: F.struct((s["total"] + x).alias("total"), F.concat(s["before"], F.array(s["total"])).alias("before")),
        )

    n_blocks = F.ceil(F.size(lengths) / F.lit(block)).cast("int")
    starts = F.when(n_blocks > 0, F.sequence(F.lit(0), n_blocks - 1)).otherwise(F.array().cast("array<int>"))
    folded = F.transform(starts, lambda k: fold(F.slice(lengths, k * block + 1, F.lit(block))))
    return let(
        folded,
        lambda blocks: let(
            fold(F.transform(blocks, lambda b: b["total"]))["before"],
            lambda offsets: F.flatten(F.transform(blocks, lambda b, k: F.transform(b["before"], lambda x: x + offsets[k]))),
        ),
    )


def trim() -> None:
    """Gives free memory of this process back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library; there is nothing to give back by hand


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``run`` for mapInArrow; at the end of a task its worker gives free memory back, since idle workers
    stay and count against the executor."""

    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return task
