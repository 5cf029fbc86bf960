"""How numbers are shown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(share: Column) -> Column:
    """``93%`` for 0.93; ties to the even digit, as C's formatting has it."""
    return F.concat(F.bround(share * 100, 0).cast("int").cast("string"), F.lit("%"))


def kilobytes(size: Column) -> Column:
    """``12.3 KB`` for a number of bytes."""
    return F.concat(F.format_string("%.1f", F.round(size / 1024, 1)), F.lit(" KB"))
