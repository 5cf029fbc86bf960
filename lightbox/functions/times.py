"""Dates of pictures and scans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exif_time(text: Column) -> Column:
    """The two forms that cameras write, else null."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")))


def exif_iso(text: Column) -> Column:
    return F.date_format(exif_time(text), "yyyy-MM-dd'T'HH:mm:ss")


def day(iso: Column) -> Column:
    return F.substring(iso, 1, 10)


def year(iso: Column) -> Column:
    return F.substring(iso, 1, 4)


def is_stale(mtime: Column, scanned_at: Column) -> Column:
    """Never scanned, or changed since. A scan time that can't be read counts as fresh."""
    return scanned_at.isNull() | F.coalesce(mtime > F.try_to_timestamp(scanned_at), F.lit(False))
