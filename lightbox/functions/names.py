"""Names of entities: sanitising, automatic and tentative ones, search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of names that must agree with existing catalogs.
FORBIDDEN = r'[<>:"/\\|?*\x00-\x1f]'
AUTO_OR_MAYBE = r"^(Person_[0-9]{3,}|maybe .*)$"
AUTO = r"^Person_[0-9]{3,}$"
AUTO_PREFIX = r"^Person_[0-9]{3}"
AUTO_NUMBER = r"^Person_([0-9]+)"
UNNAMED = "unnamed"


def sanitized(name: Column) -> Column:
    """Characters that file systems refuse become ``_``; then white space, then dots are cut off both ends."""
    clean = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, FORBIDDEN, "_"), r"^\s+|\s+$", ""), r"^[.]+|[.]+$", "")
    return F.when(clean == "", F.lit(UNNAMED)).otherwise(clean)


def sanitize(name: str) -> str:
    """``sanitized`` for a value on the driver."""
    import re

    return re.sub(r"^[.]+|[.]+$", "", re.sub(r"^\s+|\s+$", "", re.sub(FORBIDDEN, "_", name))) or UNNAMED


def user_defined(name: Column) -> Column:
    return ~name.rlike(AUTO_OR_MAYBE)


def is_user_defined(name: str) -> bool:
    import re

    return re.fullmatch(AUTO_OR_MAYBE[1:-1], name) is None


def auto_number(name: Column) -> Column:
    """The number of an automatic name, by its prefix; null for other names."""
    return F.when(name.rlike(AUTO_PREFIX), F.regexp_extract(name, AUTO_NUMBER, 1).cast("long"))


def auto_name(number: Column) -> Column:
    return F.format_string("Person_%03d", number)


def kind_filter(name: Column, kind: str) -> Column:
    """People filters: all, named, auto, maybe."""
    return {"all": F.lit(True), "named": user_defined(name), "auto": name.rlike(AUTO), "maybe": F.startswith(name, F.lit("maybe "))}[kind]


def matches(name: Column, query: str) -> Column:
    """Case-insensitive substring search; an empty query finds all."""
    return F.contains(F.lower(name), F.lower(F.lit(query)))
