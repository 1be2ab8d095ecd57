"""Canonical spellings of identifiers, hook names and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OUTER = r"(?U)^[\s\p{Z}]+|[\s\p{Z}]+$"


def outer_trim(c: Column) -> Column:
    """Without outer Unicode white space."""
    return F.regexp_replace(c, _OUTER, "")


def canonical_id(c: Column) -> Column:
    """Identifiers are equal without outer white space, letter case and the prefixes evt_ and sha256:. Blank gives null."""
    s = F.regexp_replace(F.lower(outer_trim(c)), "^(evt_|sha256:)", "")
    return F.when(s != "", s)


def hook_name(c: Column) -> Column:
    """Hook names are equal without letter case and underscores."""
    return F.replace(F.lower(outer_trim(c)), F.lit("_"), F.lit(""))


def has_text(c: Column) -> Column:
    """True if there is a character that isn't Unicode white space; false for null."""
    return F.coalesce(F.regexp_like(c, F.lit(r"(?U)[^\s\p{Z}]")), F.lit(False))


def instant_ms(c: Column) -> Column:
    """Milliseconds since 1970 of a time written as text.

    A bare number is milliseconds, a time without a zone is UTC, whatever the session's zone. Null for blank or
    unreadable texts.
    """
    s = F.replace(outer_trim(c), F.lit(" "), F.lit("T"))
    zoned = F.when(F.regexp_like(s, F.lit(r"^\d{4}-\d\d-\d\d$")), F.concat(s, F.lit("T00:00:00Z"))).when(
        F.regexp_like(s, F.lit(r"(?i)(z|[+-]\d\d:?\d\d)$")) & F.contains(s, F.lit("T")), F.regexp_replace(s, r"([+-]\d\d)(\d\d)$", "$1:$2")
    ).otherwise(F.concat(s, F.lit("Z")))
    number = F.regexp_like(s, F.lit(r"^[+-]?\d+(\.\d+)?$"))
    return F.when(number, F.floor(s.try_cast("decimal(28,6)")).cast("long")).otherwise(F.unix_millis(zoned.try_cast("timestamp")))
