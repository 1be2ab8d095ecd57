"""Text expressions: search terms, character grams, shingles, similarity and stable rounding."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: words that aren't search terms, and what a search term looks like
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with")
TERM = r"[\p{L}\p{N}][\p{L}\p{N}_-]{1,63}"


@F.pandas_udf(T.StringType())
def _nfkc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def compatible(c: Column) -> Column:
    """NFKC of a text. Only texts with characters outside ASCII are changed by it, but all pass through Python: use it once, at ingestion."""
    return _nfkc(c)


def terms(c: Column) -> Column:
    """Search terms of a text in order, with repeats; an empty list for null."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TERM), 0)
    return F.filter(found, lambda t: ~t.isin(*STOP_WORDS))


def query_terms(query: str) -> list[str]:
    """Distinct sorted terms of a query, which is one short text on the driver."""
    import regex

    found = regex.findall(TERM, unicodedata.normalize("NFKC", query).lower())
    return sorted({t for t in found if t not in STOP_WORDS})


def normalized(c: Column, limit: int) -> Column:
    """Lower case, runs of Unicode white space as one space, trimmed, cut at limit code points."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[\s\p{Z}]+", " ")), 1, limit)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n code points; a shorter text that isn't empty is its only gram."""
    # one code point is consumed each time, or the search would also stop within a surrogate pair
    overlapping = F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))."), 1))
    return F.when(F.length(c) > n, overlapping).when(F.length(c) > 0, F.array(c)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets given as arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def rounded(c: Column, places: int = 6) -> Column:
    """Half toward plus infinity, as floor(x * 10^places + 0.5) / 10^places."""
    scale = float(10**places)
    return F.floor(c * scale + 0.5) / scale


def shingles(c: Column, n: int = 5) -> Column:
    """Distinct runs of n words of a text whose words are parted by one space; none if it has fewer words."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?=([^ ]+(?: [^ ]+){{{n - 1}}}))[^ ]+"), 1))
