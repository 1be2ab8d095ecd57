"""What is read out of diffs, addresses, times and payloads."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def changed_files(diff: Column) -> Column:
    """Distinct sorted paths that a unified diff changes, as they are named afterwards; paths may hold spaces."""
    return F.array_sort(F.array_distinct(_strings(F.regexp_extract_all(diff, F.lit(r"(?m)^diff --git a/(.+?) b/(.+?)\r?$"), 2))))


# fixed values: words that are no symbols
_NO_SYMBOLS = ("and", "async", "await", "class", "const", "def", "else", "except", "false", "finally", "for", "from", "function", "if", "import", "lambda", "none", "null", "return", "self", "static", "super", "this", "true", "try", "while", "with", "yield")


def changed_symbols(diff: Column, most: int = 128) -> Column:
    """Distinct sorted lower-case names that a diff touches, at most so many: what its changed lines define, and what its hunks' headings define or call (three letters or more, no keywords)."""
    name = "[A-Za-z_][A-Za-z0-9_]*"
    defined = F.transform(_strings(F.regexp_extract_all(diff, F.lit(rf"(?m)^[+-](?![+-])\s*(?:async\s+)?(?:def|class|function)\s+({name})"), 1)), F.lower)
    headings = _strings(F.regexp_extract_all(diff, F.lit(r"(?m)^@@[^@]*@@\s*(.*)$"), 1))
    either = rf"(?:def|class|function)\s+({name})|\b({name})\s*\("
    told = lambda h: F.zip_with(F.regexp_extract_all(h, F.lit(either), 1), F.regexp_extract_all(h, F.lit(either), 2), lambda a, b: F.lower(F.when(a != "", a).otherwise(b)))
    said = F.filter(F.flatten(F.transform(headings, told)), lambda x: (F.length(x) >= 3) & ~x.isin(*_NO_SYMBOLS))
    return F.slice(F.array_sort(F.array_distinct(F.concat(defined, said))), 1, most)


def module_scope(path: Column) -> Column:
    """The first two folders of a path, or the one that it has; a dot for a file at the top."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.when(F.size(parts) <= 1, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(2), F.size(parts) - 1)), "/"))


def line_and_column(text: Column, place: Column) -> tuple[Column, Column]:
    """Line and column, from 1, of a place from 1 in a text."""
    before = F.substring(text, F.lit(1), place - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(before, "\n", -1)) + 1


def safe_url(c: Column) -> Column:
    """A web address without user, password and fragment; null for anything else."""
    scheme, host = F.lower(F.try_parse_url(c, F.lit("PROTOCOL"))), F.try_parse_url(c, F.lit("HOST"))
    port = F.regexp_extract(c, r"^[a-zA-Z]+://(?:[^/@]*@)?[^/:?#]+(:\d+)", 1)
    rest = F.regexp_extract(c, r"^[a-zA-Z]+://[^/?#]*([^#]*)", 1)
    return F.when(scheme.isin("http", "https") & host.isNotNull(), F.concat(scheme, F.lit("://"), F.lower(host), port, rest))


def without_near_text(c: Column, limit: int) -> Column:
    """A text cut at limit characters with a mark that says how much is gone."""
    mark = F.concat(F.lit("... ["), (F.length(c) - limit).cast("string"), F.lit(" more]"))
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(F.substring(c, 1, limit), mark))


# fixed value: names of keys whose values are secrets
_SECRET_KEY = r"(?:^|[_-])(?:api[_-]?key|authorization|auth[_-]?token|password|passwd|secret|token|cookie|private[_-]?key|client[_-]?secret)(?:$|[_-])"


def redact_keys(text: str | None) -> str | None:
    """JSON with the values of secret keys replaced at every depth; camel case counts as words apart. Null stays, other texts too."""
    import re

    if text is None:
        return None
    try:
        value = json.loads(text)
    except (ValueError, RecursionError):
        return text

    def secret(key: str) -> bool:
        return re.search(_SECRET_KEY, re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", key), re.I) is not None

    def clean(v: object) -> object:
        if isinstance(v, dict):
            return {k: "[REDACTED]" if secret(k) else clean(x) for k, x in v.items()}
        return [clean(x) for x in v] if isinstance(v, list) else v

    return json.dumps(clean(value), ensure_ascii=False, separators=(",", ":"))


@F.pandas_udf(T.StringType())
def _redacted_keys(s: pd.Series) -> pd.Series:
    return s.map(redact_keys)


def without_secret_keys(c: Column) -> Column:
    """redact_keys over a column; needs Python, since keys are open."""
    return _redacted_keys(c)


def within_limits(text: str | None, depth: int = 32, nodes: int = 20_000, items: int = 4096, keys: int = 128, chars: int = 65_536) -> str | None:
    """Why a JSON text is refused (not JSON, depth, nodes, items, keys, chars), or null."""
    try:
        stack = [(json.loads(text), 1)]  # type: ignore[arg-type]
    except (ValueError, TypeError, RecursionError):
        return "not JSON"
    seen = 0
    while stack:
        v, d = stack.pop()
        seen += 1
        if d > depth:
            return "depth"
        if seen > nodes:
            return "nodes"
        if isinstance(v, str) and len(v) > chars:
            return "chars"
        if isinstance(v, list):
            if len(v) > items:
                return "items"
            stack += [(x, d + 1) for x in v]
        if isinstance(v, dict):
            if len(v) > keys:
                return "keys"
            stack += [(x, d + 1) for x in v.values()]
    return None
