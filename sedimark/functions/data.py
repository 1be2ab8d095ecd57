"""Searchable text of an event's JSON data."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def opened(c: Column) -> Column:
    """The JSON object or list that a field holds, perhaps wrapped in a string, as text; null for anything else."""
    # the first character tells what has to be parsed, so that each text is parsed once and only wrapped ones twice
    whole, bare = lambda x: F.try_parse_json(x).isNotNull(), lambda x: F.regexp_like(x, F.lit(r"^\s*[{\[]"))
    inner = F.when(whole(c), F.get_json_object(c, "$"))
    return F.when(bare(c), F.when(whole(c), c)).when(F.startswith(F.ltrim(c), F.lit('"')), F.when(bare(inner) & whole(inner), inner))


def elements(raw: Column) -> Column:
    """Elements of a JSON list as texts, an empty list for anything else; one object is a list of one."""
    one = F.startswith(F.ltrim(raw), F.lit("{"))
    return F.coalesce(F.when(one, F.array(raw)).otherwise(F.from_json(raw, _STRINGS)), F.array().cast(_STRINGS))


def primitive_lines(j: Column) -> Column:
    """Keys and values of an object's own strings, numbers and booleans, one line each; '' if there are none."""
    entries = F.map_entries(F.from_json(j, "map<string,variant>"))
    kind = F.schema_of_variant
    own = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.regexp_like(kind(e["value"]), F.lit("^(OBJECT|ARRAY|VOID)")))
    lines = F.transform(own, lambda e: F.concat(e["key"], F.lit(" "), F.coalesce(F.try_variant_get(e["value"], "$", "string"), F.lit(""))))
    return F.coalesce(F.array_join(lines, "\n"), F.lit(""))


def project_lines(j: Column) -> Column:
    """Paths and languages of the files of a project's snapshot and what they refer to, one line each."""
    files = elements(F.get_json_object(j, "$.projectStructure.files"))
    path = lambda f: F.get_json_object(f, "$.path")
    own = F.transform(F.filter(files, lambda f: path(f).isNotNull()), lambda f: F.concat(F.lit("project file "), path(f), F.lit(" "), F.coalesce(F.get_json_object(f, "$.language"), F.lit(""))))
    refs = F.flatten(F.transform(files, lambda f: elements(F.get_json_object(f, "$.references"))))
    to = lambda r: F.get_json_object(r, "$.specifier")
    links = F.transform(F.filter(refs, lambda r: to(r).isNotNull()), lambda r: F.concat(F.coalesce(F.get_json_object(r, "$.type"), F.lit("reference")), F.lit(" "), to(r)))
    # most data has no snapshot and isn't looked into
    return F.when(F.contains(j, F.lit("projectStructure")), F.coalesce(F.array_join(F.concat(own, links), "\n"), F.lit(""))).otherwise("")


def json_words(j: Column) -> Column:
    """All keys and scalars of a JSON text at any depth, without its signs; for terms only, since order and escapes aren't kept."""
    bare = F.regexp_replace(j, r"\\([nrtbf\"/\\])", " ")
    bare = F.regexp_replace(bare, r"([:,\[]\s*)null\b", "$1")
    return F.coalesce(F.regexp_replace(bare, r"[{}\[\]\",:]", " "), F.lit(""))
