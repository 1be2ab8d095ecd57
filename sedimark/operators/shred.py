"""Problem 3: nested JSON records as flat tables that keep parent-child links.

A record is shredded into columns, one per path, of entries (repetition level, definition level, value). A path is a
tuple of steps, a key or ELEMENT for the elements of a list, so that keys may hold dots and brackets. Every value has
an entry in its path's own column: scalars as they are, objects and lists as a mark with their size.

Levels are those of columnar record shredding. The repetition level is the number of the list in which the entry is not
the first; the definition level counts the steps of the path that are there, lists and keys alike. Where an element of a
list lacks a path that the record has elsewhere, the column holds an absent entry, at a list's end too; equal ones in a
row are one run with a count, so a list of n elements with n different keys costs n runs and not n * n entries. A column
has nothing for records that lack its path altogether. Tables are rebuilt from the level sequences alone.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from itertools import groupby
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: keys whose single object counts as a list of one
LIST_KEYS = frozenset(("directories", "files", "references", "added", "removed", "modified", "hunks", "items", "citations", "conflicts", "options", "risks", "edits", "anchors", "todos", "subtasks", "results", "matches", "captures", "steps"))

ELEMENT = 0
Path = tuple[str | int, ...]
_BAD = object()
OBJECT, LIST, SCALAR, ABSENT = "o", "l", "s", "-"


def _constant(_: str) -> None:
    raise ValueError("not JSON")


_decoder = json.JSONDecoder(parse_constant=_constant)
_SPACE = " \t\n\r"
_BLANK = re.compile("[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _deep(text: str, at: int) -> tuple[object, int]:
    """The value that begins at a place and where it ends, without recursion: for texts nested deeper than the usual parser takes."""
    skip = lambda i: _BLANK.match(text, i).end()
    root: list[object] = []
    # open containers with the key that waits for its value
    stack: list[list] = [[root, None]]
    while True:
        c = text[at : at + 1]
        if c in ("{", "["):
            value: object = {} if c == "{" else []
            at = skip(at + 1)
            closed = text[at : at + 1] == ("}" if c == "{" else "]")
            if not closed:
                stack.append([value, None])
                if c == "{":
                    stack[-1][1], at = _key(text, at, skip)
                continue
            at += 1
        elif c == '"':
            value, at = scanstring(text, at + 1, True)
        elif c in _WORDS:
            word, value = _WORDS[c]
            if not text.startswith(word, at):
                raise ValueError("not JSON")
            at += len(word)
        elif c and (m := _NUMBER.match(text, at)):
            value, at = (float(m.group()) if m.group(1) or m.group(2) else int(m.group())), m.end()
        else:
            raise ValueError("not JSON")
        # the value is whole: it goes into its container, which may end with it
        while True:
            box, key = stack[-1]
            if box is root:
                return value, at
            if isinstance(box, dict):
                box[key] = value
            else:
                box.append(value)
            at = skip(at)
            c = text[at : at + 1]
            if c == ",":
                at = skip(at + 1)
                if isinstance(box, dict):
                    stack[-1][1], at = _key(text, at, skip)
                break
            if c != ("}" if isinstance(box, dict) else "]"):
                raise ValueError("not JSON")
            at += 1
            value = stack.pop()[0]


def _key(text: str, at: int, skip) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("not JSON")
    key, at = scanstring(text, at + 1, True)
    at = skip(at)
    if text[at : at + 1] != ":":
        raise ValueError("not JSON")
    return key, skip(at + 1)


def _loads(text: str) -> object:
    start = len(text) - len(text.lstrip(_SPACE))
    try:
        try:
            value, end = _decoder.raw_decode(text, start)
        except RecursionError:
            value, end = _deep(text, start)
    except ValueError:
        return _BAD
    return value if not text[end:].strip(_SPACE) else _BAD


def unwrapped(value: object) -> object:
    """A string that is the whole text of a JSON object or list is that value."""
    if isinstance(value, str) and value.lstrip(_SPACE)[:1] in ("{", "["):
        inner = _loads(value)
        return value if inner is _BAD else inner
    return value


def parsed(text: str | None) -> object:
    """The object or list that a field holds, perhaps wrapped in a string; None for anything else or for ill-formed JSON."""
    if text is None or text.lstrip(_SPACE)[:1] not in ("{", "[", '"'):
        return None
    value = _loads(text)
    value = None if value is _BAD else unwrapped(value)
    return value if isinstance(value, (dict, list)) else None


class Column:
    """Entries of one path over the records of a batch; count is more than one for runs of equal absent entries."""

    __slots__ = ("path", "depth", "record", "rep", "definition", "count", "tag", "value", "_at", "_index")

    def __init__(self, path: Path) -> None:
        self.path, self.depth, self._at, self._index = path, path.count(ELEMENT), -1, ()
        self.record: list[int] = []
        self.rep: list[int] = []
        self.definition: list[int] = []
        self.count: list[int] = []
        self.tag: list[str] = []
        self.value: list[object] = []

    def _add(self, record: int, rep: int, definition: int, tag: str, value: object = None, count: int = 1) -> None:
        self.record.append(record)
        self.rep.append(rep)
        self.definition.append(definition)
        self.count.append(count)
        self.tag.append(tag)
        self.value.append(value)

    def _absent(self, record: int, first: int, level: int, n: int) -> None:
        """n absent elements of the list at level; the first has repetition level `first`. They are defined up to and with that list."""
        defined = -1
        for _ in range(level):
            defined = self.path.index(ELEMENT, defined + 1)
        if first != level:
            self._add(record, first, defined + 1, ABSENT)
            n -= 1
        if n:
            self._add(record, level, defined + 1, ABSENT, None, n)

    def put(self, record: int, index: tuple[int, ...], tag: str, value: object = None) -> None:
        """Appends the entry at index, after the absent entries that lead there."""
        if record != self._at:
            rep = level = 0
        else:
            level = 1
            while self._index[level - 1] == index[level - 1]:
                level += 1
            rep, skipped = level, index[level - 1] - self._index[level - 1] - 1
            if skipped:
                self._absent(record, rep, level, skipped)
        for deeper in range(level + 1, self.depth + 1):
            if index[deeper - 1]:
                self._absent(record, rep, deeper, index[deeper - 1])
                rep = deeper
        self._add(record, rep, len(self.path), tag, value)
        self._at, self._index = record, index

    def end(self, record: int, index: tuple[int, ...], n: int) -> None:
        """Appends what a list of n elements, at index, lacks at its end. The column must have an entry of that list."""
        level = len(index) + 1
        missing = n - 1 - self._index[level - 1]
        if missing:
            self._absent(record, level, level, missing)
            self._index = (*index, n - 1, *([0] * (self.depth - level)))


def shred(records: list[object], leaves: bool = True) -> dict[Path, Column]:
    """Columns by path of parsed records. Without leaves only the lists' own columns, which is column pruning."""
    columns: dict[Path, Column] = {}

    def put(path: Path, r: int, index: tuple[int, ...], tag: str, value: object, seen: list[set[Column]]) -> None:
        c = columns.get(path)
        if c is None:
            c = columns[path] = Column(path)
        c.put(r, index, tag, value)
        if seen:
            seen[-1].add(c)

    for r, root in enumerate(records):
        if root is None:
            continue
        # columns that have entries of the lists that are open
        seen: list[set[Column]] = []
        if leaves:
            put((), r, (), OBJECT if isinstance(root, dict) else LIST, len(root), seen)
        stack: list[tuple[object, Path, tuple[int, ...]]] = [(root, (), ())]
        while stack:
            value, path, index = stack.pop()
            if value is _BAD:
                # the list at path and index has been gone through
                own = seen.pop()
                if index[-1] > 1:
                    for c in own:
                        c.end(r, index[:-1], index[-1])
                if seen:
                    small, large = sorted((own, seen[-1]), key=len)
                    large |= small
                    seen[-1] = large
                continue
            children: list[tuple[object, Path, tuple[int, ...]]] = []
            if isinstance(value, dict):
                for k, v in value.items():
                    if isinstance(v, str):
                        v = unwrapped(v)
                    if isinstance(v, dict):
                        if k in LIST_KEYS:
                            at, one = (*path, k, ELEMENT), (*index, 0)
                            put(at, r, one, OBJECT, len(v), seen)
                            children.append((v, at, one))
                        else:
                            if leaves:
                                put((*path, k), r, index, OBJECT, len(v), seen)
                            children.append((v, (*path, k), index))
                    elif isinstance(v, list):
                        if leaves:
                            put((*path, k), r, index, LIST, len(v), seen)
                        if v:
                            children.append((v, (*path, k), index))
                    elif leaves:
                        put((*path, k), r, index, SCALAR, v, seen)
            else:
                at = (*path, ELEMENT)
                seen.append(set())
                stack.append((_BAD, path, (*index, len(value))))
                for i, v in enumerate(value):
                    if isinstance(v, str):
                        v = unwrapped(v)
                    one = (*index, i)
                    if isinstance(v, (dict, list)):
                        put(at, r, one, OBJECT if isinstance(v, dict) else LIST, len(v), seen)
                        if v:
                            children.append((v, at, one))
                    else:
                        put(at, r, one, SCALAR, v if leaves else None, seen)
            children.reverse()
            stack.extend(children)
    return columns


def entries(c: Column) -> Iterator[tuple[int, tuple[int, ...], str, object]]:
    """(record, index, tag, value) of a column's present entries, from its level sequence."""
    at, full = [0] * c.depth, len(c.path)
    for record, rep, definition, count, tag, value in zip(c.record, c.rep, c.definition, c.count, c.tag, c.value):
        if rep == 0:
            at = [0] * c.depth
        else:
            at[rep - 1] += count
            for deeper in range(rep, c.depth):
                at[deeper] = 0
        if definition == full and tag != ABSENT:
            yield record, tuple(at), tag, value


def node_path(path: Path, index: tuple[int, ...], escaped: bool = False) -> str:
    """("files", ELEMENT, "references", ELEMENT) at (2, 0) is files[2].references[0]. Escaped, a key's dots, brackets and backslashes have a backslash before them."""
    out, n = "", 0
    for step in path:
        if step is ELEMENT:
            out += f"[{index[n]}]"
            n += 1
        else:
            out += ("." if out else "") + (re.sub(r"([\\.\[\]])", r"\\\1", step) if escaped else step)
    return out


def table_name(path: Path) -> str:
    """files[].references[] as a table's name, keys escaped."""
    return re.sub(r"(?<!\\)\[\d+\]", "[]", node_path(path, (0,) * len(path), True))


def parent_table(path: Path) -> Path:
    """The table (list path) of the nearest object around a path; () is the record itself."""
    n = len(path)
    while n and path[n - 1] is ELEMENT:
        n -= 1
    while n and path[n - 1] is not ELEMENT:
        n -= 1
    return path[:n]


def rebuilt(columns: dict[Path, Column]) -> Iterator[tuple[int, Path, tuple[int, ...], dict[str, object]]]:
    """(record, table path, index, attributes) of every object row, from the columns alone; a record itself is a row too.

    Attributes are the scalars below the row by their escaped paths from there; a list of scalars only is one attribute
    whose name ends with [], and empty objects and lists are attributes. Objects that aren't in a list belong to the
    object around them.
    """
    rows: dict[tuple[int, Path, tuple[int, ...]], dict[str, object]] = {}
    for path, c in columns.items():
        if not path or path[-1] is ELEMENT:
            for r, index, tag, n in entries(c):
                if tag == OBJECT or not path:
                    rows.setdefault((r, path, index), {"[]": []} if tag == LIST and not n else {})
    for path, c in columns.items():
        table = parent_table(path)
        depth, below = sum(s is ELEMENT for s in table), path[len(table) :]
        if not below:
            continue
        in_list = below[-1] is ELEMENT
        alone = in_list and below.count(ELEMENT) == 1
        for (r, upto), same in groupby(entries(c), lambda e: (e[0], e[1][:-1] if in_list else e[1])):
            row = rows.setdefault((r, table, upto[:depth]), {})
            some = list(same)
            if alone and all(tag == SCALAR for _, _, tag, _ in some):
                row[node_path(below[:-1], (), True) + "[]"] = [value for _, _, _, value in some]
                continue
            for _, index, tag, value in some:
                if tag == SCALAR:
                    row[node_path(below, index[depth:], True)] = value
                elif not value and (tag == LIST or not in_list):
                    row[node_path(below, index[depth:], True)] = {} if tag == OBJECT else []
    for (r, table, index), row in rows.items():
        yield r, table, index, row


def _fields(df: DataFrame, source: str, row_id: str, names: list[str]) -> DataFrame:
    """The JSON texts as rows (source_table, record_id, field_name, text); texts that can't hold a list are left out early."""
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in names])).alias("f")
    return df.select(F.lit(source).alias("source_table"), F.col(row_id).alias("record_id"), one).select("source_table", "record_id", "f.field_name", "f.text").where("text is not null and (contains(text, '[') or contains(text, '{'))")


def json_fields(ledger: DataFrame, hooks: DataFrame) -> DataFrame:
    """The fields of problem 3."""
    return _fields(ledger, "ledger_events", "row_id", ["data_json"]).union(_fields(hooks, "claude_hooks", "hook_id", ["tool_input", "tool_response"]))


def _batches(batches: Iterator[pa.RecordBatch], leaves: bool) -> Iterator[tuple[list, list, list, dict[Path, Column]]]:
    sys.set_int_max_str_digits(0)
    for b in batches:
        texts = b.column("text").to_pylist()
        yield b.column("source_table").to_pylist(), b.column("record_id").to_pylist(), b.column("field_name").to_pylist(), shred([parsed(t) for t in texts], leaves)


def list_objects(fields: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, node_path) of every object that is an element of a list.

    Paths aren't escaped here: objects of one record whose paths read the same (a key "a.b" beside a key "b" in "a") are one row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, ids, names, columns in _batches(batches, False):
            out: tuple[list, list, list, list] = ([], [], [], [])
            odd: set[tuple[int, str]] = set()
            shapes: dict[str, int] = {}
            for path in columns:
                s = table_name(path).replace("\\", "")
                shapes[s] = shapes.get(s, 0) + 1
            for path, c in columns.items():
                alike = shapes[table_name(path).replace("\\", "")] > 1 or any(s is not ELEMENT and ("[" in s or "]" in s) for s in path)
                for r, index, tag, _ in entries(c):
                    if tag == OBJECT:
                        at = node_path(path, index)
                        if alike:
                            if (r, at) in odd:
                                continue
                            odd.add((r, at))
                        for x, v in zip(out, (source[r], ids[r], names[r], at)):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())], names=["source_table", "record_id", "field_name", "node_path"])

    return fields.mapInArrow(run, "source_table string, record_id long, field_name string, node_path string")


def flat_tables(fields: DataFrame) -> DataFrame:
    """All tables, one row per object: (source_table, record_id, field_name, table_path, node_path, parent_path, attributes).

    table_path names the table ('' is the records' own), parent_path is the node_path of the row it belongs to; keys are
    escaped in all of them. attributes maps the paths of the object's scalars to their JSON text; a list of scalars only
    is one JSON list, other scalars in lists have their place in the name, empty objects and lists stay as such. Objects
    that aren't in a list are columns of the object around them. Every record that is an object or a list has a row.
    """
    schema = "source_table string, record_id long, field_name string, table_path string, node_path string, parent_path string, attributes map<string,string>"
    names = ["source_table", "record_id", "field_name", "table_path", "node_path", "parent_path", "attributes"]
    kind = pa.map_(pa.string(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source, ids, fields_, columns in _batches(batches, True):
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for r, table, index, row in rebuilt(columns):
                parent = parent_table(table)
                text = [(k, json.dumps(v, ensure_ascii=False)) for k, v in row.items()]
                for x, v in zip(out, (source[r], ids[r], fields_[r], table_name(table), node_path(table, index, True), node_path(parent, index[: sum(s is ELEMENT for s in parent)], True), text)):
                    x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.int64(), *[pa.string()] * 4, kind))], names=names)

    return fields.mapInArrow(run, schema)
