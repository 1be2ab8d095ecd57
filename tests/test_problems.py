"""The general data problems against brute force and on dirty fixtures."""

import itertools
import json
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sedimark.operators import delivery, history, shred
from sedimark.operators.ordered import last_seen, positions, running_totals

HOOKS = "hook_id long, session_id string, hook_event_name string, tool_use_id string, prompt_id string, batch_id long, received_at timestamp, producer string, ident string, message_key string"
LEDGER = "row_id long, event_id string, event_hash string, batch_id long, received_at timestamp, kind string, subject_id string, authority_scope string, valid_from string, valid_until string, event_timestamp timestamp"


def hooks(spark, rows):
    return spark.createDataFrame([(*r, 0, None, "x", "y", "z") for r in rows], HOOKS)


def ledger(spark, rows):
    return spark.createDataFrame([(*r, 0, None, "k", None, None, None, None, None) for r in rows], LEDGER)


def test_ranges_accept_once():
    random.seed(2)
    seen, ranges = set(), delivery.SeenRanges()
    for _ in range(4000):
        n = random.randrange(600)
        assert ranges.accept(n) == (n not in seen)
        seen.add(n)
        assert all(a <= b for a, b in zip(ranges.lo, ranges.hi)) and all(b + 1 < a for b, a in zip(ranges.hi, ranges.lo[1:]))
    assert sum(b - a + 1 for a, b in zip(ranges.lo, ranges.hi)) == len(seen)


def test_copies_of_hooks(spark):
    rows = [
        (1, "s1", "PreToolUse", "call_0001", None), (2, " S1 ", "pre_tool_use", "CALL_0001 ", None), (3, "s1", "PreToolUse", "call_1", None), (4, "s2", "PreToolUse", "call_0001", None),
        (5, "s1", "PostToolUse", "call_0001", None), (6, None, "PreToolUse", "call_0001", None), (7, None, "PreToolUse", "call_0001", None), (8, "s1", "PreToolUse", None, None), (9, "s1", "PreToolUse", None, "p"),
        (10, "s1", "Stop", "call_0001", "p1"), (11, "s1", "stop", None, "P1"), (12, "s1", "Stop", None, " "), (13, "s1", "Stop", None, ""), (14, "s1", "PreToolUse", "toolu_aB", None), (15, "s1", "PreToolUse", "TOOLU_Ab", None), (None, "s1", None, "call_0001", None),
    ]
    got = {tuple(r)[1:] for r in delivery.copy_pairs(delivery.hook_keys(hooks(spark, rows)), "claude_hooks").collect()}
    assert got == {(1, 2), (10, 11), (14, 15)}
    kept = {r.hook_id for r in delivery.once(hooks(spark, rows), delivery.hook_keys(hooks(spark, rows)), "hook_id").collect()}
    assert kept == {1, 3, 4, 5, 6, 7, 8, 9, 10, 12, 13, 14, None}


def test_copies_of_events_fit_versions(spark):
    rows = [(1, "evt_A", "sha256:x"), (2, "a", None), (3, "EVT_a", "X "), (4, "a", "y"), (5, "b", None), (6, "b", None), (7, None, "x"), (8, " ", "x")]
    got = {tuple(r)[1:] for r in delivery.copy_pairs(delivery.ledger_keys(ledger(spark, rows)), "l").collect()}
    assert got == {(1, 2), (1, 3), (2, 3), (2, 4), (5, 6)}
    kept = {r.row_id for r in delivery.once(ledger(spark, rows), delivery.ledger_keys(ledger(spark, rows)), "row_id").collect()}
    assert kept == {1, 4, 5, 7, 8}


def test_copies_against_brute_force(spark):
    random.seed(5)
    rows = [(i, f"s{random.randrange(3)}", random.choice(["Stop", "PreToolUse"]), random.choice([f"call_{random.randrange(40):04d}", f"t{random.randrange(9)}", None]), random.choice(["p", "q", None])) for i in range(400)]
    key = lambda r: (r[1], r[2], r[4] if r[2] == "Stop" else r[3])
    want = {(a[0], b[0]) for a, b in itertools.combinations(rows, 2) if key(a) == key(b) and key(a)[2] is not None}
    assert {tuple(r)[1:] for r in delivery.copy_pairs(delivery.hook_keys(hooks(spark, rows)), "h").collect()} == want


def test_no_rows(spark):
    assert delivery.copy_pairs(delivery.hook_keys(hooks(spark, [])), "h").count() == 0
    assert delivery.once(hooks(spark, []), delivery.hook_keys(hooks(spark, [])), "hook_id").count() == 0
    assert history.versions(history.scope_statements(ledger(spark, []))).count() == 0
    empty = spark.createDataFrame([], "source_table string, record_id long, field_name string, text string")
    assert shred.list_objects(empty).count() == 0 and shred.flat_tables(empty).count() == 0


def brute_versions(rows):
    by = defaultdict(list)
    for e, p, a, u in rows:
        by[e].append((a, u, p))
    out = []
    for e, v in by.items():
        v.sort()
        spans = []
        for i, (a, u, p) in enumerate(v):
            nxt = v[i + 1][0] if i + 1 < len(v) else None
            end = min([x for x in (None if u == -1 else u, nxt) if x is not None], default=-1)
            if spans and spans[-1][0] == p and spans[-1][2] == a:
                spans[-1][2] = end
            else:
                spans.append([p, a, end])
        out += [(e, n, *s) for n, s in enumerate(spans, 1)]
    return set(out)


STATEMENTS = "entity string, payload string, from_ms long, until_ms long, said long, row_id long, run int"


def some_statements(seed):
    random.seed(seed)
    starts = {(random.choice(["hot"] * 5 + ["a", "b", "c"]), random.randrange(300)) for _ in range(260)}
    rows = [(e, random.choice("xy"), a, random.choice([-1, -1, a + random.randrange(1, 6)])) for e, a in starts]
    # earlier words on the same start, in any snapshot, don't hold
    said = [(*r, 10, i, random.randrange(4)) for i, r in enumerate(rows)] + [(e, "z", a, -1, 9, 10_000 + i, random.randrange(4)) for i, (e, _, a, _) in enumerate(rows) if i % 3 == 0]
    return rows, said


@pytest.mark.parametrize("seed", range(4))
def test_versions_against_brute_force(spark, seed):
    rows, said = some_statements(seed)
    got = history.versions(spark.createDataFrame(said, STATEMENTS).repartition(3))
    assert {tuple(r) for r in got.collect()} == brute_versions(rows)


def test_snapshots_are_added_without_sorting_the_old(spark, tmp_path, monkeypatch):
    rows, said = some_statements(7)
    path, bounds = f"file://{tmp_path}/snapshots", [("a", 50), ("hot", 40), ("hot", 160)]
    for run in range(4):
        history.write_snapshots(spark.createDataFrame([r for r in said if r[6] == run], STATEMENTS), bounds, path)
        here = [r for r in said if r[6] <= run]
        last = {}
        for r in sorted(here, key=lambda r: (r[4], r[5])):
            last[r[0], r[2]] = r[:4]
        got = history.numbered(history.merged(spark, path, len(bounds) + 1))
        assert {tuple(r) for r in got.collect()} == brute_versions(list(last.values()))
    assert {tuple(r) for r in got.collect()} == brute_versions(rows)
    # a store that only Spark can read
    monkeypatch.setattr(history, "readable", lambda files: False)
    assert {tuple(r) for r in history.numbered(history.merged(spark, path, len(bounds) + 1)).collect()} == brute_versions(rows)


def test_statements_of_dirty_decisions(spark):
    import datetime as dt

    t = lambda s: dt.datetime(2025, 2, 1, 0, 0, s)
    base = 1738368000000
    rows = [
        (1, "decision", "s", " Team/A ", None, None, t(1)), (2, "decision", "s", "team/b", "", " ", t(2)), (3, "decision", "s", "team/c", str(base + 3000), "2025-02-01 00:00:02", t(3)),
        (4, "decision", "s", "team/d", "2025-02-01T02:00:04.000+02:00", None, t(4)), (5, "decision", "s", "team/e", "2025-02-01T00:00:04.000Z", None, t(5)), (6, "decision", "s", " ", None, None, t(6)),
        (7, "decision", None, "team/a", None, None, t(7)), (8, "claim", "s", "team/a", None, None, t(8)), (9, "decision", "s", "team/f", "not a time", None, t(9)), (10, "decision", "u", "x", None, None, None), (11, "decision", "d", "x", "2025-02-01", "2025-02-02", None),
    ]
    df = spark.createDataFrame([(i, None, None, 0, None, k, s, a, f, u, e) for i, k, s, a, f, u, e in rows], LEDGER)
    got = {tuple(r)[:4] for r in history.scope_statements(df).collect()}
    assert got == {("s", "team/a", base + 1000, -1), ("s", "team/b", base + 2000, -1), ("s", "team/e", base + 4000, -1), ("d", "x", base, base + 86400000)}


def walk(v, path, out, key=None):
    """The cases by plain recursion."""
    if isinstance(v, str):
        try:
            w = json.loads(v) if v.strip()[:1] in ("{", "[") else v
        except ValueError:
            w = v
        v = w
    if isinstance(v, list):
        for i, x in enumerate(v):
            y = shred.unwrapped(x)
            if isinstance(y, dict):
                out.append(f"{path}[{i}]")
            walk(y, f"{path}[{i}]", out)
    elif isinstance(v, dict):
        if key in shred.LIST_KEYS:
            path += "[0]"
            out.append(path)
        for k, x in v.items():
            walk(x, f"{path}.{k}" if path else k, out, k)


def some_json(depth):
    r = random.random()
    if depth == 0 or r < 0.25:
        return random.choice([1, None, "text", "", True, 2.5, "{bad", '{"a": [{}]}', "[1"])
    if r < 0.6:
        return [some_json(depth - 1) for _ in range(random.randrange(4))]
    v = {random.choice(["files", "a", "b.c", "options", "items", "x"]): some_json(depth - 1) for _ in range(random.randrange(4))}
    return json.dumps(v) if random.random() < 0.15 else v


def test_shredding_against_recursion(spark):
    random.seed(11)
    texts = [json.dumps(some_json(5)) for _ in range(500)] + ['{"a": [{}', "plain", "", " ", '"[{}]"', "[NaN, {}]", '{"a": [{}]} x', "null", "[" * 150 + "{}" + "]" * 150, json.dumps({"items": [{"v": i} for i in range(3000)]})]
    df = spark.createDataFrame([("t", i, "f", t, "clash", 7) for i, t in enumerate(texts)] + [("t", -1, "f", None, "clash", 7)], "source_table string, record_id long, field_name string, text string, node_path string, path int")
    got = {(r.record_id, r.node_path) for r in shred.list_objects(df).collect()}
    want = set()
    for i, t in enumerate(texts):
        out = []
        try:
            v = json.loads(t, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError, RecursionError):
            continue
        walk(shred.unwrapped(v), "", out)
        want |= {(i, p) for p in out}
    assert got == want and len(got) > 3000


def test_very_deep_and_very_long():
    deep = shred.parsed("[" * 3000 + "{}" + "]" * 3000)
    assert sum(sum(c.count) for c in shred.shred([deep], False).values()) == 3000
    assert isinstance(shred.parsed('{"a":[' * 40_000 + "]}" * 40_000), dict)
    assert shred.parsed("[" * 1_000_000) is None
    long = shred.shred([shred.parsed(json.dumps([{"v": "x" * 10}] * 50_000))], False)
    assert len(long[shred.ELEMENT,].rep) == 50_000
    # elements of different keys cost a run each, not a row for each of the others
    odd = shred.shred([[{f"k{i}": i} for i in range(20_000)]])
    assert sum(len(c.rep) for c in odd.values()) < 100_000 and {sum(c.count) for p, c in odd.items() if len(p) == 2} == {20_000}


@pytest.mark.parametrize("text", ["[1, -2.5e3, true, false, null, \"\\u00e9\\n\"]", "{}", "[]", ' { "a" : [ { } , [ ] ] , "b" : "" } ', "[1,]", '{"a"}', '{"a":}', "[01]", "[tru]", '{"a":1,}', "", "[", "{", '["a', "[1 2]", "[-]", '{"a":1 "b":2}', '{1:2}', "[+1]", "[1.]", '["\t"]'])
def test_parsing_without_recursion_agrees(text):
    def usual():
        try:
            return json.loads(text)
        except ValueError:
            return "bad"

    def own():
        try:
            start = len(text) - len(text.lstrip())
            value, end = shred._deep(text, start)
            return value if not text[end:].strip() else "bad"
        except ValueError:
            return "bad"

    assert own() == usual()


E = shred.ELEMENT


def test_levels_of_a_column():
    columns = shred.shred([{"a": [{"b": [1, 2]}, {}, {"b": [3]}, {}, {}]}, None, {"a": []}, {"a": [{"b": []}, {"b": [4]}]}])
    b = columns["a", E, "b", E]
    # the second and the last two elements lack b: two of four steps are there
    assert list(zip(b.record, b.rep, b.definition, b.count, b.value)) == [(0, 0, 4, 1, 1), (0, 2, 4, 1, 2), (0, 1, 2, 1, None), (0, 1, 4, 1, 3), (0, 1, 2, 2, None), (3, 0, 2, 1, None), (3, 1, 4, 1, 4)]
    assert [e[:2] for e in shred.entries(b)] == [(0, (0, 0)), (0, (0, 1)), (0, (2, 0)), (3, (1, 0))]
    assert [(e[0], e[1], e[3]) for e in shred.entries(columns["a", E, "b"])] == [(0, (0,), 2), (0, (2,), 1), (3, (0,), 0), (3, (1,), 1)]


TREE = "source_table string, record_id long, field_name string, text string"


@pytest.mark.parametrize(
    "record,paths",
    [
        ({"a.b": [{"x": 1}], "a": {"b": [{"x": 2}, {"x": 3}]}}, {"a\\.b[0]": 1, "a.b[0]": 2, "a.b[1]": 3}),
        ({"x[]": [{"x": 1}]}, {"x\\[\\][0]": 1}),
        ({"m.a]b": [{"x": 1, "n": [{"x": 2}]}]}, {"m\\.a\\]b[0]": 1, "m\\.a\\]b[0].n[0]": 2}),
    ],
)
def test_keys_with_dots_and_brackets(spark, record, paths):
    rows = shred.flat_tables(spark.createDataFrame([("t", 1, "f", json.dumps(record))], TREE)).collect()
    assert {r.node_path: json.loads(r.attributes["x"]) for r in rows if r.node_path} == paths
    at = {r.node_path for r in rows}
    assert len(at) == len(rows) and all(r.parent_path in at for r in rows)


def test_keys_that_read_alike(spark):
    df = spark.createDataFrame([("t", 1, "f", '{"a.b": 1, "a": {"b": 2}}'), ("t", 2, "f", '{"a.b": [{}], "a": {"b": [{}, {}]}, "x[]": [{"k": 1}]}')], TREE)
    assert dict(shred.flat_tables(df).where("record_id = 1").first().attributes) == {"a\\.b": "1", "a.b": "2"}
    assert sorted(r.node_path for r in shred.list_objects(df).collect()) == ["a.b[0]", "a.b[1]", "x[][0]"]


def normal(v, key=None):
    """The record as its tables say it: wrapped texts opened, the single object of a list key a list of one."""
    v = shred.unwrapped(v)
    if isinstance(v, list):
        return [normal(x) for x in v]
    if isinstance(v, dict):
        v = {k: normal(x, k) for k, x in v.items()}
        return [v] if key in shred.LIST_KEYS else v
    return v


def together(rows):
    """A record put together again from its rows."""
    tree = {}

    def put(steps, value):
        at = tree
        for s in steps[:-1]:
            at = at.setdefault(s, {})
        if value is not None or steps[-1] not in at:
            at.setdefault(steps[-1], value) if value == {} else at.__setitem__(steps[-1], value)

    def steps(path):
        out = []
        for m in re.finditer(r"\[(\d*)\]|((?:\\.|[^\\.\[\]])+)|(?:^|(?<=\.))(?=\.|$)", path):
            out.append(re.sub(r"\\(.)", r"\1", m[2]) if m[2] else int(m[1]) if m[1] else "")
        return out

    for r in sorted(rows, key=lambda r: len(r.node_path)):
        base = ["root", *steps(r.node_path)] if r.node_path else ["root"]
        put(base, {})
        for k, v in r.attributes.items():
            put(base + steps(k.removesuffix("[]")) if k.removesuffix("[]") else base, json.loads(v))

    def lists(v):
        if isinstance(v, dict) and v and all(isinstance(k, int) for k in v):
            return [lists(v[i]) for i in range(len(v))]
        return {k: lists(x) for k, x in v.items()} if isinstance(v, dict) else v

    return lists(tree["root"])


def test_records_can_be_put_together_from_their_tables(spark):
    random.seed(13)
    records = [r for _ in range(400) if isinstance(r := shred.unwrapped(some_json(5)), (dict, list))]
    df = spark.createDataFrame([("t", i, "f", json.dumps(r)) for i, r in enumerate(records)], TREE)
    by = defaultdict(list)
    for r in shred.flat_tables(df).collect():
        by[r.record_id].append(r)
    assert len(records) > 200
    for i, r in enumerate(records):
        assert together(by[i]) == normal(r), (r, by[i])


def test_flat_tables_link_parents(spark):
    text = json.dumps({"id": 7, "who": {"name": "n"}, "files": [{"path": "p", "tags": ["x", "y"], "references": [{"to": "q"}, {"to": None}]}, {"path": "r", "references": {"to": "s"}}]})
    df = spark.createDataFrame([("t", 1, "f", text)], "source_table string, record_id long, field_name string, text string")
    got = {r.node_path: (r.table_path, r.parent_path, dict(r.attributes)) for r in shred.flat_tables(df).collect()}
    assert got == {
        "": ("", "", {"id": "7", "who.name": '"n"'}), "files[0]": ("files[]", "", {"path": '"p"', "tags[]": '["x", "y"]'}), "files[1]": ("files[]", "", {"path": '"r"'}),
        "files[0].references[0]": ("files[].references[]", "files[0]", {"to": '"q"'}), "files[0].references[1]": ("files[].references[]", "files[0]", {"to": "null"}), "files[1].references[0]": ("files[].references[]", "files[1]", {"to": '"s"'}),
    }


def test_positions_over_partitions(spark):
    random.seed(1)
    rows = [(random.choice(["hot"] * 6 + ["a", "b"]), random.randrange(10**6), f"v{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(5)
    got = {(r.k, r.v): (r.row_no, r.prev_v) for r in positions(df, "k", ["o", "v"], ["v"]).collect()}
    want = {}
    for k in ("hot", "a", "b"):
        own = sorted((o, v) for kk, o, v in rows if kk == k)
        for n, (_, v) in enumerate(own, 1):
            want[k, v] = (n, own[n - 2][1] if n > 1 else None)
    assert got == want


def test_running_totals_over_partitions(spark):
    random.seed(2)
    rows = [(i, random.randrange(9), None if i % 7 == 0 else 1) for i in random.sample(range(10**6), 2000)]
    got = {r.o: (r.before_a, r.before_b) for r in running_totals(spark.createDataFrame(rows, "o long, a long, b long").repartition(5), ["o"], ["a", "b"]).collect()}
    a = b = 0
    for o, x, y in sorted(rows):
        assert got[o] == (a, b)
        a, b = a + x, b + (y or 0)
    assert running_totals(spark.createDataFrame([], "o long, a long"), ["o"], ["a"]).count() == 0


def test_executors_can_import(spark):
    assert spark.range(3).select(F.col("id")).mapInPandas(lambda it: (b for b in it), "id long").count() == 3


def test_last_seen_over_partitions(spark):
    random.seed(4)
    rows = [(random.choice(["hot"] * 6 + ["a", "b"]), i, f"v{i}" if random.random() < 0.02 else None) for i in random.sample(range(10**6), 3000)]
    df = spark.createDataFrame(rows, "k string, o long, v string").repartition(5)
    for n in (10_000, 37):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        try:
            got = {(r.k, r.o): r.last_v for r in last_seen(df, "k", ["o"], "v").collect()}
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        seen = {}
        for k, o, v in sorted(rows, key=lambda r: (r[0], r[1])):
            assert got[k, o] == seen.get(k), (k, o)
            seen[k] = v or seen.get(k)
    assert last_seen(spark.createDataFrame([], "k string, o long, v string"), "k", ["o"], "v").count() == 0
