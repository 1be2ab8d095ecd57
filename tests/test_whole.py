"""That operators do the whole job where they once were cut off."""

import random

import pytest
from pyspark.sql import functions as F

from sedimark.operators import packs
from sedimark.operators.ordered import greedy_skip
from sedimark.operators.similar import audit_text, similar_classes
from sedimark.plans import base
from sedimark.plans.base import AS_OF, QUERY
from sedimark.plans.context import compile_context
from sedimark.plans.evaluation import BUDGETS, budget_curve, context_pack, mmr_diverse
from sedimark.plans.ranking import Ask, rank_events, selected
from sedimark.plans.readmodel import BUDGET, budget_greedy_skip, id_buckets

WHEN = "2025-08-01 00:00:00"


def ledger(spark, folder, rows, own=None):
    """Tables of a ledger of rows(event_id, repository_id, second, kind, body, subject_id); own are expressions of other columns by row_id."""
    columns = "row_id long, event_id string, repository_id string, session_id string, event_timestamp timestamp, kind string, title string, body string, confidence string, authority_scope string, authority_rank int, subject_id string, valid_from string, valid_until string, event_hash string, data_json string"
    df = spark.createDataFrame([(i, e, r, s, k, b, x) for i, (e, r, s, k, b, x) in enumerate(rows)], "row_id long, event_id string, repository_id string, s long, kind string, body string, subject_id string")
    named = {"session_id": "null", "event_timestamp": f"timestamp_seconds(unix_seconds(timestamp '{WHEN}') + s)", "title": "''", "confidence": "'verified'", "authority_scope": "'team/platform'", "authority_rank": "50", "valid_from": "null", "valid_until": "null", "event_hash": "null", "data_json": "null"} | (own or {})
    schema = [c.split() for c in columns.split(", ")]
    df.selectExpr(*[f"cast({named.get(n, n)} as {t}) as {n}" for n, t in schema]).write.parquet(f"{folder}/ledger_events.parquet")
    spark.sql("select distinct repository_id, 'permanent' as retention_class from {r}", r=df).write.parquet(f"{folder}/repositories.parquet")
    return str(folder)


def fitting(sizes, budget):
    used, kept = 0, []
    for i, t in enumerate(sizes):
        if used + t <= budget:
            used += t
            kept.append(i)
    return used, kept


def test_greedy_skip_carries_the_budget_over_partitions(spark):
    random.seed(5)
    groups = {k: [random.choice([0, 1, 3, 7, 20, 45, 90, 400]) for _ in range(n)] for k, n in {"a": 3, "hot": 3000, "m": 1, "z": 250}.items()}
    rows = [(k, i, t) for k, ts in groups.items() for i, t in enumerate(ts)]
    random.shuffle(rows)
    budgets = [100, 2000, 30000]
    got = greedy_skip(spark.createDataFrame(rows, "k string, i long, t long").repartition(7), "k", ["i"], "t", budgets).collect()
    assert len(got) == len(rows)
    for k, ts in groups.items():
        for j, b in enumerate(budgets):
            assert sorted(r.i for r in got if r.k == k and r.kept[j]) == fitting(ts, b)[1], (k, b)


def test_budgets_see_more_than_a_hundred_rows(spark, tmp_path):
    # the first are too big but one, later ones fit
    sizes = [1500] + [9000] * 120 + [400, 200, 0, 90, 30, 0] + [5000] * 30 + [8, 0]
    rows = [(f"e{i:05d}", "repo_00001", -i, "decision", "x" * 4 * t, "s1") for i, t in enumerate(sizes)]
    d = ledger(spark, tmp_path / "t", rows)
    used, kept = fitting(sizes, BUDGET)
    assert max(kept) > 100
    got = sorted(budget_greedy_skip(spark, d).collect(), key=lambda r: r.place)
    assert [(r.repo, r.used, r.n, r.place, r.eid) for r in got] == [("repo_00001", used, len(kept), p, f"e{i:05d}") for p, i in enumerate(kept)]
    want = {b: fitting(sizes, b) for b in BUDGETS}
    assert {r.budget: (r.used, r.n) for r in budget_curve(spark, d).collect()} == {b: (u, len(k)) for b, (u, k) in want.items()}


def test_audited_text_keeps_all_scripts(spark):
    texts = {"Déjà vu": "déjà vu", "проверка Журнала": "проверка журнала", "記録の確認, ok": "記録の確認 ok", "v 1.2.3 at deadbeef1, a_b": "v <num> at <sha> a_b", "see https://x.org/a?b=1\u3000next": "see <url> next", "": "", None: ""}
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "t string, w string")
    assert [r.g for r in df.select(audit_text(F.col("t")).alias("g")).collect()] == list(texts.values())
    docs = ["один два три четыре пять шесть", "семь восемь девять десять ноль сто", "один два три четыре пять, шесть"]
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_classes(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (0, 0)}


def test_packs_hold_admitted_current_events_only(spark, tmp_path):
    month = 40 * 86_400
    rows = [("old", "repo_00001", 0, "claim", QUERY, "s"), ("new", "repo_00001", 1, "claim", QUERY, "s"), ("future", "repo_00001", month, "claim", QUERY, "s"), ("elsewhere", "repo_00999", 0, "claim", QUERY, "s"), ("typo", "repo_00001", 2, "claim", "stalepolicy tokens, ledgers", "s"), ("next", "repo_00001", 3, "claim", "zzz", "s")]
    d = ledger(spark, tmp_path / "t", rows)
    e = spark.createDataFrame([("1", "new", "supersedes", "old"), ("2", "next", "supports", "new")], "edge_id string, source_event_id string, edge_type string, target_id string")
    e.withColumn("payload_json", F.lit(None).cast("string")).write.parquet(f"{d}/event_edges.parquet")
    # what only the fuzzy or the graph list finds is there too
    assert [r.eid for r in context_pack(spark, d).orderBy("place").collect()] == ["new", "typo", "next"]
    assert {r.eid for r in mmr_diverse(spark, d).collect()} == {"new", "typo", "next"}


def test_diverse_looks_past_a_thousand_copies(spark):
    rows = [(f"c{i:04d}", 1, 10.0, ["x", "y"]) for i in range(1500)] + [("z", 1, 9.0, ["z"])]
    got = packs.diverse(spark.createDataFrame(rows, "eid string, ts long, score double, terms array<string>"), limit=3).orderBy("rank").collect()
    assert [r.eid for r in got] == ["c0000", "z", "c0001"]


def with_edges(spark, d, rows=()):
    e = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "edge_id string, source_event_id string, edge_type string, target_id string")
    e.withColumn("payload_json", F.lit(None).cast("string")).write.parquet(f"{d}/event_edges.parquet")
    return d


def test_nothing_forbidden_comes_back_through_a_relation(spark, tmp_path):
    """Ten is admitted and refers to eleven, which is restricted; the others are of another repository, expired, stale and in the future."""
    at = "timestamp_millis(%d)" % AS_OF
    rows = [(f"e{i}", "repo_00999" if i == 12 else "repo_00002" if i == 13 else "repo_00001", 0, "claim", "poison sentinel", "s") for i in range(10, 16)]
    own = {
        "authority_scope": "case row_id when 1 then 'org/secret' else 'team/platform' end", "valid_until": f"case row_id when 4 then '{AS_OF}' end",
        "event_timestamp": f"case row_id when 5 then {at} + interval 1 second when 3 then {at} - interval 30 days else {at} - interval 1 day end",
    }
    d = with_edges(spark, ledger(spark, tmp_path / "t", rows, own), [("e10", "references", x) for x in ("e11", "e12", "e13", "e14", "e15")])
    spark.sql("select 'repo_00001' repository_id, 'permanent' retention_class union all select 'repo_00002', 'session' union all select 'repo_00999', null").write.mode("overwrite").parquet(f"{d}/repositories.parquet")
    ask = Ask(query="poison sentinel")
    for a in (ask, Ask(query="poison sentinel", reciprocal=True), Ask(query="poison sentinel", diversity=0.5), Ask(query="")):
        assert {r.eid for r in selected(rank_events(spark, d, a), spark, d).collect()} == {"e10"}
    pack = compile_context(spark, d, ask)
    assert [x["eid"] for x in pack["items"]] == ["e10"] and pack["header"]["filters"] == {"expired": 1, "future": 1, "stale": 1, "unauthorized": 2} and pack["items"][0]["reason"].startswith("bm25#1")


def test_asking_for_history_coverage_and_conflicts(spark, tmp_path):
    rows = [(e, "repo_00001", i, "claim", b, "s") for i, (e, b) in enumerate([("old", "alpha beta"), ("new", "alpha beta gamma"), ("other", "alpha delta"), ("far", "nothing")])]
    d = with_edges(spark, ledger(spark, tmp_path / "t", rows), [("new", "supersedes", "old"), ("new", "contradicts", "other"), ("other", "contradicts", "new")])
    eids = lambda a: [x["eid"] for x in compile_context(spark, d, a)["items"]]
    assert set(eids(Ask(query="alpha beta"))) == {"new", "other"} and set(eids(Ask(query="alpha beta", history=True))) == {"old", "new", "other"}
    assert set(eids(Ask(query="alpha beta, and old"))) == {"old", "new", "other"}
    pack = compile_context(spark, d, Ask(query="alpha beta", limit=1))
    assert len(pack["items"]) == 1 and pack["header"]["conflicts"] == [["new", "other"]] and pack["header"]["exclusions"] == [["old", "new"]]
    with pytest.raises(LookupError):
        compile_context(spark, d, Ask(query="alpha omega"), minimum_coverage="direct")
    more = compile_context(spark, d, Ask(query="omega"), expand=lambda q: ["alpha"])
    assert more["header"]["query"] == "omega" and more["header"]["added_terms"] == 1 and len(more["items"]) == 2
    with pytest.raises(ValueError):
        compile_context(spark, d, Ask(query="x"), expand=lambda q: ["y"] * 17)
    budget = compile_context(spark, d, Ask(query="alpha beta"), tokens=packs.token_plan(4000))
    assert budget["tokens"]["content"] > 0 and sum(budget["tokens"].values()) <= 3600
    with pytest.raises(ValueError):
        tight = [packs.Reservation("framing", 0, 10, 10, 100, "error"), packs.Reservation("citations", 0, 500, 900, 90), packs.Reservation("content", 0, 100, 900, 50)]
        compile_context(spark, d, Ask(query="alpha beta"), tokens=packs.token_plan(1000, reservations=tight))


def test_data_is_searched_and_shown(spark, tmp_path):
    rows = [(f"e{i}", "repo_00001", i, "claim", "text", "s") for i in range(4)]
    data = ['{"note": "zebra crossing", "n": 17, "deep": {"x": "quagga"}, "no": null}', '"{\\"note\\": \\"zebra\\"}"', '{"projectStructure": {"files": [{"path": "src/zebra.py", "language": "python", "references": [{"type": "imports", "specifier": "okapi"}]}]}}', "{broken zebra"]
    quoted = ", ".join("'" + x.replace("\\", "\\\\") + "'" for x in data)
    d = with_edges(spark, ledger(spark, tmp_path / "t", rows, {"data_json": f"element_at(array({quoted}), cast(row_id as int) + 1)"}))
    found = lambda q: {x["eid"] for x in compile_context(spark, d, Ask(query=q))["items"]}
    assert found("zebra") == {"e0", "e1", "e2"} and found("okapi") == {"e2"} and found("quagga") == {"e0"}
    item = compile_context(spark, d, Ask(query="zebra python"))["items"][0]
    assert item["eid"] == "e2" and item["excerpt"] == "1 files\nsrc/zebra.py"


def test_the_index_gives_the_scores_of_the_texts(spark, tmp_path):
    from sedimark.functions.text import query_terms
    from sedimark.operators import ranking as R
    from sedimark.plans.ranking import search_text
    from sedimark.sinks import index

    random.seed(6)
    words = ["alpha", "beta", "gamma", "delta", "of"]
    rows = [(f"e{i:03d}", "repo_00001", i, "claim", " ".join(random.choice(words) for _ in range(random.randrange(12))), "s") for i in range(80)]
    d = ledger(spark, tmp_path / "t", rows)
    ev = base.events(spark, d)
    index.write_index(ev, search_text(), str(tmp_path / "index"))
    q = query_terms("alpha of gamma")
    counted = R.counted(ev, search_text(), q)
    want = {r.eid: r.score for r in R.bm25(counted, R.corpus_stats(counted, q), q, False).collect()}
    found = index.bm25(spark, str(tmp_path / "index"), q)
    assert {r.eid: r.score for r in found.collect()} == pytest.approx(want, abs=2e-6) and len(want) > 40
    assert "body" not in found._jdf.queryExecution().executedPlan().toString()
    assert not index.is_stale(spark, str(tmp_path / "index"), ev) and index.is_stale(spark, str(tmp_path / "index"), ev.where("eid <> 'e007'"))
    index.write_by_id(ev.select("eid", "seq"), str(tmp_path / "ids"))
    got = index.by_id(spark, str(tmp_path / "ids"), ["e003", "e070", "nothing"])
    assert {(r.eid, r.seq) for r in got.collect()} == {("e003", 3), ("e070", 70)}
    assert "PartitionFilters: [" in got._jdf.queryExecution().executedPlan().toString() and "bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_dependencies_against_a_resolver(spark):
    from sedimark.operators import readmodel as M

    cited = spark.createDataFrame([("a", "1", "r", "x", 1), ("a", "2", "r", "y", 2), ("b", "1", None, "x", 1), ("c", "1", "r", "x", 1), ("d", "1", "r", None, 1)], "name string, version string, repo string, hash string, seq long")
    known = spark.createDataFrame([("a", "1", "r", "x"), ("a", "2", "r", "y"), ("b", "1", None, "z"), ("d", "1", "r", "q")], "name string, version string, repo string, hash string")
    assert {(r.name, r.status) for r in M.dependency_freshness(cited, known).collect()} == {("a", "current"), ("b", "changed"), ("c", "missing"), ("d", "changed")}
    assert {r.status for r in M.dependency_freshness(cited, None).collect()} == {"unverified"}


def test_a_query_reads_the_columns_it_needs(spark, tmp_path):
    d = ledger(spark, tmp_path / "t", [("a", "repo_00001", 0, "claim", "b", "s")])
    plan = id_buckets(spark, d)._jdf.queryExecution().executedPlan().toString()
    assert "body" not in plan and "title" not in plan and "data_json" not in plan
    assert "body" not in base.events(spark, d).select("kind")._jdf.queryExecution().executedPlan().toString()


def test_prefixes_of_two_methods(spark):
    from sedimark.operators import evaluation as E

    rows = [("a", "s", 1, True, 5), ("a", "s", 2, True, 5), ("a", "s", 3, False, 90), ("b", "s", 1, False, 90), ("b", "s", 2, True, 5), ("b", "s", 3, True, 5)]
    df = spark.createDataFrame(rows, "method string, key string, rank int, required boolean, tokens int")
    got = {r.method: tuple(r)[1:] for r in E.compared(df, "key").collect()}
    assert got == {"a": (1, 1, 1, 10, 100, 0.9), "b": (1, 1, 0, 100, 100, 0.0)}
    assert tuple(E.winner(E.compared(df, "key")).first()) == ("winner", "a") and tuple(E.winner(E.compared(df, "key", 2)).first()) == ("none", None)
    assert tuple(E.winner(E.compared(df.limit(0), "key")).first()) == ("none", None)
    assert {tuple(r) for r in E.exact_top(df.where("method = 'a'"), "key").collect()} == {("s", 2, True)}
