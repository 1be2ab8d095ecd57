"""Graph, quality, exports and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from sedimark import __main__ as cli
from sedimark.operators import graph as G
from sedimark.sinks import export
from sedimark.sources.log import published


def test_directories_and_nodes(spark):
    files = spark.createDataFrame([("r", "a/b/c.js"), ("r", "x.md")], "repo string, path string")
    refs = spark.createDataFrame([("r", "a/b/c.js", "./x", "x.md"), ("r", "a/b/c.js", "./gone", "gone.js"), ("r", "x.md", "node:fs", None), ("r", "x.md", None, None)], "repo string, path string, specifier string, target string")
    nodes = {(r.type, r.name) for r in G.project_nodes(files, refs).collect()}
    assert nodes == {("project.directory", "."), ("project.directory", "a"), ("project.directory", "a/b"), ("project.file", "a/b/c.js"), ("project.file", "x.md"), ("project.unresolved", "./gone"), ("project.external", "node:fs")}
    ids = {r.id for r in G.project_nodes(files, refs).collect()}
    edges = G.project_edges(files, refs).collect()
    assert len(edges) == 2 + 2 + 3 and {e.source for e in edges} | {e.target for e in edges} <= ids


def test_specifiers_are_resolved_in_order(spark):
    files = spark.createDataFrame([("r", p) for p in ("src/a.ts", "src/a.js", "src/lib/index.js", "top.json")], "repo string, path string")
    deep = [("r", "a/b/c/d/e/f/g/h/i/j.js", "../" * 9 + "top"), ("r", "a/m.js", "../../../top"), ("r", "a/b/m.js", ".././../src//./a")]
    got = {r.specifier: r.target for r in G.resolved(spark.createDataFrame(deep, "repo string, path string, specifier string"), files).collect()}
    assert got == {"../" * 9 + "top": "top.json", ".././../src//./a": "src/a.js"}
    refs = spark.createDataFrame([("r", "src/m.js", s) for s in ("./a", "./lib", "../top", "../no", "pkg")], "repo string, path string, specifier string")
    assert {(r.specifier, r.target) for r in G.resolved(refs, files).collect()} == {("./a", "src/a.js"), ("./lib", "src/lib/index.js"), ("../top", "top.json")}


def test_changed_together(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b"), (3, "c"), (4, "a"), (4, "a")], "id long, path string")
    got = {x.id: x.score for x in G.changed_together(r, spark.createDataFrame([("a",)], "path string")).collect()}
    assert got == {1: 1.5, 2: 0.5, 4: 1.0}


def test_context_quality(spark):
    df = spark.createDataFrame([(["a", "b", "b"], ["a"], True, 100, 25), (["c"], None, False, 100, 25)], "required array<string>, recalled array<string>, completed boolean, baseline_tokens long, tokens long")
    r = G.context_quality(df).first()
    assert r.decision_recall == pytest.approx(0.3333) and r.token_reduction == 0.75 and r.completion == 0.5 and r.conflict_detection is None and r.cost_reduction is None


def test_exports(spark, tmp_path):
    ev = spark.createDataFrame([("e1", "decision", "T *x*", "a\nb", "r", "verified", 0), ("e2", "note", None, None, None, None, 86_400_000), ("e3", "note", "u", "v", None, None, None)], "eid string, kind string, title string, body string, repo string, confidence string, ts long")
    text = {r.path: r.text for r in export.concepts(ev).collect()}
    assert text["events/e1.md"].endswith("# T \\*x\\*\n\n> a\n> b") and "time: 1970-01-01T00:00:00.000Z" in text["events/e1.md"] and len(text) == 3
    export.write_bundle(ev, str(tmp_path / "b"))
    assert spark.read.text(str(tmp_path / "b" / "index")).count() == 2
    d = export.bundle_digest(export.concepts(ev))
    assert d.collect() == export.bundle_digest(export.concepts(ev).repartition(3)).orderBy(F.col("folder")).collect() or d.count() == 3
    assert "&lt;b&gt;" in export.page({"events": 1}, [{"eid": "e", "title": "<b>"}])


def test_command_line(spark, tmp_path, capsys):
    assert cli.main(["list"]) == 0 and "p4_found" in capsys.readouterr().out
    tables = "/root/testdata/sf0.001"
    assert cli.main(["run", "conflict_pairs", "--tables", tables, "--out", str(tmp_path / "o")]) == 0 and spark.read.parquet(str(tmp_path / "o")).columns == ["a", "b"]
    assert cli.main(["build", "--tables", tables, "--out", str(tmp_path / "v")]) == 0 and published(spark, str(tmp_path / "v"), "nodes").count() > 0
    capsys.readouterr()
    assert cli.main(["query", "token budget", "--tables", tables, "--max-chars", "3000"]) == 0
    pack = json.loads(capsys.readouterr().out)
    assert 0 < pack["used_chars"] <= 3000 and pack["manifest"].startswith("sha256:")
