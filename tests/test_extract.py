"""Extraction, redaction by keys, limits and adapters."""

from pyspark.sql import functions as F

from sedimark.functions import extract as X
from sedimark.sources import adapters

DIFF = "diff --git a/src/core/a.py b/src/core/a.py\n--- a/src/core/a.py\n+++ b/src/core/a.py\n@@ -1 +1 @@\n-def old_name(x):\n+def NewName(x): return my_value\n unchanged_word\ndiff --git a/b.md b/b.md\n"


def test_diffs(spark):
    r = spark.createDataFrame([(DIFF, None)], "d string, n string").select(X.changed_files(F.col("d")).alias("f"), X.changed_symbols(F.col("d")).alias("s"), X.changed_files(F.col("n")).alias("nf"), X.changed_symbols(F.col("n")).alias("ns"), X.module_scope(F.lit("src/core/a.py")).alias("m"), X.module_scope(F.lit("b.md")).alias("t")).first()
    assert r.f == ["b.md", "src/core/a.py"] and r.s == ["newname", "old_name"] and r.nf == [] and r.ns == [] and r.m == "src/core" and r.t == "."


def test_names_in_diffs(spark):
    d = "diff --git a/a b.txt b/a b.txt\n@@ -1,2 +1,2 @@ def Outer(self):\n+    call_it(x)\n-async def gone():\n@@ -9 +9 @@ if (check_this(y) and go(z))\n+x = 1\r\ndiff --git a/c b/c\r\n"
    r = spark.createDataFrame([(d,)], "d string").select(X.changed_files(F.col("d")).alias("f"), X.changed_symbols(F.col("d")).alias("s"), *[X.module_scope(F.lit(p)).alias(f"m{i}") for i, p in enumerate(["a", "/a/", "a/b", "a/b/c/d"])]).first()
    assert r.f == ["a b.txt", "c"] and r.s == ["check_this", "gone", "outer"] and (r.m0, r.m1, r.m2, r.m3) == (".", ".", "a", "a/b")


def test_places_and_urls(spark):
    line, column = X.line_and_column(F.col("t"), F.locate("x", F.col("t")))
    got = [tuple(r) for r in spark.createDataFrame([("x",), ("a\nbcx",), ("\n\nx",)], "t string").select(line, column).collect()]
    assert got == [(1, 1), (2, 3), (3, 1)]
    urls = ["HTTPS://u:p@Example.org:8443/a?b=1#c", "ftp://x/y", "not a url", None]
    assert [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(X.safe_url(F.col("u"))).collect()] == ["https://example.org:8443/a?b=1", None, None, None]
    assert [r[0] for r in spark.createDataFrame([("abcdef",), ("ab",), (None,)], "t string").select(X.without_near_text(F.col("t"), 3)).collect()] == ["abc... [3 more]", "ab", None]


def test_secret_keys_and_limits(spark):
    t = '{"apiKey":"x","a":[{"client_secret":1,"tokens":2,"authToken":{"b":1}}],"note":"password"}'
    want = '{"apiKey":"[REDACTED]","a":[{"client_secret":"[REDACTED]","tokens":2,"authToken":"[REDACTED]"}],"note":"password"}'
    assert [r[0] for r in spark.createDataFrame([(t,), (None,), ("{bad",)], "t string").select(X.without_secret_keys(F.col("t"))).collect()] == [want, None, "{bad"]
    assert X.within_limits('{"a": [1]}') is None and X.within_limits("{") == "not JSON" and X.within_limits(None) == "not JSON"
    assert X.within_limits("[" * 40 + "]" * 40) == "depth" and X.within_limits('["abc"]', chars=2) == "chars" and X.within_limits("[1, 2, 3]", items=2) == "items" and X.within_limits('{"a":1,"b":2}', keys=1) == "keys" and X.within_limits("[1, 2, 3]", nodes=2) == "nodes"


def test_crawled_records(spark):
    rows = [("s", "1", "T", "https://e.org/#x", "text", "h1", 10), ("s", "1", "T", "https://e.org/", "text", "h1", 20), ("s", "1", "T", "https://e.org/", "new", "h2", 30), ("s", "1", "T", "https://e.org/", "new", "h2", 30), ("s", None, "T", None, "x", "h", 1)]
    out = adapters.crawled(spark.createDataFrame(rows, "source string, id string, title string, url string, text string, content_hash string, retrieved_at long")).collect()
    assert sorted(r.kind for r in out) == ["artifact"] * 3 + ["source"] * 2 and len({r.event_id for r in out}) == 5
    assert {r.target for r in out if r.target} == {r.event_id for r in out if r.kind == "source"}


def test_run_events(spark):
    out = adapters.run_events(spark.createDataFrame([("r", 1, "run.started", 1), ("r", 2, "tool.requested", 2), ("r", 3, "tool.done", 3), ("r", 4, "other", 4), ("r", 1, "run.started", 1)], "run string, sequence long, type string, ts long")).collect()
    assert [r.kind for r in out] == ["session.started", "tool.requested", "tool.completed", "claim", "session.started"] and len({r.event_id for r in out}) == 4
