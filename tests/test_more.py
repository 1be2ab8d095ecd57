"""Measures, similar texts, packs, logs and streams."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sedimark.operators import evaluation as E
from sedimark.operators import packs
from sedimark.operators.similar import similar_classes
from sedimark.sources import log
from sedimark.streaming import ingest


def observations(spark, rows):
    return spark.createDataFrame([(f"e{i}", float(s), bool(p)) for i, (s, p) in enumerate(rows)], "eid string, score double, positive boolean")


def test_auc_and_average_precision(spark):
    random.seed(3)
    rows = [(random.randrange(8) / 8, random.random() < 0.4) for _ in range(120)]
    pos, neg = [s for s, p in rows if p], [s for s, p in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert E.roc_auc(observations(spark, rows)).first().auc == pytest.approx(want, abs=1e-6)
    assert E.roc_auc(observations(spark, [(0.5, True)])).first().auc is None
    assert E.average_precision(observations(spark, [(0.9, True), (0.8, False), (0.7, True)])).first().average_precision == pytest.approx((1 + 2 / 3) / 2, abs=1e-6)


def test_calibration_and_risk(spark):
    o = observations(spark, [(1.0, True), (1.0, False), (0.0, False)])
    r = E.calibration(o).first()
    assert r.brier == pytest.approx(1 / 3, abs=1e-6) and r.ece == pytest.approx(1 / 3, abs=1e-6)
    got = {x.coverage: (x.n, x.risk) for x in E.risk_coverage(o).collect()}
    assert got[0.1] == (1, 0.0) and got[0.75] == (3, pytest.approx(2 / 3, abs=1e-6))


def test_power_of_the_paired_test():
    assert E.mcnemar_power(40, 0.1, 0.10) == pytest.approx(0.206273, abs=1e-6)


def test_interval_at_the_edge(spark):
    r = spark.range(1).select(E.zero_edge_interval(F.lit(8), F.lit(8)).alias("i")).first().i
    assert r.lower == pytest.approx(0.6306, abs=1e-4) and r.upper == 1.0


def test_bootstrap_is_repeatable(spark):
    c = spark.createDataFrame([("a", 5, 10), ("b", 9, 10), ("c", 1, 10)], "cluster string, total long, n long")
    a, b = E.cluster_bootstrap(c, 300).first(), E.cluster_bootstrap(c, 300).first()
    assert a == b and a.mean == pytest.approx(0.5) and a.lower <= 0.5 <= a.upper


def test_similar_classes_against_brute_force(spark):
    random.seed(7)
    words = [f"w{chr(97 + i)}" for i in range(20)]
    base = [[random.choice(words) for _ in range(random.choice([3, 30, 60]))] for _ in range(12)]
    docs = []
    for b in base:
        for _ in range(4):
            t = list(b)
            for _ in range(random.randrange(3)):
                t[random.randrange(len(t))] = random.choice(words)
            docs.append(" ".join(t))
    docs += ["", None, docs[0], docs[0].upper() + " !"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    norm = [" ".join(x for x in (d or "").lower().replace("!", " ").split()) for d in docs]
    # empty and null texts are by themselves
    rep = [norm.index(n) if n else i for i, n in enumerate(norm)]
    sets = [{tuple(n.split()[i : i + 5]) for i in range(len(n.split()) - 4)} for n in norm]
    links = [0] * len(docs)
    reps = sorted(set(rep))
    for i in reps:
        for j in reps:
            if i != j and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.85:
                links[i] += 1
    got = {r.doc_id: (r.class_id, r.n_links) for r in similar_classes(df, 0.85).collect()}
    assert got == {i: (rep[i], links[rep[i]]) for i in range(len(docs))} and sum(links) >= 2


def test_token_plan():
    p = packs.token_plan(1000)
    assert (p.reserved, p.available, p.grants) == (100, 900, {"framing": 180 , "citations": 225, "content": 495})
    with pytest.raises(ValueError):
        packs.token_plan(100)


def test_pack_fits_and_counts_itself():
    items = [{"eid": f"e{i}", "title": f"t{i}", "body": "x" * 700, "score": 1.0} for i in range(20)]
    pack = packs.fill(items, 3000, {"query": "q"})
    body = {k: v for k, v in pack.items() if k != "manifest"}
    assert pack["used_chars"] == len(packs._text(body)) <= 3000 and pack["items"][-1].get("truncated")
    assert packs.fill(items, 3000, {"query": "q"}) == pack and packs.fill([], 100)["items"] == []
    assert "## 1. t0" in packs.markdown(pack) and len(packs.capsule(items[0] | {"body": "y" * 9000}, pack)) <= 4096
    with pytest.raises(LookupError):
        packs.gate("partial", "DIRECTLY_SUPPORTED", "direct")


def test_diverse_prefers_what_is_new(spark):
    df = spark.createDataFrame([("a", 1, 1.0, ["x", "y"]), ("b", 2, 0.99, ["x", "y"]), ("c", 3, 0.5, ["z"]), ("d", None, 0.1, [])], "eid string, ts long, score double, terms array<string>")
    assert [r.eid for r in packs.diverse(df, 0.5, 3).orderBy("rank").collect()][:2] == ["a", "c"]
    assert [r.eid for r in packs.diverse(df, 1.0, 3).orderBy("rank").collect()] == ["a", "b", "c"]


def test_log_round_trip_and_problems(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"eventId": "evt_1", "title": "t", "actor": {"id": "i", "type": "agent"}}\n\n[1]\n{"title": 3}\n{"eventId": "evt_2", "relations": [{"type": "supports", "target": "x"}]}\n')
    rows = log.read_log(spark, str(tmp_path / "log.jsonl"))
    assert sorted((r.problem or "") for r in rows.select("problem").collect()) == ["", "", "blank", "no id", "not an object"]
    log.write_log(rows.where("problem is null"), str(tmp_path / "out"))
    again = log.read_log(spark, str(tmp_path / "out"))
    assert {r.eventId for r in again.select("event.eventId").collect()} == {"evt_1", "evt_2"}
    assert log.canonical_json('{"b": 1, "a": [{"d": 2, "c": null}]}') == '{"a":[{"c":null,"d":2}],"b":1}' and log.canonical_json("{") is None


def test_project_files_and_publish(spark, tmp_path):
    (tmp_path / "p" / "src").mkdir(parents=True)
    (tmp_path / "p" / "src" / "a.py").write_text("print(1)\n")
    (tmp_path / "p" / "b.bin").write_bytes(bytes(range(256)))
    got = {r.path.rsplit("/", 1)[1]: (r.language, r.is_binary) for r in log.project_files(spark, str(tmp_path / "p")).collect()}
    assert got == {"a.py": ("python", False), "b.bin": ("text", True)}
    for n in (3, 5, 7):
        before = log.published(spark, str(tmp_path / "views"), "v") if n > 3 else None
        log.publish({"v": spark.range(n)}, str(tmp_path / "views"))
        assert log.published(spark, str(tmp_path / "views"), "v").count() == n
        # who reads the version before goes on reading it
        assert before is None or before.count() == n - 2
    log.prune(spark, str(tmp_path / "views"), 1)
    assert log.published(spark, str(tmp_path / "views"), "v").count() == 7 and len(list((tmp_path / "views").glob("0*"))) == 1
    # tabs, line breaks, form feeds and vertical tabs aren't control bytes
    (tmp_path / "p" / "c.txt").write_bytes(b"a\x0b\x0c\t\r\n\x7f" * 20)
    assert not next(r.is_binary for r in log.project_files(spark, str(tmp_path / "p")).collect() if r.path.endswith("c.txt"))


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1), ("p", 2), ("p", 2), ("p", 5), ("q", 1)], "producer string, number long")
    rows.repartition(2).write.parquet(str(tmp_path / "in"))
    s = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    assert ingest.run_to_table(ingest.once_by(s, ["producer", "number"]), str(tmp_path / "once")).count() == 4
    s = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    got = sorted(tuple(r) for r in ingest.run_to_table(ingest.sequence_continuity(s), str(tmp_path / "seq")).collect())
    assert got == [("p", 1, "next"), ("p", 2, "next"), ("p", 2, "replay"), ("p", 5, "gap"), ("q", 1, "next")]
    assert got == sorted(tuple(r) for r in ingest.statuses(rows).collect())


def test_a_producer_of_several_arrow_batches_is_ordered(spark, tmp_path):
    rows = spark.createDataFrame([("p", n) for n in (3, 4, 1, 2)], "producer string, number long").coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2)
    try:
        s = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
        got = {(r.number, r.status) for r in ingest.run_to_table(ingest.sequence_continuity(s), str(tmp_path / "seq")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {(n, "next") for n in (1, 2, 3, 4)}


def test_receipts_name_the_one_before(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, "a", None), ("p", 2, "b", "a"), ("p", 3, "c", "x"), ("p", 4, "d", "c")], "producer string, number long, hash string, previous string")
    rows.write.parquet(str(tmp_path / "in"))
    s = ingest.file_stream(spark, str(tmp_path / "in"), rows.schema)
    got = [(r.number, r.status) for r in ingest.run_to_table(ingest.sequence_continuity(s), str(tmp_path / "seq")).orderBy("number").collect()]
    assert got == [(1, "next"), (2, "next"), (3, "broken"), (4, "next")]


def test_logs_are_verified(spark, tmp_path):
    good = log.chained([{"eventId": f"e{i}", "title": f"t{i}", "workspaceId": "w"} for i in range(5)])

    def summary(lines, workspace=None):
        (tmp_path / "l.jsonl").write_text("".join(x + "\n" for x in lines))
        rows, s = log.verified(log.read_log(spark, str(tmp_path / "l.jsonl")), workspace)
        return s.first(), {r.problem for r in rows.where("problem is not null").collect()}

    s, problems = summary(good, "w")
    assert s.ok and s["count"] == 5 and s.head == json.loads(good[-1])["hash"] and not problems
    assert not summary(good[:2] + good[3:])[0].ok and summary(good[:2] + good[3:])[0].orphans == 1
    assert summary([*good[:4], good[4].replace("t4", "t5")])[1] == {"hash"}
    assert summary([*good, good[4]])[0].repeated == 1 and not summary([*good, good[4]])[0].ok
    assert summary([" " + good[0]])[1] == {"not canonical"} and summary(good, "v")[1] == {"workspace"}
    assert summary([])[0].ok


def test_statements_on_measures(spark):
    r = spark.createDataFrame([("s", 1, 0), ("s", 2, 2), ("s", 3, 1), ("n", 1, 0)], "subject string, rank int, grade int")
    row = E.retrieval_metrics(r, "subject").collect()
    assert len(row) == 1 and row[0].recall_1 == 0.0 and row[0].rr_10 == 0.5
    ideal = 3 + 1 / math.log2(3)
    assert row[0].ndcg_10 == pytest.approx((3 / math.log2(3) + 1 / 2) / ideal, abs=1e-6)


def test_prefixes_strata_and_samples(spark):
    ranked = spark.createDataFrame([("q", f"e{i}", i) for i in range(1, 60)], "k string, eid string, rank int")
    need = spark.createDataFrame([("q", "e3"), ("q", "e30"), ("q", "e3"), ("r", "e1")], "k string, eid string")
    assert {tuple(r) for r in E.complete_prefix(ranked, need, "k").collect()} == {("q", 30), ("r", None)}
    assert [r["count"] for r in E.strata(ranked).groupBy("stratum").count().orderBy("stratum").collect()] == [20, 19, 10]
    assert E.balanced_sample([("a", "g", "x"), ("b", "g", "y"), ("c", "h", "x"), ("d", "h", "y")], 3) == ["a", "d", "b"]
    p = spark.createDataFrame([("a", 0.1, 0.3), ("b", 0.5, 0.6)], "cluster string, a double, b double")
    assert E.paired_difference(p, 50).first().mean == pytest.approx(0.15)
