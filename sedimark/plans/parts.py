"""Queries of the smaller operators: lookup by id, scopes and places, grades, prefixes, strata, intervals, summaries and freshness."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions import extract as X
from sedimark.functions.data import elements
from sedimark.functions.identity import canonical_id
from sedimark.functions.text import rounded
from sedimark.operators import admission as A
from sedimark.operators import evaluation as E
from sedimark.operators import readmodel as M
from sedimark.operators.ordered import positions
from sedimark.plans import evaluation as plans
from sedimark.plans.base import AS_OF, EVENTS_SQL, REPOSITORIES, SCOPES, events, in_sql
from sedimark.plans.problems import canonical_sql
from sedimark.plans.readmodel import SPLIT, freshness_status
from sedimark.plans.readmodel import oracle as readmodel_oracle
from sedimark.runtime import scratch, staged, table
from sedimark.sinks import index

LOOKED_UP = ("00000000-0000-4000-8000-000000000000",)


def event_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Events by id through the projection in 256 buckets, of which only the ids' own are read: those that supersede most events."""
    path = scratch(spark, "by-id")
    index.write_by_id(events(spark, d).select("eid", "seq", "kind", "title"), path)
    ids = [r.source for r in table(spark, d, "event_edges").where("edge_type = 'supersedes'").select(canonical_id(F.col("source_event_id")).alias("source")).where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(5).collect()]
    return index.by_id(spark, path, [*ids, *LOOKED_UP]).select("eid", "seq", "kind", "title")


def index_state(spark: SparkSession, d: str) -> DataFrame:
    """What an index is compared with before it is used: number of events, last row and a digest that doesn't hang on order."""
    return index.state(events(spark, d))


def module_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the module that their path belongs to."""
    return table(spark, d, "documents").where("doc_path is not null").groupBy(X.module_scope(F.col("doc_path")).alias("scope")).agg(F.count("*").alias("n"))


_NAMED = r"[A-Za-z0-9_/-]+\.(?:py|ts|js|md|yml|json)"


def first_paths(spark: SparkSession, d: str) -> DataFrame:
    """Line and column of each document's first file name."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.regexp_substr("text", F.lit(_NAMED)).alias("link")).where("link is not null")
    line, column = X.line_and_column(F.col("text"), F.expr("instr(text, link)"))
    return rows.select("doc_id", line.alias("line"), column.alias("column"))


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """(repo, row_id, path, scope) of the files of each project snapshot."""
    rows = table(spark, d, "ledger_events").where("kind = 'artifact' and repository_id is not null").select(F.col("repository_id").alias("repo"), "row_id", M.whole_json(F.col("data_json")).alias("j"))
    files = rows.select("repo", "row_id", F.explode(elements(F.get_json_object("j", "$.projectStructure.files"))).alias("f")).select("repo", "row_id", F.get_json_object("f", "$.path").alias("path")).where("path is not null").distinct()
    return files.withColumn("scope", X.module_scope(F.col("path")))


def relevance_grades(spark: SparkSession, d: str) -> DataFrame:
    """Grades of earlier snapshots for the last one of their repository: 2 if they share a file, 1 if only a module. Joined by file and module, never snapshot by snapshot."""
    return E.relevance_grades(_paths(spark, d))


def ranking_hits(spark: SparkSession, d: str) -> DataFrame:
    """One row: subjects with a relevant decision, how many have one among the first 1, 5 and 10, and the mean reciprocal rank."""
    return E.ranking_hits(plans._rankings(spark, d), "subject")


def complete_prefixes(spark: SparkSession, d: str) -> DataFrame:
    """How many of each subject's first decisions by authority hold all its verified ones."""
    r = staged(plans._rankings(spark, d), "rankings")
    return E.complete_prefix(r, r.where("grade = 2").select("subject", "eid"), "subject")


def blind_strata(spark: SparkSession, d: str) -> DataFrame:
    """The first 49 events by BM25 in the three strata that judges get apart."""
    from sedimark.operators import ranking as R
    from sedimark.plans.ranking import _bm25

    return E.strata(R.ranked(_bm25(spark, d, True))).select("eid", "rank", "stratum")


def verified_interval(spark: SparkSession, d: str) -> DataFrame:
    """Verified decisions of each subject with the exact bound where none or all are."""
    g = events(spark, d).where("kind = 'decision' and subject is not null").groupBy("subject").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("confidence") == "verified", F.lit(False))).alias("verified"))
    i = E.zero_edge_interval(F.col("verified"), F.col("n"))
    return g.select("subject", "n", "verified", rounded(i["lower"]).alias("lower"), rounded(i["upper"]).alias("upper"))


def duration_summary(spark: SparkSession, d: str) -> DataFrame:
    """Calls of each tool: number, mean, median, 95th percentile (nearest rank) and maximum of their durations."""
    return E.summarized(table(spark, d, "claude_hooks").where("duration_ms is not null").select(F.coalesce("tool_name", F.lit("")).alias("tool"), "duration_ms"), "tool", "duration_ms")


def freshness_summary(spark: SparkSession, d: str) -> DataFrame:
    """One row: subjects by freshness, and whether any is stale."""
    return M.freshness_summary(freshness_status(spark, d))


def stale_events(spark: SparkSession, d: str) -> DataFrame:
    """Decisions up to the split that cite what has changed or is missing since."""
    stale = freshness_status(spark, d).where("status in ('changed', 'missing')").select(F.col("path").alias("subject"))
    cut = F.unix_millis(F.lit(SPLIT + "Z").cast("timestamp"))
    return events(spark, d).where("kind = 'decision'").where(F.col("ts") < cut).join(stale, "subject", "left_semi").select("eid", "subject")


def fixed_k(spark: SparkSession, d: str) -> DataFrame:
    """Subjects whose verified decisions are exactly the first by authority."""
    r = plans._rankings(spark, d).select("subject", "rank", (F.col("grade") == 2).alias("required"))
    return E.exact_top(r, "subject")


def _two_orders(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of each subject ranked by authority and by time, with their tokens; verified ones are required."""
    last = lambda c: F.coalesce(-F.col(c).cast("long"), F.lit(2**63 - 1))
    tokens = F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4).cast("long")
    rows = events(spark, d).where("kind = 'decision' and subject is not null").select("subject", "eid", last("arank").alias("below"), last("ts").alias("age"), F.coalesce(F.col("confidence") == "verified", F.lit(False)).alias("required"), tokens.alias("tokens"))
    rows = staged(rows, "decisions")
    by = lambda name, order: positions(rows, "subject", order, []).select(F.lit(name).alias("method"), "subject", F.col("row_no").alias("rank"), "required", "tokens")
    return by("authority", ["below", "age", "eid"]).union(by("recency", ["age", "eid"]))


def method_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Two orders of the same decisions by the tokens that hold all that is required."""
    return E.compared(_two_orders(spark, d), "subject")


def method_winner(spark: SparkSession, d: str) -> DataFrame:
    """Which of the two orders needs fewer tokens."""
    return E.winner(E.compared(_two_orders(spark, d), "subject", most=10**9))


def safety_by_method(spark: SparkSession, d: str) -> DataFrame:
    """Events that BM25 finds with and without admission, and how many of them admission forbids."""
    from sedimark.plans.ranking import _bm25

    forbidden = F.size(A.reasons(AS_OF, SCOPES, REPOSITORIES)) > 0
    found = staged(_bm25(spark, d, True).select("eid", forbidden.alias("forbidden")), "found")
    each = F.explode(F.when(F.col("forbidden"), F.array(F.lit("raw"))).otherwise(F.array(F.lit("raw"), F.lit("admitted"))))
    return found.select("forbidden", each.alias("method")).groupBy("method").agg(F.count("*").alias("found"), F.count_if("forbidden").alias("forbidden"))


_FUNCTIONS = (event_lookup, index_state, module_scopes, first_paths, relevance_grades, ranking_hits, complete_prefixes, blind_strata, verified_interval, duration_summary, freshness_summary, stale_events, fixed_k, method_comparison, method_winner, safety_by_method)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def _scope_sql(path: str) -> str:
    parts = f"list_filter(string_split({path}, '/'), lambda x: x <> '')"
    return f"case when len({parts}) <= 1 then '.' else array_to_string(({parts})[1:least(2, len({parts}) - 1)], '/') end"


def oracle() -> dict[str, str]:
    ev = f"with {EVENTS_SQL}, "
    r6 = "floor(({}) * 1000000 + 0.5) / 1000000"
    rk = ev + "rk as (select subject, eid, row_number() over (partition by subject order by arank desc nulls last, ts desc nulls last, eid) rank, case confidence when 'verified' then 2 when 'claimed' then 1 else 0 end grade from ev where kind = 'decision' and subject is not null)"
    w = "case json_type(j, '$.projectStructure.files') when 'VARCHAR' then json_extract(j ->> '$.projectStructure.files', '$') when 'OBJECT' then json_array(json_extract(j, '$.projectStructure.files')) else json_extract(j, '$.projectStructure.files') end"
    files = f"""j as (select repository_id repo, row_id, case when json_valid(data_json) then data_json end j from ledger_events where kind = 'artifact' and repository_id is not null), f as (select distinct repo, row_id, unnest(json_extract_string({w}, '$[*].path')) path from j), p as (select *, {_scope_sql('path')} "scope" from f where path is not null),
 c as (select repo, max(row_id) last from p group by 1), now as (select p.* from p join c on p.repo = c.repo and row_id = last), old as (select p.* from p join c on p.repo = c.repo and row_id < last)"""
    fresh = readmodel_oracle()["freshness_status"]
    tok = "ceil(length(coalesce(body, '')) / 4.0)::bigint"
    two = ev + f"""dd as (select subject, eid, arank, ts, coalesce(confidence = 'verified', false) required, {tok} tokens from ev where kind = 'decision' and subject is not null),
 rk as (select 'authority' "method", subject, row_number() over (partition by subject order by arank desc nulls last, ts desc nulls last, eid) rank, required, tokens from dd union all select 'recency', subject, row_number() over (partition by subject order by ts desc nulls last, eid), required, tokens from dd),
 nd as (select "method", subject, count(*) k, max(rank) last from rk where required group by 1, 2), cs as (select "method", subject, k, last, sum(tokens)::bigint history, sum(case when rank <= last then tokens else 0 end)::bigint prefix from rk join nd using ("method", subject) group by all)"""
    compared = lambda most: two + f""", mt as (select "method", count(*) cases, count(*) filter (last <= {most}) eligible, count(*) filter (k = last) exact, sum(prefix)::bigint p, sum(history)::bigint history_tokens from cs group by 1),
 cm as (select "method", cases, eligible, exact, case when cases = eligible then p end prefix_tokens, history_tokens, case when cases = eligible then {r6.format('1 - p / nullif(history_tokens, 0)::double')} end reduction from mt)"""  # noqa: E731
    from sedimark.plans.ranking import _reasons_sql

    return {
        "fixed_k": rk + " select subject, count(*) k, count(*) = max(rank) exact from rk where grade = 2 group by 1",
        "method_comparison": compared(32) + " select * from cm",
        "method_winner": compared(10**9) + """ select case when count(*) = 0 or count(prefix_tokens) < count(*) then 'none' when min(prefix_tokens) = max(prefix_tokens) then 'tie' else 'winner' end decision, case when count(*) > 0 and count(prefix_tokens) = count(*) and min(prefix_tokens) < max(prefix_tokens) then arg_min("method", prefix_tokens) end winner from cm""",
        "safety_by_method": f"with f as ({_boosted(_reasons_sql())}), m as (select forbidden, 'raw' \"method\" from f union all select forbidden, 'admitted' from f where not forbidden) select \"method\", count(*) found, count(*) filter (forbidden) forbidden from m group by 1",
        "event_lookup": ev + f"s as (select {canonical_sql('source_event_id')} source, count(*) n from event_edges where edge_type = 'supersedes' and {canonical_sql('source_event_id')} is not null group by 1 order by n desc, source limit 5) select eid, seq, kind, title from ev where eid in (select source from s) or eid in {in_sql(list(LOOKED_UP))}",
        "index_state": ev + "x as (select substr(sha256(eid || '|' || seq), 1, 8) h, seq from ev) select count(*) n_events, max(seq) last_seq, coalesce(sum(('0x' || h)::bigint), 0)::bigint digest from x",
        "module_scopes": f"select {_scope_sql('doc_path')} \"scope\", count(*) n from documents where doc_path is not null group by 1",
        "first_paths": rf"""with l as (select doc_id, text, regexp_extract(text, '{_NAMED}') link from documents), b as (select doc_id, substr(text, 1, strpos(text, link) - 1) b from l where link <> '')
 select doc_id, (length(b) - length(replace(b, chr(10), '')) + 1)::int line, (length(string_split(b, chr(10))[-1]) + 1)::int "column" from b""",
        "relevance_grades": f"with {files}, a as (select distinct repo, row_id, 2 g from old where (repo, path) in (select repo, path from now) union all select distinct repo, row_id, 1 from old where (repo, \"scope\") in (select repo, \"scope\" from now)) select repo, row_id, max(g)::int grade from a group by 1, 2",
        "ranking_hits": rk + f", m as (select subject, min(rank) filter (grade > 0) f from rk group by 1 having count(*) filter (grade > 0) > 0) select count(*) subjects, count(*) filter (f <= 1) hit_1, count(*) filter (f <= 5) hit_5, count(*) filter (f <= 10) hit_10, {r6.format('sum(case when f <= 10 then 1.0::double / f else 0 end) / count(*)')} mrr_10 from m",
        "complete_prefixes": rk + " select subject, case when max(rank) <= 32 then max(rank) end prefix from rk where grade = 2 group by 1",
        "blind_strata": f"with b as ({_boosted()}), r as (select eid, row_number() over (order by score desc, ts desc nulls last, eid) rank from b) select eid, rank, case when rank <= 20 then 1 when rank <= 39 then 2 else 3 end::int stratum from r where rank <= 49",
        "verified_interval": ev + f"""g as (select subject, count(*) n, count(*) filter (confidence = 'verified') verified from ev where kind = 'decision' and subject is not null group by 1)
 select subject, n, verified, case when verified = 0 then 0.0::double when verified = n then {r6.format('pow(0.025, 1.0::double / n)')} end "lower", case when verified = 0 then {r6.format('1 - pow(0.025, 1.0::double / n)')} when verified = n then 1.0::double end "upper" from g""",
        "duration_summary": f"select coalesce(tool_name, '') tool, count(*) n, {r6.format('avg(duration_ms)')} mean, quantile_disc(duration_ms, 0.5) p50, quantile_disc(duration_ms, 0.95) p95, max(duration_ms) most from claude_hooks where duration_ms is not null group by 1",
        "freshness_summary": f"with s as ({fresh}) select count(*) filter (status = 'current') current, count(*) filter (status = 'changed') changed, count(*) filter (status = 'missing') missing, count(*) filter (status = 'unverified') unverified, case when count(*) = 0 then 'unavailable' when count(*) filter (status in ('changed', 'missing')) > 0 then 'stale' else 'current' end status from s",
        "stale_events": f"with s as ({fresh}), {EVENTS_SQL} select eid, subject from ev where kind = 'decision' and ts < epoch_ms(timestamp '{SPLIT}') and subject in (select path from s where status in ('changed', 'missing'))",
    }


def _boosted(reasons: str = "[]") -> str:
    """eid, ts and score of all events by BM25 with title boost, and whether there are reasons against them."""
    from sedimark.plans.ranking import _bm25_sql, _counted_sql, _stats_sql

    return f"with {EVENTS_SQL}, {_counted_sql('ev')}, {_stats_sql('ct')} select * from (select eid, ts, {_bm25_sql(True)} score, len({reasons}) > 0 forbidden from ct, st) where score > 0"
