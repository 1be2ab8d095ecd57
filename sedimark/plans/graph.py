"""Queries of the project's graph and of context quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import graph as G
from sedimark.operators import readmodel as M
from sedimark.runtime import table

MENTIONED = "token"


def _elements(raw):
    """Elements of a JSON list as texts; one object is a list of one."""
    return F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.array(raw)).otherwise(F.from_json(raw, "array<string>"))


def _snapshot(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(files, references) of all snapshots of each repository."""
    rows = table(spark, d, "ledger_events").where("kind = 'artifact' and repository_id is not null").select(F.col("repository_id").alias("repo"), M.whole_json(F.col("data_json")).alias("j"))
    files = rows.select("repo", F.explode(_elements(F.get_json_object("j", "$.projectStructure.files"))).alias("f")).select("repo", F.get_json_object("f", "$.path").alias("path"), F.get_json_object("f", "$.references").alias("r")).where("path is not null")
    refs = files.select("repo", "path", F.explode(_elements(F.col("r"))).alias("x")).select("repo", "path", F.get_json_object("x", "$.specifier").alias("specifier"), F.get_json_object("x", "$.target").alias("target"), F.get_json_object("x", "$.type").alias("type"))
    return files.select("repo", "path").distinct(), refs.distinct()


def project_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of the projects' graphs."""
    return G.project_nodes(*_snapshot(spark, d))


def project_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the projects' graphs."""
    return G.project_edges(*_snapshot(spark, d))


def resolved_references(spark: SparkSession, d: str) -> DataFrame:
    """Files that the relative references of all snapshots lead to."""
    files, refs = _snapshot(spark, d)
    return G.resolved(refs.where("specifier is not null").select("repo", "path", "specifier").distinct(), files)


def _records(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "ledger_events").where("kind = 'artifact'").select("row_id", M.whole_json(F.col("data_json")).alias("j"))
    return rows.select(F.col("row_id").alias("id"), F.explode(_elements(F.get_json_object("j", "$.projectStructure.files"))).alias("f")).select("id", F.get_json_object("f", "$.path").alias("path")).where("path is not null").distinct()


def path_cochange(spark: SparkSession, d: str) -> DataFrame:
    """Artifacts by the files that a question mentions and those that changed together with them."""
    r = _records(spark, d)
    return G.changed_together(r, r.where(F.contains("path", F.lit(MENTIONED))))


def context_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the packs that sessions got: what each subject's latest decisions require against what is verified."""
    rows = table(spark, d, "ledger_events").where("kind = 'decision' and subject_id is not null")
    cases = rows.groupBy("subject_id").agg(
        F.collect_set("event_id").alias("required"), F.collect_set(F.when(F.col("confidence") == "verified", F.col("event_id"))).alias("recalled"), F.bool_or(F.col("confidence") == "verified").alias("completed"),
        F.sum(F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4)).alias("baseline_tokens"), F.sum(F.when(F.col("confidence") == "verified", F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4)).otherwise(0)).alias("tokens"),
    )
    return G.context_quality(cases)


def queries() -> dict:
    return {f.__name__: f for f in (project_nodes, project_edges, resolved_references, path_cochange, context_quality)}


def oracle() -> dict[str, str]:
    lists = lambda j, p: f"case json_type({j}, '{p}') when 'VARCHAR' then json_extract({j} ->> '{p}', '$') when 'OBJECT' then json_array(json_extract({j}, '{p}')) else json_extract({j}, '{p}') end"
    snap = f"""j as (select row_id, repository_id repo, case when json_valid(data_json) then data_json end j from ledger_events where kind = 'artifact'), w as (select row_id, repo, {lists('j', '$.projectStructure.files')} w from j),
 e as (select row_id, repo, unnest(json_extract(w, '$[*]')) f from w), fl as (select row_id, repo, f ->> '$.path' path, {lists('f', '$.references')} r from e where f ->> '$.path' is not null),
 fi as (select distinct repo, path from fl where repo is not null), rx as (select repo, path, unnest(json_extract(r, '$[*]')) x from fl where repo is not null), rf as (select distinct repo, path, x ->> '$.specifier' specifier, x ->> '$.target' target, coalesce(x ->> '$.type', 'references') "type" from rx)"""
    nid = lambda k, v: f"'project:{k}:' || substr(sha256({v}), 1, 32)"
    dirs = "dr as (select distinct repo, unnest(list_prepend('.', list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/')))) name from fi)"
    up = lambda c: f"coalesce(nullif(regexp_extract({c}, '^(.*)/[^/]*$', 1), ''), '.')"
    return {
        "project_nodes": f"""with {snap}, {dirs} select repo, {nid('directory', 'name')} id, 'project.directory' "type", name from dr union all select repo, {nid('file', 'path')}, 'project.file', path from fi
 union all select rf.repo, {nid('reference', 'specifier')}, case when bool_or(rf.target is not null) then 'project.unresolved' else 'project.external' end, specifier from rf left join fi on fi.repo = rf.repo and fi.path = rf.target where fi.path is null and specifier is not null group by rf.repo, specifier""",
        "project_edges": f"""with {snap}, {dirs} select repo, {nid('directory', up('name'))} source, 'contains' "type", {nid('directory', 'name')} target from dr where name <> '.' union all select repo, {nid('directory', up('path'))}, 'contains', {nid('file', 'path')} from fi
 union all select distinct rf.repo, {nid('file', 'rf.path')}, rf."type", case when fi.path is not null then {nid('file', 'rf.target')} else {nid('reference', 'specifier')} end from rf left join fi on fi.repo = rf.repo and fi.path = rf.target where specifier is not null""",
        "resolved_references": f"""with {snap}, o as (select distinct repo, path, specifier from rf where starts_with(specifier, './') or starts_with(specifier, '../')),
 n as (select *, list_reduce(list_prepend([]::varchar[], list_transform(string_split(case when contains(path, '/') then {up('path')} || '/' else '' end || specifier, '/'), lambda x: [x])), lambda a, x: case when x[1] in ('', '.') then a when x[1] <> '..' then list_concat(a, x) when len(a) > 0 then a[1:len(a) - 1] end) c from o),
 t as (select repo, path, specifier, unnest(range({len(G.ENDINGS)})) i, array_to_string(c, '/') || unnest([{', '.join(repr(e) for e in G.ENDINGS)}]) target from n where c is not null)
 select t.repo, t.path, specifier, arg_min(target, i) target from t join fi on fi.repo = t.repo and fi.path = t.target group by 1, 2, 3""",
        "path_cochange": f"""with {snap}, r as (select distinct row_id id, path from fl), m as (select distinct path from r where contains(path, '{MENTIONED}')), s as (select id, path from r where path in (select path from m)),
 n as (select distinct r.path from s join r on s.id = r.id where s.path <> r.path), a as (select id, count(*) direct from s group by 1), b as (select id, count(*) near from r where path in (select path from n) group by 1)
 select coalesce(a.id, b.id) id, (coalesce(direct, 0) + 0.5::double * coalesce(near, 0))::double score from a full join b on a.id = b.id""",
        "context_quality": """with c as (select subject_id, count(distinct event_id) req, count(distinct event_id) filter (confidence = 'verified') rec, bool_or(confidence = 'verified') done, sum(ceil(length(coalesce(body, '')) / 4.0))::bigint base, sum(case when confidence = 'verified' then ceil(length(coalesce(body, '')) / 4.0) else 0 end)::bigint tok from ledger_events where kind = 'decision' and subject_id is not null group by 1)
 select count(*) cases, floor(sum(rec) / sum(req)::double * 10000 + 0.5) / 10000 decision_recall, sum(tok)::bigint tokens, floor((sum(base) - sum(tok)) / sum(base)::double * 10000 + 0.5) / 10000 token_reduction, floor(count(*) filter (done) / count(*)::double * 10000 + 0.5) / 10000 completion,
  """ + ", ".join(f"null::double {k}" for k in G.QUALITY if k != "decision_recall") + ", null::double mistake_prevention, null::double cost_reduction, 0.0::double mean_latency_ms from c",
    }
