"""Queries of the derived relations, of snapshots and of integrity."""

from __future__ import annotations

import secrets

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.identity import canonical_id, hook_name
from sedimark.operators import readmodel as M
from sedimark.operators.ordered import greedy_skip, positions, running_totals
from sedimark.plans.base import AS_OF, EDGES_SQL, EVENTS_SQL, edges, events
from sedimark.plans.problems import _trim, canonical_sql
from sedimark.plans.ranking import _EL, _eligible
from sedimark.runtime import staged, table
from sedimark.sinks import export

SPLIT = "2025-08-01 00:00:00"
BUDGET = 2000
# fixed values: what a host's lifecycle hook is in the ledger
HOOK_KINDS = {"sessionstart": ("session.started", "system"), "userpromptsubmit": ("prompt.submitted", "human"), "pretooluse": ("tool.requested", "agent"), "permissionrequest": ("approval", "system"), "posttooluse": ("tool.completed", "tool"), "posttoolusefailure": ("tool.completed", "tool"), "permissiondenied": ("approval", "system"), "precompact": ("compaction.started", "system"), "postcompact": ("compaction.completed", "system"), "stop": ("turn.completed", "agent"), "stopfailure": ("turn.completed", "system"), "subagentstart": ("session.started", "agent"), "subagentstop": ("turn.completed", "agent"), "sessionend": ("turn.completed", "system")}


def edge_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Distinct edges with their number of occurrences."""
    return M.coalesced_edges(edges(spark, d))


def dangling_targets(spark: SparkSession, d: str) -> DataFrame:
    """Targets of edges that are no event, with the kind of entity that stands for them."""
    return M.dangling_targets(edges(spark, d), events(spark, d))


def _json(spark: SparkSession, d: str, kinds: list[str]) -> DataFrame:
    rows = table(spark, d, "ledger_events").where(F.col("kind").isin(kinds))
    return rows.select("row_id", "kind", F.unix_millis("event_timestamp").alias("ts"), M.whole_json(F.col("data_json")).alias("j"), "event_hash", "subject_id", "repository_id")


def sources_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last symbol cited for each source path."""
    rows = _json(spark, d, ["source"]).select("row_id", F.get_json_object("j", "$.path").alias("path"), F.get_json_object("j", "$.symbol").alias("symbol"))
    return M.latest(rows, "path", "row_id", ["symbol", "row_id"])


def decisions_status(spark: SparkSession, d: str) -> DataFrame:
    """Every decision, current or superseded, and until when."""
    return M.decision_status(events(spark, d), edges(spark, d))


def dashboard_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the ledger in one row."""
    ev, ed = events(spark, d), edges(spark, d)
    a = ev.agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "decision").alias("decisions"), F.count_distinct("repo").alias("repositories"), F.count_distinct("subject").alias("subjects"), F.sum(F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4)).alias("tokens"))
    s = M.decision_status(ev, ed).agg(F.count_if(F.col("status") == "superseded").alias("superseded"))
    c = ed.where("type = 'contradicts' and source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().agg(F.count("*").alias("conflicts"))
    return a.crossJoin(s).crossJoin(c)


def active_scopes_asof(spark: SparkSession, d: str) -> DataFrame:
    """Scopes that attachments grant at the instant."""
    at = "$.memoryAttachment."
    rows = _json(spark, d, ["memory.scope.attached", "memory.scope.revoked"]).select(
        F.get_json_object("j", at + "attachmentId").alias("attachment"), (F.col("kind") == "memory.scope.revoked").alias("revoked"),
        F.coalesce(F.from_json(F.get_json_object("j", at + "scopes"), "array<string>"), F.array().cast("array<string>")).alias("scopes"), "ts", F.col("row_id").alias("seq"),
    )
    return M.active_scopes(rows, AS_OF)


def freshness_status(spark: SparkSession, d: str) -> DataFrame:
    """What was cited up to the split against the last state of each subject."""
    rows = table(spark, d, "ledger_events").where("kind = 'decision'").select(F.col("subject_id").alias("path"), canonical_id(F.col("event_hash")).alias("hash"), "event_timestamp", "row_id", F.struct("event_timestamp", "row_id").alias("_o"))
    cited = M.latest(rows.where(F.col("event_timestamp") < F.lit(SPLIT + "Z").cast("timestamp")), "path", "_o", ["hash"])
    observed = M.latest(rows.where(F.col("event_timestamp") >= F.lit(SPLIT + "Z").cast("timestamp")), "path", "_o", ["hash"])
    return M.freshness(cited, observed)


def _snapshots(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").where("repository_id is not null and doc_path is not null").select(F.col("repository_id").alias("repo"), F.col("doc_path").alias("path"), F.md5("text").alias("hash"), "updated_at", "doc_id")
    cut = F.lit(SPLIT + "Z").cast("timestamp")
    last = lambda df: df.groupBy("repo", "path").agg(F.max_by("hash", F.struct("updated_at", "doc_id")).alias("hash"))
    return last(docs.where(F.col("updated_at") < cut)), last(docs.where(F.col("updated_at") >= cut))


def snapshot_diff(spark: SparkSession, d: str) -> DataFrame:
    """Files added, removed, modified or renamed between two states of each repository."""
    return M.snapshot_diff(*_snapshots(spark, d))


def rename_detect(spark: SparkSession, d: str) -> DataFrame:
    """Renamed files only, between all earlier and all later paths of equal content."""
    return M.snapshot_diff(*_snapshots(spark, d)).where("change = 'renamed'").select("repo", "old_path", "path")


def link_references(spark: SparkSession, d: str) -> DataFrame:
    """Relative links of documents and the modules that code imports, with how often they occur."""
    docs = table(spark, d, "documents")
    links = F.filter(F.regexp_extract_all("text", F.lit(r"\[[^\]\n]*\]\(([^)\s#?]+)(?:[?#][^)]*)?\)"), 1), lambda x: ~F.regexp_like(x, F.lit("^(https?:|mailto:)")))
    imports = F.regexp_extract_all("text", F.lit(r"\b(?:import|export)\s+(?:[^\"'\n]*?\s+from\s*)?[\"']([^\"'\n]+)[\"']"), 1)
    one = docs.where("text is not null").select("doc_id", F.explode(F.concat(F.transform(links, lambda x: F.struct(F.lit("links").alias("type"), x.alias("specifier"))), F.transform(imports, lambda x: F.struct(F.lit("imports").alias("type"), x.alias("specifier"))))).alias("r"))
    return one.groupBy("doc_id", F.col("r.type").alias("type"), F.col("r.specifier").alias("specifier")).agg(F.count("*").alias("n"))


def causal_receipt(spark: SparkSession, d: str) -> DataFrame:
    """Events of each session in order, each bound to the hash before it. Numbered over range partitions, so a session may be of any size."""
    rows = events(spark, d).where("session is not null and ts is not null").select("session", "ts", "eid", F.coalesce("hash", F.lit("")).alias("hash"))
    p = positions(rows, "session", ["ts", "eid"], ["hash"])
    return p.select("eid", F.col("row_no").alias("stage"), F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", F.coalesce("prev_hash", F.lit("")), "hash"), 256)).alias("link"))


def hash_integrity(spark: SparkSession, d: str) -> DataFrame:
    """By repository: rows, rows without hash, ids that came with different hashes and hashes that came with different ids. The tables name no previous hash; chains are verified on logs (sources.log.verified)."""
    rows = table(spark, d, "ledger_events").where("repository_id is not null").select(F.col("repository_id").alias("repo"), canonical_id(F.col("event_id")).alias("eid"), canonical_id(F.col("event_hash")).alias("hash"))
    # combined by repository, id and hash before anything is counted
    one = staged(rows.groupBy("repo", "eid", "hash").agg(F.count("*").alias("n")), "hashes")
    whole = one.where("eid is not null and hash is not null")
    changed = whole.groupBy("repo", "eid").count().where("count > 1").groupBy("repo").agg(F.count("*").alias("changed_ids"))
    shared = whole.groupBy("repo", "hash").count().where("count > 1").groupBy("repo").agg(F.count("*").alias("shared_hashes"))
    total = one.groupBy("repo").agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("hash").isNull(), F.col("n")).otherwise(0)).alias("without_hash"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return total.join(changed, "repo", "left").join(shared, "repo", "left").select("repo", "n_rows", "without_hash", zero("changed_ids"), zero("shared_hashes"))


def idempotency_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Event ids that came with different contents, and how often each id came."""
    rows = table(spark, d, "ledger_events").select(canonical_id(F.col("event_id")).alias("eid"), canonical_id(F.col("event_hash")).alias("hash")).where("eid is not null")
    # hashes are counted after a first aggregation by id and hash, so that a hot id is combined before the shuffle
    return rows.groupBy("eid", "hash").agg(F.count("*").alias("n")).groupBy("eid").agg(F.sum("n").alias("deliveries"), F.count("hash").alias("contents")).where("deliveries > 1")


def redact_secrets(spark: SparkSession, d: str) -> DataFrame:
    """Digests of the prompts and bodies without secrets."""
    rows = events(spark, d).where("body is not null").select("eid", M.without_secrets(F.col("body")).alias("t"))
    return rows.select("eid", F.sha2("t", 256).alias("digest"), F.length("t").alias("n_chars"))


def size_class(spark: SparkSession, d: str) -> DataFrame:
    """What is kept of a body without its content: size class, bytes and digest, by kind and class."""
    n = F.octet_length("body")
    return events(spark, d).groupBy("kind", M.size_class(n).alias("size_class")).agg(F.count("*").alias("n"), F.sum(F.coalesce(n, F.lit(0))).alias("bytes"))


def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens by repository: a quarter of the characters, rounded up for each event."""
    return events(spark, d).groupBy("repo").agg(F.count("*").alias("n"), F.sum(F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4)).alias("tokens"))


def byte_offsets(spark: SparkSession, d: str) -> DataFrame:
    """Where each row begins in its batch, rows in stored order with a line break between them. Added up over range partitions, so a batch may be of any size."""
    size = F.octet_length(F.coalesce("body", F.lit(""))).cast("long") + 1
    rows = table(spark, d, "ledger_events").select("row_id", "batch_id", size.alias("size"))
    sums = running_totals(rows, ["batch_id", "row_id"], ["size"])
    begins = sums.groupBy(F.col("batch_id").alias("b")).agg(F.min("before_size").alias("begin"))
    return sums.join(begins, F.col("batch_id").eqNullSafe(F.col("b"))).select("row_id", "batch_id", (F.col("before_size") - F.col("begin")).alias("offset"), "size")


def id_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each of the 256 buckets that a lookup by id reads one of."""
    return events(spark, d).groupBy(F.substring(F.sha2("eid", 256), 1, 2).alias("bucket")).agg(F.count("*").alias("n"))


def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository the latest admitted events that fit the budget, up to the first that doesn't. Added up over range partitions."""
    tokens = F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4).cast("long")
    rows = _eligible(spark, d).where("repo is not null").select("repo", F.coalesce(-F.col("ts"), F.lit(2**63 - 1)).alias("age"), "eid", tokens.alias("tokens"))
    sums = running_totals(rows, ["repo", "age", "eid"], ["tokens"])
    begins = sums.groupBy("repo").agg(F.min("before_tokens").alias("begin"))
    used = sums.join(begins, "repo").withColumn("used", F.col("before_tokens") - F.col("begin") + F.col("tokens"))
    return used.where(F.col("used") <= BUDGET).select("repo", "eid", "tokens", "used")


def budget_greedy_skip(spark: SparkSession, d: str) -> DataFrame:
    """Of each repository's admitted events, latest first, those that fit one after the other, skipping what is too big."""
    tokens = F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4).cast("long")
    rows = _eligible(spark, d).where("repo is not null").select("repo", F.coalesce(-F.col("ts"), F.lit(2**63 - 1)).alias("age"), "eid", tokens.alias("tokens"))
    kept = staged(greedy_skip(rows, "repo", ["age", "eid"], "tokens", [BUDGET]).where("kept[0]").drop("kept"), "kept")
    totals = kept.groupBy("repo").agg(F.sum("tokens").alias("used"), F.count("*").cast("int").alias("n"))
    return positions(kept, "repo", ["age", "eid"], []).join(totals, "repo").select("repo", "used", "n", (F.col("row_no") - 1).cast("int").alias("place"), "eid")


def hook_events(spark: SparkSession, d: str) -> DataFrame:
    """Ledger events that the host's hooks become: kind, actor, relations and an id that follows from the message."""
    name = hook_name(F.col("hook_event_name"))
    pick = lambda i: F.coalesce(*[F.when(name == k, F.lit(v[i])) for k, v in HOOK_KINDS.items()])
    s, p, t = canonical_id(F.col("session_id")), canonical_id(F.col("prompt_id")), canonical_id(F.col("tool_use_id"))
    # what stays the same when the message comes again; without it the event has no id of its own
    agent = F.when(F.startswith(name, F.lit("subagent")), F.col("agent_id"))
    stable = F.coalesce(F.concat(F.lit("tool:"), t), F.concat(F.lit("agent:"), agent), F.when(name.isin("userpromptsubmit", "stop"), F.concat(F.lit("prompt:"), p)))

    def ident(n):
        hexed = F.sha2(F.concat(F.coalesce(s, F.lit("")), F.lit("|"), n, F.lit("|"), stable), 256)
        return F.concat(F.lit("evt_"), F.substring(hexed, 1, 8), F.lit("-"), F.substring(hexed, 9, 4), F.lit("-4"), F.substring(hexed, 14, 3), F.lit("-8"), F.substring(hexed, 18, 3), F.lit("-"), F.substring(hexed, 21, 12))

    # the id of what a message answers follows from the same parts: a result from its request, a stop from its prompt
    origin = F.when(t.isNotNull() & name.isin("posttooluse", "posttoolusefailure"), F.lit("pretooluse")).when(t.isNull() & (name == "stop") & p.isNotNull(), F.lit("userpromptsubmit"))
    relations = F.concat_ws(",", F.when(s.isNotNull(), F.concat(F.lit("session:"), s)), F.when(p.isNotNull(), F.concat(F.lit("turn:"), p)), F.when(t.isNotNull(), F.concat(F.lit("toolcall:"), t)))
    return table(spark, d, "claude_hooks").where(pick(0).isNotNull()).select("hook_id", pick(0).alias("kind"), pick(1).alias("actor_type"), ident(name).alias("event_id"), ident(origin).alias("derived_from"), relations.alias("relations"))


def okf_log(spark: SparkSession, d: str) -> DataFrame:
    """Log of an export: events of each day and a digest over their paths and contents in order."""
    rows = events(spark, d).where("ts is not null").select(F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")).cast("string").alias("day"), F.concat(F.lit("events/"), F.col("eid"), F.lit(".md")).alias("path"), F.sha2(F.concat_ws("\n", "title", "body"), 256).alias("hash"))
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "hash"))), "\n"), 256).alias("digest"))


def sync_round_trip(spark: SparkSession, d: str, key: str | None = None) -> DataFrame:
    """Bodies through an authenticated encrypted bundle and back; each payload has an initial vector of its own, and its event id is bound to it."""
    sealed = export.sealed(events(spark, d).where("body is not null").select("eid", F.col("body").alias("payload")), key or secrets.token_hex(16))
    # written, as a bundle is: what is opened has to be what was sealed
    return export.opened(staged(sealed[0], "bundle"), sealed[1]).select("eid", F.col("payload").alias("body"))


def event_languages(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the language of their path and their directory."""
    return table(spark, d, "documents").where("doc_path is not null").groupBy(M.language(F.col("doc_path")).alias("language"), F.regexp_extract("doc_path", "^(.*)/[^/]*$", 1).alias("directory")).agg(F.count("*").alias("n"))


_FUNCTIONS = (
    edge_coalesce, dangling_targets, sources_latest, decisions_status, dashboard_totals, active_scopes_asof, freshness_status, snapshot_diff, rename_detect, link_references, causal_receipt, hash_integrity,
    idempotency_conflicts, redact_secrets, size_class, token_estimate, byte_offsets, id_buckets, budget_prefix, budget_greedy_skip, hook_events, okf_log, sync_round_trip, event_languages,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle() -> dict[str, str]:
    ev = f"with {EVENTS_SQL}, "
    tok = "ceil(length(coalesce(body, '')) / 4.0)::bigint"
    valid = "case when json_valid(data_json) then data_json end"
    state = f"""sp as (select source, target eid from ed where "type" = 'supersedes' and source <> target), si as (select sp.eid, min(coalesce(e.vf, e.ts)) since, count(*) n from sp join ev e on e.eid = sp.source group by 1),
 ds as (select ev.eid, case when si.n > 0 then 'superseded' else 'current' end status, coalesce(vu, since) until_ms from ev left join si using (eid) where kind = 'decision')"""
    snap = f"""d as (select repository_id repo, doc_path path, md5(text) hash, updated_at, doc_id from documents where repository_id is not null and doc_path is not null),
 b as (select repo, path, hash from d where updated_at < '{SPLIT}+00'::timestamptz qualify row_number() over (partition by repo, path order by updated_at desc, doc_id desc) = 1),
 a as (select repo, path, hash from d where updated_at >= '{SPLIT}+00'::timestamptz qualify row_number() over (partition by repo, path order by updated_at desc, doc_id desc) = 1),
 rm as (select repo, path old_path, hash from b where (repo, path) not in (select repo, path from a)), ad as (select repo, path, hash from a where (repo, path) not in (select repo, path from b)),
 md as (select a.repo, a.path, 'modified' change, null::varchar old_path from a join b on a.repo = b.repo and a.path = b.path where a.hash is distinct from b.hash),
 un as (select repo, hash, min(old_path) old_path from rm where hash is not null group by all having count(*) = 1), tk as (select ad.repo, min(path) path, 'renamed' change, any_value(un.old_path) old_path from ad join un on ad.repo = un.repo and ad.hash = un.hash group by ad.repo, ad.hash)"""
    name = f"replace(lower({_trim('hook_event_name')}), '_', '')"
    kinds = lambda i: f"case {name} " + " ".join(f"when '{k}' then '{v[i]}'" for k, v in HOOK_KINDS.items()) + " end"
    s, p, t = canonical_sql("session_id"), canonical_sql("prompt_id"), canonical_sql("tool_use_id")
    langs = "case " + " ".join(f"when lower(regexp_extract(doc_path, '\\.([^./]+)$', 1)) in ({', '.join(repr(e) for e in ends)}) then '{k}'" for k, ends in M.LANGUAGES.items()) + " else 'text' end"
    secrets = "body"
    for r in M.SECRETS:
        flags = "g"
        r2 = r.replace("(?i)", "").replace("(?s)", "")
        flags += "i" if r.startswith("(?i)") else ""
        flags += "s" if r.startswith("(?s)") else ""
        secrets = f"regexp_replace({secrets}, '{r2}', '[REDACTED]', '{flags}')"
    stable = f"coalesce('tool:' || {t}, case when starts_with({name}, 'subagent') then 'agent:' || agent_id end, case when {name} in ('userpromptsubmit', 'stop') then 'prompt:' || {p} end)"
    origin = f"case when {t} is not null and {name} in ('posttooluse', 'posttoolusefailure') then 'pretooluse' when {t} is null and {name} = 'stop' and {p} is not null then 'userpromptsubmit' end"
    ident = lambda x: f"'evt_' || substr({x}, 1, 8) || '-' || substr({x}, 9, 4) || '-4' || substr({x}, 14, 3) || '-8' || substr({x}, 18, 3) || '-' || substr({x}, 21, 12)"
    return {
        "edge_coalesce": f'with {EDGES_SQL} select source, "type", target, count(*) occurrences, min(edge_id) first_edge from ed group by source, "type", target',
        "dangling_targets": ev + f"{EDGES_SQL} select target, case when contains(target, ':') and split_part(target, ':', 1) in ('session', 'turn', 'toolcall', 'agent') then 'entity.' || split_part(target, ':', 1) else 'entity.reference' end entity_type, count(*) n_edges from ed where target is not null and target not in (select eid from ev) group by all",
        "sources_latest": f"select json_extract_string(j, '$.path') path, json_extract_string(j, '$.symbol') symbol, row_id from (select row_id, {valid} j from ledger_events where kind = 'source') where json_extract_string(j, '$.path') is not null qualify row_number() over (partition by json_extract_string(j, '$.path') order by row_id desc) = 1",
        "decisions_status": ev + f"{EDGES_SQL}, {state} select * from ds",
        "dashboard_totals": ev + f"""{EDGES_SQL}, {state} select count(*) events, count(*) filter (kind = 'decision') decisions, count(distinct repo) repositories, count(distinct subject) subjects, sum({tok})::bigint tokens, (select count(*) from ds where status = 'superseded') superseded,
 (select count(*) from (select distinct least(source, target), greatest(source, target) from ed where "type" = 'contradicts' and source <> target)) conflicts from ev""",
        "active_scopes_asof": f"""with j as (select row_id seq, kind, epoch_ms(event_timestamp) ts, {valid} j from ledger_events where kind in ('memory.scope.attached', 'memory.scope.revoked')),
 l as (select json_extract_string(j, '$.memoryAttachment.attachmentId') attachment, kind, json_extract_string(j, '$.memoryAttachment.scopes[*]') scopes from j where ts <= {AS_OF} and json_extract_string(j, '$.memoryAttachment.attachmentId') is not null qualify row_number() over (partition by json_extract_string(j, '$.memoryAttachment.attachmentId') order by ts desc, seq desc) = 1)
 select * from (select attachment, unnest(list_distinct(scopes)) "scope" from l where kind = 'memory.scope.attached') where "scope" is not null""",
        "freshness_status": f"""with r as (select subject_id path, {canonical_sql('event_hash')} hash, event_timestamp ts, row_id from ledger_events where kind = 'decision' and subject_id is not null),
 c as (select path, hash from r where ts < '{SPLIT}+00'::timestamptz qualify row_number() over (partition by path order by ts desc, row_id desc) = 1), o as (select path, hash, true there from r where ts >= '{SPLIT}+00'::timestamptz qualify row_number() over (partition by path order by ts desc, row_id desc) = 1)
 select c.path, case when there is null then 'missing' when c.hash is null or o.hash is null then 'unverified' when c.hash <> o.hash then 'changed' else 'current' end status from c left join o using (path)""",
        "snapshot_diff": f"with {snap} select * from md union all select * from tk union all select repo, path, 'added', null from ad where (repo, path) not in (select repo, path from tk) union all select repo, old_path, 'removed', null from rm where (repo, old_path) not in (select repo, old_path from tk)",
        "rename_detect": f"with {snap} select repo, old_path, path from tk",
        "link_references": r"""with l as (select doc_id, unnest(regexp_extract_all(text, '\[[^\]\n]*\]\(([^)\s#?]+)(?:[?#][^)]*)?\)', 1)) specifier from documents), i as (select doc_id, unnest(regexp_extract_all(text, '\b(?:import|export)\s+(?:[^"''\n]*?\s+from\s*)?["'']([^"''\n]+)["'']', 1)) specifier from documents)
 select doc_id, 'links' "type", specifier, count(*) n from l where not regexp_matches(specifier, '^(https?:|mailto:)') group by all union all select doc_id, 'imports', specifier, count(*) from i group by all""",
        "causal_receipt": ev + "r as (select *, coalesce(hash, '') h from ev where session is not null and ts is not null) select eid, row_number() over w stage, 'sha256:' || sha256(coalesce(lag(h) over w, '') || '|' || h) link from r window w as (partition by session order by ts, eid)",
        "hash_integrity": f"""with r as (select repository_id repo, {canonical_sql('event_id')} eid, {canonical_sql('event_hash')} hash from ledger_events where repository_id is not null),
 c as (select repo, count(*) n from (select repo, eid from r where eid is not null and hash is not null group by 1, 2 having count(distinct hash) > 1) group by 1), s as (select repo, count(*) n from (select repo, hash from r where eid is not null and hash is not null group by 1, 2 having count(distinct eid) > 1) group by 1)
 select r.repo, count(*) n_rows, count(*) filter (hash is null) without_hash, coalesce(any_value(c.n), 0) changed_ids, coalesce(any_value(s.n), 0) shared_hashes from r left join c on c.repo = r.repo left join s on s.repo = r.repo group by 1""",
        "idempotency_conflicts": f"select {canonical_sql('event_id')} eid, count(*) deliveries, count(distinct {canonical_sql('event_hash')}) contents from ledger_events where {canonical_sql('event_id')} is not null group by 1 having count(*) > 1",
        "redact_secrets": ev + f"x as (select eid, {secrets} t from ev where body is not null) select eid, sha256(t) digest, length(t)::int n_chars from x",
        "size_class": ev + "x as (select kind, strlen(body) n from ev) select kind, case when n is null then 'none' when n = 0 then 'empty' when n <= 64 then 'tiny' when n <= 1024 then 'small' when n <= 16384 then 'medium' when n <= 65536 then 'large' else 'very_large' end size_class, count(*) n, sum(coalesce(n, 0))::bigint bytes from x group by 1, 2",
        "token_estimate": ev + f"x as (select repo, {tok} t from ev) select repo, count(*) n, sum(t)::bigint tokens from x group by 1",
        "byte_offsets": "with s as (select row_id, batch_id, strlen(coalesce(body, ''))::bigint + 1 size from ledger_events) select row_id, batch_id, coalesce(sum(size) over (partition by batch_id order by row_id rows between unbounded preceding and 1 preceding), 0)::bigint \"offset\", size from s",
        "id_buckets": ev + "x as (select substr(sha256(eid), 1, 2) bucket from ev) select bucket, count(*) n from x group by 1",
        "budget_prefix": ev + f"{_EL}, t as (select repo, eid, ts, {tok} tokens from el where repo is not null), u as (select repo, eid, tokens, sum(tokens) over (partition by repo order by ts desc nulls last, eid rows unbounded preceding)::bigint used from t) select * from u where used <= {BUDGET}",
        "budget_greedy_skip": ev + f"""{_EL}, t as (select repo, eid, ts, {tok} tokens from el where repo is not null), g as (select repo, list(eid order by ts desc nulls last, eid) ids, list(tokens order by ts desc nulls last, eid) sizes from t group by 1),
 f as (select repo, list_reduce(list_prepend({{'u': 0::bigint, 'k': []::varchar[]}}, list_transform(list_zip(sizes, ids), lambda x: {{'u': x[1], 'k': [x[2]]}})), lambda a, x: case when a.u + x.u <= {BUDGET} then {{'u': a.u + x.u, 'k': list_concat(a.k, x.k)}} else a end) r from g)
 select repo, r.u used, len(r.k)::int n, (unnest(range(len(r.k))))::int place, unnest(r.k) eid from f""",
        "hook_events": f"""with h as (select hook_id, {kinds(0)} kind, {kinds(1)} actor_type, {s} s, {p} p, {t} t, sha256(coalesce({s}, '') || '|' || {name} || '|' || {stable}) x, sha256(coalesce({s}, '') || '|' || {origin} || '|' || {stable}) o from claude_hooks)
 select hook_id, kind, actor_type, {ident('x')} event_id, {ident('o')} derived_from, concat_ws(',', 'session:' || s, 'turn:' || p, 'toolcall:' || t) relations from h where kind is not null""",
        "okf_log": ev + "x as (select strftime(make_timestamp(ts * 1000), '%Y-%m-%d') \"day\", 'events/' || eid || '.md:' || sha256(concat_ws(chr(10), title, body)) p from ev where ts is not null) select \"day\", count(*) n, sha256(string_agg(p, chr(10) order by p)) digest from x group by 1",
        "sync_round_trip": ev + "x as (select eid, body from ev where body is not null) select * from x",
        "event_languages": f"select {langs} \"language\", regexp_extract(doc_path, '^(.*)/[^/]*$', 1) directory, count(*) n from documents where doc_path is not null group by 1, 2",
    }
