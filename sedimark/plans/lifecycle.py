"""Queries of tool calls, packs, attachments, exports and of what admission prevents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.identity import canonical_id, hook_name
from sedimark.operators import admission as A
from sedimark.operators import readmodel as M
from sedimark.operators.ordered import last_seen
from sedimark.plans.base import AS_OF, EVENTS_SQL, REPOSITORIES, SCOPES, events
from sedimark.plans.problems import _trim, canonical_sql
from sedimark.plans.ranking import _bm25, _bm25_sql, _counted_sql, _reasons_sql, _stats_sql, oracle as ranking_oracle
from sedimark.runtime import table
from sedimark.sinks import export


def tool_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Completed or failed tool calls with the request that they derive from, the first delivered of each."""
    name, ident = hook_name(F.col("hook_event_name")), canonical_id(F.col("tool_use_id"))
    rows = table(spark, d, "claude_hooks").select("hook_id", canonical_id(F.col("session_id")).alias("session"), ident.alias("call"), name.alias("name")).where("session is not null and call is not null")
    first = rows.groupBy("session", "call").agg(F.min(F.when(F.col("name") == "pretooluse", F.col("hook_id"))).alias("request_id"), F.min(F.when(F.col("name").isin("posttooluse", "posttoolusefailure"), F.col("hook_id"))).alias("result_id"))
    return first.where("result_id is not null")


def pack_items(spark: SparkSession, d: str) -> DataFrame:
    """Items of the packs that the ledger records, in order."""
    rows = table(spark, d, "ledger_events").where("kind = 'context.pack.compiled'").select("row_id", M.whole_json(F.col("data_json")).alias("j"))
    raw = F.get_json_object("j", "$.contextPack.items")
    items = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.array(raw)).otherwise(F.from_json(raw, "array<string>"))
    one = rows.select("row_id", F.posexplode(items).alias("i", "x"))
    return one.select("row_id", (F.col("i") + 1).alias("place"), F.get_json_object("x", "$.eventId").alias("event_id"), F.get_json_object("x", "$.score").try_cast("double").alias("score")).where("event_id is not null")


def agent_disclosures(spark: SparkSession, d: str) -> DataFrame:
    """Attachments of each agent, and when the last was revoked; a revocation stays."""
    rows = table(spark, d, "ledger_events").where("kind like 'memory.scope.%'").select("kind", F.unix_millis("event_timestamp").alias("ts"), M.whole_json(F.col("data_json")).alias("j"))
    own = rows.select("kind", "ts", F.get_json_object("j", "$.memoryAttachment.agentId").alias("agent"), F.get_json_object("j", "$.memoryAttachment.attachmentId").alias("attachment")).where("agent is not null")
    one = own.groupBy("agent", "attachment").agg(F.max(F.when(F.col("kind") == "memory.scope.revoked", F.col("ts"))).alias("revoked"))
    return one.groupBy("agent").agg(F.count("attachment").alias("attachments"), F.count("revoked").alias("n_revoked"), F.max("revoked").alias("revoked_ms"))


def asof_decision(spark: SparkSession, d: str) -> DataFrame:
    """For each claim the latest decision strictly before it in its repository; carried forward over range partitions."""
    ev = events(spark, d).where("repo is not null and ts is not null and kind in ('claim', 'decision')")
    # at the same time claims come first, so that a decision isn't seen by them
    rows = ev.select("repo", "ts", (F.col("kind") == "decision").alias("late"), "eid", F.when(F.col("kind") == "decision", F.col("eid")).alias("decision"))
    return last_seen(rows, "repo", ["ts", "late", "eid"], "decision").where("not late").select("eid", F.col("last_decision").alias("decision"))


def forbidden_rate(spark: SparkSession, d: str) -> DataFrame:
    """Of all events that BM25 finds without admission, how many each rule would have kept out."""
    found = _bm25(spark, d, False).select(A.reasons(AS_OF, SCOPES, REPOSITORIES).alias("r"))
    return found.select(F.explode("r").alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def okf_concepts(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the Markdown of each decision."""
    return export.concepts(events(spark, d).where("kind = 'decision'")).select("path", F.sha2("text", 256).alias("digest"))


def context_volume(spark: SparkSession, d: str) -> DataFrame:
    """Estimated tokens of a replay of each repository against those of its best three events."""
    from sedimark.plans.ranking import federated_packs

    tokens = F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4)
    ev = events(spark, d).where("repo is not null")
    whole = ev.groupBy("repo").agg(F.sum(tokens).alias("replay"))
    pack = federated_packs(spark, d).select("repo", "eid").join(ev.select("eid", tokens.alias("t")), "eid").groupBy("repo").agg(F.sum("t").alias("pack"))
    return whole.join(pack, "repo", "left").select("repo", "replay", F.coalesce("pack", F.lit(0)).alias("pack"))


def queries() -> dict:
    return {f.__name__: f for f in (tool_pairs, pack_items, agent_disclosures, asof_decision, forbidden_rate, okf_concepts, context_volume)}


def oracle() -> dict[str, str]:
    ev = f"with {EVENTS_SQL}, "
    name = f"replace(lower({_trim('hook_event_name')}), '_', '')"
    valid = "case when json_valid(data_json) then data_json end"
    items = "case json_type(j, '$.contextPack.items') when 'VARCHAR' then json_extract(j ->> '$.contextPack.items', '$') when 'OBJECT' then json_array(json_extract(j, '$.contextPack.items')) else json_extract(j, '$.contextPack.items') end"
    inline = r"regexp_replace(trim(regexp_replace(coalesce(title, ''), '[\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}]+', ' ', 'g')), '([\\`*_{}\[\]()#+!|<>])', '\\\1', 'g')"
    when = "strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%gZ')"
    tok = "ceil(length(coalesce(body, '')) / 4.0)::bigint"
    return {
        "tool_pairs": f"""with r as (select hook_id, {canonical_sql('session_id')} session, {canonical_sql('tool_use_id')} "call", {name} n from claude_hooks)
 select session, "call", min(hook_id) filter (n = 'pretooluse') request_id, min(hook_id) filter (n in ('posttooluse', 'posttoolusefailure')) result_id from r where session is not null and "call" is not null group by 1, 2 having count(*) filter (n in ('posttooluse', 'posttoolusefailure')) > 0""",
        "pack_items": f"""with j as (select row_id, {valid} j from ledger_events where kind = 'context.pack.compiled'), w as (select row_id, json_extract({items}, '$[*]') w from j), x as (select row_id, unnest(w) x, unnest(range(1, len(w) + 1))::int place from w)
 select row_id, place, x ->> '$.eventId' event_id, try_cast(x ->> '$.score' as double) score from x where x ->> '$.eventId' is not null""",
        "agent_disclosures": f"""with j as (select kind, epoch_ms(event_timestamp) ts, {valid} j from ledger_events where starts_with(kind, 'memory.scope.')), o as (select json_extract_string(j, '$.memoryAttachment.agentId') agent, json_extract_string(j, '$.memoryAttachment.attachmentId') attachment, max(ts) filter (kind = 'memory.scope.revoked') revoked from j group by 1, 2)
 select agent, count(attachment) attachments, count(revoked) n_revoked, max(revoked) revoked_ms from o where agent is not null group by 1""",
        "asof_decision": ev + """x as (select * from ev where repo is not null and ts is not null), d as (select repo, ts, max(eid) eid from x where kind = 'decision' group by all)
 select c.eid, d.eid decision from (select * from x where kind = 'claim') c asof left join d on c.repo = d.repo and c.ts > d.ts""",
        "forbidden_rate": ev + f"{_counted_sql('ev')}, {_stats_sql('ct')}, t as (select * from (select {_reasons_sql()} r, {_bm25_sql(False)} score from ct, st) where score > 0), u as (select unnest(r) reason from t) select reason, count(*) n from u group by 1",
        "okf_concepts": ev + rf"""x as (select eid, concat_ws(chr(10), '---', 'id: ' || eid, 'kind: ' || kind, 'repository: ' || repo, 'confidence: ' || confidence, 'time: ' || {when}, '---') h, {inline} t, '> ' || replace(coalesce(body, ''), chr(10), chr(10) || '> ') q from ev where kind = 'decision')
 select 'events/' || eid || '.md' path, sha256(concat_ws(chr(10) || chr(10), h, '# ' || t, q)) digest from x""",
        "context_volume": f"with fp as ({ranking_oracle()['federated_packs']}), {EVENTS_SQL}, v as (select fp.repo, sum({tok})::bigint pack from fp join ev on fp.eid = ev.eid group by 1), w as (select repo, sum({tok})::bigint replay from ev where repo is not null group by 1) select w.repo, replay, coalesce(pack, 0) pack from w left join v using (repo)",
    }
