"""Queries of the text problems, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import conversations, packing, pii, spans, tokens
from sedimark.plans.problems import canonical_sql
from sedimark.runtime import staged, table


def _messages(spark: SparkSession, d: str) -> DataFrame:
    # written once: links, components and the numbering all start from it
    return staged(conversations.hook_messages(table(spark, d, "claude_hooks"), table(spark, d, "ledger_events")), "hook-messages")


def _conversations(spark: SparkSession, d: str, messages: DataFrame, attach: bool) -> DataFrame:
    links = conversations.message_links(messages, table(spark, d, "event_edges"), attach)
    return conversations.whole_conversations(conversations.resolved(messages, links))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages of whole sessions in order. Rows without session_id belong to no session: they form conversations of their own, which are left out."""
    whole = _conversations(spark, d, _messages(spark, d), attach=False)
    return whole.where("identified").select("session_id", "msg_no", "speaker", "prompt_id")


def p1_messages(spark: SparkSession, d: str) -> DataFrame:
    """Whole conversations as ordered messages with their texts, those found over links included."""
    whole = _conversations(spark, d, _messages(spark, d), attach=True)
    return conversations.with_texts(whole, table(spark, d, "claude_hooks")).select("conversation", "msg_no", "speaker", "text")


def p1_components(spark: SparkSession, d: str) -> DataFrame:
    """All messages as if none had a session: whole conversations found over reply and quote links alone."""
    bare = table(spark, d, "claude_hooks").withColumn("session_id", F.lit(None).cast("string"))
    messages = staged(conversations.hook_messages(bare, table(spark, d, "ledger_events")), "hook-messages")
    return _conversations(spark, d, messages, attach=False).select(F.expr("cast(substring(conversation, 11) as bigint)").alias("component"), "msg_no", "speaker", "prompt_id")


def _free(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return pii.free_texts(table(spark, d, "ledger_events"), table(spark, d, "claude_hooks")), table(spark, d, "workspace_members")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Personal items in the free texts."""
    return pii.found_items(*_free(spark, d))


def p2_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The free texts with placeholders."""
    return pii.redacted(*_free(spark, d))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids of every document by byte_bpe_50k."""
    return tokens.encode_corpus(table(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document's text, encoded and decoded again."""
    return tokens.decode_corpus(tokens.encode_corpus(table(spark, d, "documents")))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every document with tokens, in containers of 2,048 tokens."""
    return packing.fill_containers(tokens.encode_corpus(table(spark, d, "documents"), lengths_only=True))


def p7_space(spark: SparkSession, d: str) -> DataFrame:
    """One row: containers in use, the least number that the tokens could fill, and the share of unused space."""
    return packing.space(p7_containers(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents that share a run of 300 characters."""
    return spans.document_pairs(table(spark, d, "documents"))


def p8_shared(spark: SparkSession, d: str) -> DataFrame:
    """How much of every document lies in spans that others have."""
    return spans.shared_share(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_messages, p1_components, p2_found, p2_redacted, p6_ids, p6_round_trip, p7_containers, p7_space, p8_found, p8_shared)}


def _talk_sql(session: str, rows: str) -> str:
    """Messages m(s, session_id, h, p, prompt_id, e, ts, body, node) of the hooks: the time is that of the smallest event id that the ledger has."""
    name = "replace(lower(hook_event_name), '_', '')"
    return f"""t as (select {canonical_sql('event_id')} e, min(event_timestamp) ts from ledger_events where event_timestamp is not null group by 1),
 r as (select hook_id, {session} s, lower(trim(session_id)) session_id, {name} h, {canonical_sql('prompt_id')} p, prompt_id, {canonical_sql('event_id')} e, case when {name} = 'stop' then last_assistant_message else prompt end body from claude_hooks where {name} in ('userpromptsubmit', 'stop') and {rows}),
 m as (select s, min(session_id) session_id, h, p, min_by(prompt_id, (case when prompt_id <> p then 1 else 0 end) * 1000000000000 + hook_id) prompt_id, coalesce(min(t.e), min(r.e)) e, arg_min(ts, t.e) ts, max(body) body, min(hook_id) node
   from r left join t on r.e = t.e group by s, h, p, case when p is null then hook_id end)"""


_WHOLE = """x as (select *, row_number() over (partition by s order by ts nulls first, p nulls first, h desc, node) n, lag(p) over (partition by s order by ts nulls first, p nulls first, h desc, node) q from y),
 k as (select s from x group by s having count(*) % 2 = 0 and bool_and(coalesce(p is not null and ts is not null and regexp_matches(coalesce(body, ''), '[^\\s\\x0b\\x{85}\\p{Z}]') and case when n % 2 = 1 then h = 'userpromptsubmit' else h = 'stop' and p = q end, false)))"""


def oracle() -> dict[str, str]:
    speaker = "case when h = 'stop' then 'assistant' else 'user' end speaker"
    whole = f"with {_talk_sql(canonical_sql('session_id'), 'session_id is not null')}, y as (select * from m), {_WHOLE} select "
    kept = " from x where s in (select s from k)"
    quotes = ", ".join(f"'{x}'" for x in conversations.QUOTES)
    components = f"""with recursive {_talk_sql("''", 'true')}, v as (select e, min(node) node from m where e is not null group by 1), ln as (select a.node u, b.node v from m a join m b on a.p = b.p union select m.node, v.node from m join v on m.e = v.e
   union select a.node, b.node from event_edges g join v a on a.e = {canonical_sql('source_event_id')} join v b on b.e = {canonical_sql('target_id')} where edge_type in ({quotes})),
 both_ as (select u, v from ln union select v, u from ln), reach(root, node) as (select node, node from m union select root, v from reach join both_ on node = u), c as (select node, min(root) root from reach group by 1),
 y as (select c.root s, m.* exclude (s) from m join c using (node)), {_WHOLE} select s component, n msg_no, {speaker}, prompt_id from x where s in (select s from k)"""
    return {
        "p1_found": whole + f"session_id, n msg_no, {speaker}, prompt_id" + kept, "p1_messages": whole + f"s conversation, n msg_no, {speaker}, body as text" + kept, "p1_components": components,
        "p6_round_trip": "select doc_id, coalesce(text, '') as text from documents",
    }
