"""Queries of the general data problems, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.operators import delivery, history, shred
from sedimark.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Objects that are elements of a list in the JSON fields."""
    return shred.list_objects(shred.json_fields(table(spark, d, "ledger_events"), table(spark, d, "claude_hooks")))


def p3_tables(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables of the JSON fields, one row per object."""
    return shred.flat_tables(shred.json_fields(table(spark, d, "ledger_events"), table(spark, d, "claude_hooks"))).withColumn("attributes", F.to_json("attributes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of each subject's scope."""
    v = history.versions(history.scope_statements(table(spark, d, "ledger_events")))
    return v.select(F.col("entity").alias("subject_id"), "version_no", F.col("payload").alias("authority_scope"), "from_ms", "until_ms")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of copies of one message."""
    ledger = delivery.copy_pairs(delivery.ledger_keys(table(spark, d, "ledger_events")), "ledger_events")
    return ledger.union(delivery.copy_pairs(delivery.hook_keys(table(spark, d, "claude_hooks")), "claude_hooks"))


def p5_ledger_once(spark: SparkSession, d: str) -> DataFrame:
    """ledger_events with one row per message."""
    rows = table(spark, d, "ledger_events")
    return delivery.once(rows, delivery.ledger_keys(rows), "row_id").select("row_id", "event_id", "event_hash", "kind", "title", "body")


def p5_hooks_once(spark: SparkSession, d: str) -> DataFrame:
    """claude_hooks with one row per message."""
    rows = table(spark, d, "claude_hooks")
    return delivery.once(rows, delivery.hook_keys(rows), "hook_id").select("hook_id", "session_id", "hook_event_name", "prompt_id", "tool_use_id", "prompt", "last_assistant_message")


def queries() -> dict:
    return {f.__name__: f for f in (p3_found, p3_tables, p4_found, p5_found, p5_ledger_once, p5_hooks_once)}


def _trim(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def canonical_sql(c: str) -> str:
    return f"nullif(regexp_replace(lower({_trim(c)}), '^(evt_|sha256:)', ''), '')"


def _ms(c: str) -> str:
    return rf"case when regexp_matches({_trim(c)}, '^\d+$') then try_cast({_trim(c)} as bigint) else date_diff('millisecond', timestamp '1970-01-01', {_utc(c)}) end"


def _utc(c: str) -> str:
    """A naive UTC timestamp of a text, without depending on the session's zone."""
    t = _trim(c)
    sign = rf"case when regexp_extract({t}, '[T ].*([+-])\d\d:\d\d$', 1) = '-' then 1 else -1 end"
    hours, minutes = rf"try_cast(regexp_extract({t}, '[T ].*[+-](\d\d):\d\d$', 1) as bigint)", rf"try_cast(regexp_extract({t}, '[T ].*[+-]\d\d:(\d\d)$', 1) as bigint)"
    local = rf"try_cast(regexp_replace(regexp_replace({t}, '([T ].*)([+-]\d\d:\d\d)$', '\1'), 'Z$', '') as timestamp)"
    return f"{local} + to_minutes(coalesce(({sign}) * ({hours} * 60 + {minutes}), 0))"


LEDGER_KEYS_SQL = f"select row_id rid, 'l' producer, {canonical_sql('event_id')} ident, {canonical_sql('event_hash')} version, batch_id, received_at from ledger_events"
_NAME = f"replace(lower({_trim('hook_event_name')}), '_', '')"
HOOK_KEYS_SQL = f"""select hook_id rid, {canonical_sql('session_id')} || chr(31) || {_NAME} producer,
  case when {_NAME} in ('userpromptsubmit', 'stop') then {canonical_sql('prompt_id')} else {canonical_sql('tool_use_id')} end ident, null::varchar as "version", batch_id, received_at from claude_hooks"""


def _once_sql(keys: str, source: str, row_id: str, columns: str) -> str:
    return f"""with k as ({keys}), v as (select *, first_value("version" ignore nulls) over (partition by producer, ident order by batch_id nulls first, received_at nulls first, rid rows between unbounded preceding and unbounded following) fv from k where producer is not null and ident is not null),
 w as (select rid, row_number() over (partition by producer, ident, coalesce("version", fv) order by batch_id nulls first, received_at nulls first, rid) n from v)
 select {columns} from {source} where {row_id} not in (select rid from w where n > 1)"""


def _inner_sql(x: str) -> str:
    """A JSON string that is the whole text of an object or list as that value."""
    return f"case when json_type({x}) = 'VARCHAR' and json_valid({x} ->> '$') then case when json_type(({x} ->> '$')::json) in ('OBJECT', 'ARRAY') then ({x} ->> '$')::json else {x} end else {x} end"


def _list_objects_sql() -> str:
    same, keys = "source_table, record_id, field_name", ", ".join(f"'{k}'" for k in sorted(shred.LIST_KEYS))
    return f"""with recursive f as (select 'ledger_events' source_table, row_id record_id, 'data_json' field_name, data_json t from ledger_events
  union all select 'claude_hooks', hook_id, 'tool_input', tool_input from claude_hooks union all select 'claude_hooks', hook_id, 'tool_response', tool_response from claude_hooks),
 p as (select {same}, case when json_valid(t) then t::json end j from f where t is not null),
 n({same}, node_path, found, j) as (select {same}, '', false, {_inner_sql('j')} from p
  union all select {same}, case when kind = 'ARRAY' then node_path || '[' || (i - 1) || ']' else node_path || case when node_path = '' then '' else '.' end || k || case when one then '[0]' else '' end end, json_type(v) = 'OBJECT' and (kind = 'ARRAY' or one), v
  from (select *, kind = 'OBJECT' and json_type(v) = 'OBJECT' and k in ({keys}) one from (select {same}, node_path, kind, i, k, {_inner_sql('x')} v
   from (select {same}, node_path, json_type(j) kind, unnest(range(1, len(vs) + 1)) i, unnest(ks) k, unnest(vs) x
    from (select *, case json_type(j) when 'OBJECT' then json_keys(j) else range(len(j::json[]))::varchar[] end ks, case json_type(j) when 'OBJECT' then map_values(j::map(varchar, json)) else j::json[] end vs from n where json_type(j) in ('OBJECT', 'ARRAY'))))))
 select distinct {same}, node_path from n where found"""


def oracle() -> dict[str, str]:
    empty = lambda c: f"coalesce({_trim(c)}, '') = ''"
    return {
        "p3_found": _list_objects_sql(),
        "p4_found": f"""with r as (select subject_id s, lower({_trim('authority_scope')}) a, case when {empty('valid_from')} then epoch_ms(event_timestamp) else {_ms('valid_from')} end f,
   case when {empty('valid_until')} then null else {_ms('valid_until')} end u, event_timestamp t, row_id from ledger_events where kind = 'decision' and subject_id is not null and not {empty('authority_scope')}),
 w as (select * from r where f is not null and (u is null or u > f) qualify row_number() over (partition by s, f order by t desc nulls last, row_id desc) = 1),
 p as (select s, a, f, least(coalesce(u, 9000000000000000), coalesce(lead(f) over (partition by s order by f), 9000000000000000)) e from w),
 g as (select *, case when lag(a) over z = a and lag(e) over z = f then 0 else 1 end b from p window z as (partition by s order by f)),
 i as (select *, sum(b) over (partition by s order by f) v from g)
 select s subject_id, v::bigint version_no, any_value(a) authority_scope, min(f)::bigint from_ms, (case when max(e) = 9000000000000000 then -1 else max(e) end)::bigint until_ms from i group by s, v""",
        "p5_found": f"""with l as ({LEDGER_KEYS_SQL}), h as ({HOOK_KEYS_SQL})
 select 'ledger_events' source_table, a.rid lo_id, b.rid hi_id from l a join l b on a.ident = b.ident and a.rid < b.rid and (a."version" is null or b."version" is null or a."version" = b."version")
 union all select 'claude_hooks', a.rid, b.rid from h a join h b on a.producer = b.producer and a.ident = b.ident and a.rid < b.rid""",
        "p5_ledger_once": _once_sql(LEDGER_KEYS_SQL, "ledger_events", "row_id", "row_id, event_id, event_hash, kind, title, body"),
        "p5_hooks_once": _once_sql(HOOK_KEYS_SQL, "claude_hooks", "hook_id", "hook_id, session_id, hook_event_name, prompt_id, tool_use_id, prompt, last_assistant_message"),
    }
