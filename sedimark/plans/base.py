"""The relations that the ledger's queries start from, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.data import opened
from sedimark.functions.identity import canonical_id, instant_ms, outer_trim
from sedimark.plans.problems import _ms, _trim, canonical_sql
from sedimark.runtime import table

#: Parameters of the registered queries.
QUERY = "stale retention policy of the token ledger"
CODE_QUERY = "stale policy in `retention` of store/parser and ledger.token"
AS_OF = 1756684800000
SCOPES = ["org/security", "team/platform"]
REPOSITORIES = [f"repo_{i:05d}" for i in range(1, 121)]
EXPIRES_AFTER = 30 * 86_400_000


def first_rows(spark: SparkSession, d: str) -> DataFrame:
    """(eid, seq) of the first stored row of each event id; two columns of the ledger."""
    rows = table(spark, d, "ledger_events").select(canonical_id(F.col("event_id")).alias("eid"), F.col("row_id").alias("seq")).where("eid is not null")
    return rows.groupBy("eid").agg(F.min("seq").alias("seq"))


def events(spark: SparkSession, d: str) -> DataFrame:
    """One row per event id (the first stored): eid, seq, title, body, j, kind, repo, scope, arank, confidence, subject, session, ts, vf, vu, hash, expires, restricted.

    j is the JSON object or list of the event's data. Times are in milliseconds. Events of repositories that keep
    sessions only expire; those of org scopes are restricted. The first rows are found from two columns and joined, so
    that a query reads and shuffles only the columns that it uses.
    """
    rows = table(spark, d, "ledger_events").select(
        F.col("row_id").alias("seq"), "title", "body", opened(F.col("data_json")).alias("j"), "kind", F.col("repository_id").alias("repo"),
        F.lower(outer_trim(F.col("authority_scope"))).alias("scope"), F.col("authority_rank").alias("arank"), "confidence", F.col("subject_id").alias("subject"),
        F.col("session_id").alias("session"), F.unix_millis("event_timestamp").alias("ts"), instant_ms(F.col("valid_from")).alias("vf"), instant_ms(F.col("valid_until")).alias("vu"), canonical_id(F.col("event_hash")).alias("hash"),
    )
    # a left join on the 240 reference rows whose ids are unique; where nothing of them is used Spark leaves it out
    kept = table(spark, d, "repositories").groupBy(F.col("repository_id").alias("repo")).agg(F.first("retention_class").alias("retention_class"))
    # merged, not broadcast: what is done with the texts then runs on all partitions, however few files the ledger has
    joined = first_rows(spark, d).hint("merge").join(rows, "seq").join(kept, "repo", "left")
    return joined.withColumns({"expires": F.when(F.col("retention_class") == "session", F.col("ts") + EXPIRES_AFTER), "restricted": F.coalesce(F.col("scope").startswith("org/"), F.lit(False))}).drop("retention_class")


def _opened_sql(c: str) -> str:
    own = f"case when json_valid({c}) then {c} end"
    inner = f"case when json_type({own}) = 'VARCHAR' then case when json_valid(({own}) ->> '$') then ({own}) ->> '$' end else {own} end"
    return f"case when json_type({inner}) in ('OBJECT', 'ARRAY') then {inner} end"


def _elements_sql(j: str, path: str) -> str:
    """Elements of a JSON list, also one wrapped in a string; one object is a list of one."""
    return f"coalesce(case json_type({j}, '{path}') when 'ARRAY' then json_extract({j}, '{path}')::json[] when 'OBJECT' then [json_extract({j}, '{path}')] when 'VARCHAR' then case when json_valid({j} ->> '{path}') then case json_type({j} ->> '{path}') when 'ARRAY' then ({j} ->> '{path}')::json[] when 'OBJECT' then [({j} ->> '{path}')::json] end end end, [])"


#: The text that terms are counted in, and what of it the lists of similar texts see, of ev(title, body, j).
OWN_LINES_SQL = "coalesce(case when json_type(j) = 'OBJECT' then array_to_string(list_transform(list_filter(list_zip(json_keys(j), map_values(j::json::map(varchar, json))), lambda e: json_type(e[2]) not in ('OBJECT', 'ARRAY', 'NULL')), lambda e: e[1] || ' ' || (e[2] ->> '$')), chr(10)) end, '')"
PROJECT_LINES_SQL = f"""coalesce(array_to_string(list_concat(list_transform(list_filter({_elements_sql('j', '$.projectStructure.files')}, lambda f: f ->> '$.path' is not null), lambda f: 'project file ' || (f ->> '$.path') || ' ' || coalesce(f ->> '$.language', '')),
 list_transform(list_filter(flatten(list_transform({_elements_sql('j', '$.projectStructure.files')}, lambda f: {_elements_sql('f', '$.references')})), lambda r: r ->> '$.specifier' is not null), lambda r: coalesce(r ->> '$.type', 'reference') || ' ' || (r ->> '$.specifier'))), chr(10)), '')"""
WORDS_SQL = r"""coalesce(regexp_replace(regexp_replace(regexp_replace(j, '\\([nrtbf"/\\])', ' ', 'g'), '([:,\[]\s*)null\b', '\1', 'g'), '[{}\[\]",:]', ' ', 'g'), '')"""

EVENTS_SQL = f"""ev as (select x.*, case when retention_class = 'session' then ts + {EXPIRES_AFTER} end expires, coalesce(starts_with(scope, 'org/'), false) restricted from (
 select {canonical_sql('event_id')} eid, row_id seq, title, body, {_opened_sql('data_json')} j, kind, repository_id repo, lower({_trim('authority_scope')}) scope, authority_rank arank, confidence, subject_id subject, session_id session,
  epoch_ms(event_timestamp) ts, {_ms('valid_from')} vf, {_ms('valid_until')} vu, {canonical_sql('event_hash')} hash from ledger_events
 where {canonical_sql('event_id')} is not null qualify row_number() over (partition by {canonical_sql('event_id')} order by row_id) = 1) x left join repositories r on x.repo = r.repository_id)"""


def edges(spark: SparkSession, d: str) -> DataFrame:
    """edge_id, source, type, target with canonical event ids (other targets as they are)."""
    e = table(spark, d, "event_edges")
    return e.select("edge_id", canonical_id(F.col("source_event_id")).alias("source"), F.col("edge_type").alias("type"), canonical_id(F.col("target_id")).alias("target"), "payload_json")


EDGES_SQL = f"ed as (select edge_id, {canonical_sql('source_event_id')} source, edge_type \"type\", {canonical_sql('target_id')} target, payload_json from event_edges)"


def terms_sql(c: str) -> str:
    from sedimark.functions.text import STOP_WORDS, TERM

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_extract_all(lower(coalesce({c}, '')), '{TERM}'), lambda t: t not in ({stop}))"


def in_sql(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"
