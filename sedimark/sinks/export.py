"""Exports: one Markdown file per event with an index and a log, a static page, and the derived views."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.data import primitive_lines, project_lines
from sedimark.operators import ranking, readmodel
from sedimark.operators.graph import node_id
from sedimark.operators.ordered import positions


def inline(c: Column) -> Column:
    """Text on one line with Markdown's signs escaped."""
    flat = F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))
    return F.regexp_replace(flat, r"([\\`*_{}\[\]()#+!|<>])", r"\\$1")


def concepts(events: DataFrame) -> DataFrame:
    """(path, text) of the file of each event(eid, kind, title, body, repo, confidence, ts)."""
    when = F.date_format(F.timestamp_millis("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    quoted = F.concat(F.lit("> "), F.replace(F.coalesce("body", F.lit("")), F.lit("\n"), F.lit("\n> ")))
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("id: "), F.col("eid")), F.concat(F.lit("kind: "), F.col("kind")), F.concat(F.lit("repository: "), F.col("repo")), F.concat(F.lit("confidence: "), F.col("confidence")), F.concat(F.lit("time: "), when), F.lit("---"))
    return events.select(F.concat(F.lit("events/"), F.col("eid"), F.lit(".md")).alias("path"), F.concat_ws("\n\n", head, F.concat(F.lit("# "), inline(F.col("title"))), quoted).alias("text"))


def index_lines(events: DataFrame) -> DataFrame:
    """(day, place, line) of the index, newest first within each day; the days are its files, so no file grows without bound."""
    day = F.date_from_unix_date(F.floor(F.col("ts") / 86_400_000).cast("int")).cast("string")
    rows = positions(events.where("ts is not null").select(day.alias("day"), (-F.col("ts")).alias("age"), "eid", "title"), "day", ["age", "eid"], [])
    return rows.select("day", F.col("row_no").alias("place"), F.concat(F.lit("- ["), inline(F.col("title")), F.lit("](../events/"), F.col("eid"), F.lit(".md)")).alias("line"))


def sealed(rows: DataFrame, key: str) -> tuple[DataFrame, str]:
    """(eid, box) of rows(eid, payload) and the key: AES-GCM with a random initial vector for each payload, so that a changed one never reuses a vector, and the id as bound data. key has 16, 24 or 32 bytes; keep it out of what is written."""
    return rows.select("eid", F.expr("aes_encrypt(payload, :k, 'GCM', 'DEFAULT', cast('' as binary), eid)".replace(":k", f"cast('{_plain_key(key)}' as binary)")).alias("box")), key


def opened(boxes: DataFrame, key: str) -> DataFrame:
    """(eid, payload) of boxes(eid, box); fails if a box or its id was changed."""
    return boxes.select("eid", F.expr(f"cast(aes_decrypt(box, cast('{_plain_key(key)}' as binary), 'GCM', 'DEFAULT', eid) as string)").alias("payload"))


def _plain_key(key: str) -> str:
    if len(key) not in (16, 24, 32) or not key.isalnum():
        raise ValueError("the key has 16, 24 or 32 letters and digits")
    return key


def bundle_digest(files: DataFrame) -> DataFrame:
    """(folder, digest) of files(path, text): a digest over the sorted paths and contents of each of 256 folders by the path's hash; the digest of the bundle is that of these rows in order."""
    own = files.select(F.substring(F.sha2("path", 256), 1, 2).alias("folder"), F.concat_ws(":", "path", F.sha2("text", 256)).alias("x"))
    return own.groupBy("folder").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("x")), "\n"), 256).alias("digest"))


def write_bundle(events: DataFrame, path: str) -> None:
    """Writes the events' files as rows and the index as text by day."""
    concepts(events).write.mode("overwrite").parquet(f"{path}/concepts")
    index_lines(events).repartition("day").sortWithinPartitions("day", "place").select("day", "line").write.mode("overwrite").partitionBy("day").text(f"{path}/index")


def views(events: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The derived tables: nodes, edges, decisions, conflicts, supersessions, term statistics and documents' lengths."""
    from sedimark.functions.text import terms

    text = F.concat_ws("\n", "title", "body", *([primitive_lines(F.col("j")), project_lines(F.col("j"))] if "j" in events.columns else []))
    lost = readmodel.dangling_targets(edges, events)
    return {
        "events": events,
        "edges": readmodel.coalesced_edges(edges),
        "nodes": events.select(F.col("eid").alias("id"), F.lit("event").alias("type")).union(lost.select("target", "entity_type")),
        "decisions": readmodel.decision_status(events, edges),
        "conflicts": ranking.conflicts(edges, events),
        "supersessions": edges.where("type = 'supersedes' and source <> target").select("source", "target").distinct(),
        "term_statistics": events.select("eid", F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count_distinct("eid").alias("df"), F.count("*").alias("cf")),
        "lengths": events.select("eid", F.size(terms(text)).alias("n_terms")),
        "subjects": events.where("subject is not null").select(node_id("subject", F.col("subject")).alias("id"), "subject").distinct(),
    }


def page(totals: dict[str, object], recent: list[dict]) -> str:
    """A static page of the ledger's totals and of at most 100 recent events."""
    row = lambda k, v: f"<tr><th>{html.escape(str(k))}</th><td>{html.escape(str(v))}</td></tr>"
    items = "".join(f"<li><code>{html.escape(str(e['eid']))}</code> {html.escape(str(e.get('title') or ''))}</li>" for e in recent[:100])
    return f"<!doctype html><meta charset=utf-8><title>Ledger</title><table>{''.join(row(k, v) for k, v in totals.items())}</table><ol>{items}</ol>"
