"""Records of other systems as ledger events with ids that follow from the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.extract import safe_url


def stable_id(*parts: Column) -> Column:
    """An event id from the digest of its parts; null if a part is null."""
    h = F.sha2(F.concat(*[x for p in parts for x in (F.length(p).cast("string"), F.lit(":"), p)]), 256)
    return F.concat(F.lit("evt_"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-4"), F.substring(h, 14, 3), F.lit("-8"), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def crawled(records: DataFrame) -> DataFrame:
    """(event_id, kind, title, body, url, ts, type, target) of records(source, id, title, url, text, content_hash, retrieved_at).

    A record gives a revision, which is the same whenever the same content comes, and an acquisition of it, one per
    retrieval, that is derived from the revision.
    """
    revision = stable_id(F.lit("revision"), F.col("source"), F.col("id"), F.col("content_hash"))
    r = records.withColumn("revision", revision)
    first = r.groupBy("revision").agg(F.min_by(F.struct("title", "text", "url", "retrieved_at"), "retrieved_at").alias("f")).where("revision is not null")
    a = first.select(F.col("revision").alias("event_id"), F.lit("source").alias("kind"), "f.title", F.col("f.text").alias("body"), safe_url(F.col("f.url")).alias("url"), F.col("f.retrieved_at").alias("ts"), F.lit(None).cast("string").alias("type"), F.lit(None).cast("string").alias("target"))
    got = stable_id(F.lit("acquisition"), F.col("revision"), F.col("retrieved_at").cast("string"))
    b = r.where("revision is not null and retrieved_at is not null").select(got.alias("event_id"), F.lit("artifact").alias("kind"), F.concat(F.lit("Acquired "), F.coalesce("title", F.lit(""))).alias("title"), F.lit(None).cast("string").alias("body"), safe_url(F.col("url")).alias("url"), F.col("retrieved_at").alias("ts"), F.lit("derived_from").alias("type"), F.col("revision").alias("target"))
    return a.union(b.dropDuplicates(["event_id"]))


# fixed values: what a run's event is, by the beginning of its type
RUN_KINDS = {"approval": "approval", "tool.request": "tool.requested", "tool": "tool.completed", "artifact": "artifact", "decision": "decision", "run.start": "session.started"}


def run_events(records: DataFrame) -> DataFrame:
    """(event_id, kind, run, sequence, ts) of records(run, sequence, type, ts): the id follows from run and sequence."""
    kind = F
    for k, v in RUN_KINDS.items():
        kind = kind.when(F.startswith("type", F.lit(k)), v)
    return records.select(stable_id(F.col("run"), F.col("sequence").cast("string")).alias("event_id"), kind.otherwise("claim").alias("kind"), "run", "sequence", "ts")
