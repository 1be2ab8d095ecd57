"""A persisted index: events by id in buckets, postings by term in buckets, lengths, and the state that tells whether it is stale."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.text import terms

BUCKETS = 256


def _bucket(c):
    return F.substring(F.sha2(c, 256), 1, 2)


def _bucket_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:2]


def write_by_id(events: DataFrame, path: str) -> None:
    """Writes events(eid, ...) in 256 folders by the digest of the id, one file each or more if a folder is large."""
    events.withColumn("bucket", _bucket(F.col("eid"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def by_id(spark: SparkSession, path: str, ids: list[str]) -> DataFrame:
    """The events of at most some thousand ids; only the folders of their buckets are read, and of these the row groups that can hold them."""
    rows = spark.read.option("basePath", path).schema(spark.read.parquet(path).schema).parquet(path)
    return rows.where(F.col("bucket").isin(sorted({_bucket_of(i) for i in ids})) & F.col("eid").isin(ids)).drop("bucket")


def state(events: DataFrame) -> DataFrame:
    """One row: number of events(eid, seq), last row and the sum of digests of ids and rows, which doesn't hang on their order."""
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", "eid", "seq"), 256), 1, 8), 16, 10).cast("long")
    return events.agg(F.count("*").alias("n_events"), F.max("seq").alias("last_seq"), F.coalesce(F.sum(h), F.lit(0)).alias("digest"))


def write_index(events: DataFrame, text, path: str) -> None:
    """Writes postings (term, eid, tf, in_title) by bucket of the term, lengths (eid, ts, dl) and the state of events(eid, seq, ts, title, ...); text is the searched column."""
    rows = events.select("eid", "seq", "ts", terms(text).alias("t"), terms(F.col("title")).alias("title"))
    one = rows.select("eid", "title", F.explode("t").alias("term")).groupBy("term", "eid").agg(F.count("*").alias("tf"), F.max(F.array_contains("title", F.col("term"))).alias("in_title"))
    one.withColumn("bucket", _bucket(F.col("term"))).repartition("bucket", _bucket(F.col("eid"))).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.select("eid", "ts", F.size("t").alias("dl")).write.mode("overwrite").parquet(f"{path}/lengths")
    state(events).write.mode("overwrite").parquet(f"{path}/state")


def is_stale(spark: SparkSession, path: str, events: DataFrame) -> bool:
    """Whether the index was made of other events than these."""
    return spark.read.parquet(f"{path}/state").first() != state(events).first()


def bm25(spark: SparkSession, path: str, query: list[str], k1: float = 1.2, b: float = 0.75, title_boost: float = 1.0) -> DataFrame:
    """(eid, ts, score) of the query's distinct terms from the index alone: only the postings of these terms are read, no text."""
    from sedimark.functions.text import rounded

    lengths = spark.read.parquet(f"{path}/lengths")
    rows = spark.read.parquet(f"{path}/postings").where(F.col("bucket").isin(sorted({_bucket_of(t) for t in query})) & F.col("term").isin(query)).drop("bucket")
    stats = lengths.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # a row per term of the query
    df = rows.groupBy("term").agg(F.count("*").alias("df"))
    joined = rows.join(F.broadcast(df), "term").join(lengths, "eid").crossJoin(F.broadcast(stats))
    idf = F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * (F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))) * F.when(F.col("in_title"), title_boost).otherwise(1.0)
    # at most one row per term of the query; added in the terms' order
    gathered = joined.select("eid", "ts", "term", part.alias("part")).groupBy("eid").agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("term", "part"))).alias("p"))
    return gathered.select("eid", "ts", rounded(F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"])).alias("score")).where("score > 0")
