"""Event logs of one JSON object per line, and project trees, as tables."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimark.operators.readmodel import language

_S = T.StringType()
EVENT = T.StructType(
    [T.StructField(n, _S) for n in ("schemaVersion", "eventId", "timestamp", "workspaceId", "sessionId", "turnId", "kind")]
    + [T.StructField("actor", T.StructType([T.StructField("type", _S), T.StructField("id", _S)]))]
    + [T.StructField(n, _S) for n in ("title", "body", "data", "confidence")]
    + [
        T.StructField("authority", T.StructType([T.StructField("scope", _S), T.StructField("rank", T.IntegerType()), T.StructField("assignedAt", _S), T.StructField("expiresAt", _S), T.StructField("revokedAt", _S)])),
        T.StructField("temporal", T.StructType([T.StructField("validFrom", _S), T.StructField("validUntil", _S)])),
        T.StructField("repository", T.StructType([T.StructField("id", _S), T.StructField("branch", _S), T.StructField("commit", _S)])),
        T.StructField("disclosure", T.StructType([T.StructField("scopes", T.ArrayType(_S)), T.StructField("classification", _S)])),
        T.StructField("relations", T.ArrayType(T.StructType([T.StructField("type", _S), T.StructField("target", _S)]))),
        T.StructField("retention", T.StructType([T.StructField("class", _S), T.StructField("expiresAt", _S)])),
        T.StructField("previousHash", _S), T.StructField("hash", _S),
    ]
)


def canonical_json(text: str | None) -> str | None:
    """JSON with keys sorted at every depth and no spaces; null if it isn't JSON."""
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(canonical_json)


def canonical(c: Column) -> Column:
    """Canonical JSON of a text of any shape; needs Python, since keys are open."""
    return _canonical(c)


def content_hash(c: Column) -> Column:
    """Hash of an envelope: sha256 of its canonical JSON."""
    return F.concat(F.lit("sha256:"), F.sha2(canonical(c), 256))


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, problem, event) of a log: problem names why a line is refused (blank, not an object, no id), else it is null.

    A line's order within the log is its own hash chain, not its place in a file.
    """
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.from_json("value", EVENT).alias("event"))
    problem = F.when(F.trim("line") == "", "blank").when(F.try_parse_json("line").isNull() | F.col("event").isNull() | ~F.startswith(F.trim("line"), F.lit("{")), "not an object").when(F.col("event.eventId").isNull(), "no id")
    return rows.select("line", problem.alias("problem"), "event")


def write_log(events: DataFrame, path: str) -> None:
    """Writes events(struct column event) as one canonical object per line."""
    events.select(canonical(F.to_json("event")).alias("value")).write.mode("overwrite").text(path)


def project_files(spark: SparkSession, path: str, max_bytes: int = 4 << 20) -> DataFrame:
    """(path, bytes, hash, language, is_binary) of the files below a folder; larger ones are listed without hash.

    A file is binary if its first 8,192 bytes hold a zero byte or more than 3 % control bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    head = F.hex(F.substring("content", 1, 8192))
    apart = F.regexp_replace(head, "(..)", "$1 ")
    zero, control = F.regexp_count(apart, F.lit("00 ")), F.regexp_count(apart, F.lit(r"(?:0[1-8]|0E|0F|1[0-9A-F]) "))
    small = F.col("length") <= max_bytes
    return files.select("path", F.col("length").alias("bytes"), F.when(small, F.concat(F.lit("sha256:"), F.sha2("content", 256))).alias("hash"), language(F.col("path")).alias("language"), ((zero > 0) | (control > 0.03 * F.least(F.col("length"), F.lit(8192)))).alias("is_binary"))


def publish(views: dict[str, DataFrame], path: str) -> str:
    """Writes derived views as a new version below path and then names it the current one; gives the version.

    Versions are numbered folders; the current one is the highest that has a marker, which is written last. A reader
    never sees half a version, and none is deleted under it (see prune).
    """
    spark = next(iter(views.values())).sparkSession
    number = (_versions(spark, path) or [0])[-1] + 1
    for name, df in views.items():
        df.write.mode("overwrite").parquet(f"{path}/{number:010d}/{name}")
    fs, at = _fs(spark, path)
    if not fs.createNewFile(at(f"{path}/current-{number:010d}")):
        raise RuntimeError(f"version {number} was published by someone else")
    return f"{number:010d}"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the published versions in order."""
    fs, at = _fs(spark, path)
    return sorted(int(f.getPath().getName()[8:]) for f in (fs.globStatus(at(f"{path}/current-*")) or []))


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A view of the current version."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]:010d}/{name}")


def prune(spark: SparkSession, path: str, keep: int = 2) -> None:
    """Deletes all but the last versions."""
    fs, at = _fs(spark, path)
    for n in _versions(spark, path)[:-keep]:
        fs.delete(at(f"{path}/current-{n:010d}"), False)
        fs.delete(at(f"{path}/{n:010d}"), True)


def verified(rows: DataFrame, workspace: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with problem, summary) of the lines of read_log: summary has ok, count, head and the number of each problem.

    A line is refused if it is blank, no JSON object, not in canonical form, without id, of another workspace, if its
    hash isn't that of the rest of it, or if its id came before. Lines are chained by their hashes: a line whose
    previous hash no line has is an orphan, of two with the same previous hash one is a fork, and a whole log has one
    root and one head. All of it is joins, so a long log is checked in parallel.
    """
    own = F.get_json_object("line", "$.hash")
    text = rows.withColumn("canonical", canonical(F.col("line")))
    problem = F.coalesce(
        "problem", F.when(F.col("canonical") != F.col("line"), "not canonical"), F.when(F.lit(workspace is not None) & ~F.col("event.workspaceId").eqNullSafe(F.lit(workspace)), "workspace"), F.when(~own.eqNullSafe(content_hash(_unhashed(F.col("line")))), "hash"),
    )
    checked = text.withColumn("problem", problem).drop("canonical")
    good = checked.where("problem is null").select("event.eventId", "event.hash", "event.previousHash")
    repeats = good.groupBy("eventId").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("repeated"))
    heads = good.select(F.col("hash").alias("previousHash")).distinct()
    linked = good.where("previousHash is not null")
    orphans = linked.join(heads, "previousHash", "left_anti").agg(F.count("*").alias("orphans"))
    forks = linked.groupBy("previousHash").count().where("count > 1").agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("forks"))
    ends = good.join(linked.select(F.col("previousHash").alias("hash")), "hash", "left_anti").agg(F.count("*").alias("ends"), F.min("hash").alias("head"))
    count = checked.agg(F.count("*").alias("count"), F.count("problem").alias("refused"), F.count_if(F.col("problem").isNull() & F.col("event.previousHash").isNull()).alias("roots"))
    s = count.crossJoin(repeats).crossJoin(orphans).crossJoin(forks).crossJoin(ends)
    ok = (F.col("refused") == 0) & (F.col("repeated") == 0) & (F.col("orphans") == 0) & (F.col("forks") == 0) & ((F.col("count") == 0) | ((F.col("roots") == 1) & (F.col("ends") == 1)))
    return checked, s.select(ok.alias("ok"), "count", F.when(F.col("ends") == 1, F.col("head")).alias("head"), "refused", "repeated", "roots", "orphans", "forks")


@F.pandas_udf(_S)
def _without_hash(s: pd.Series) -> pd.Series:
    def bare(text: str | None) -> str | None:
        try:
            value = json.loads(text)
        except (TypeError, ValueError):
            return None
        return json.dumps({k: v for k, v in value.items() if k != "hash"}, ensure_ascii=False) if isinstance(value, dict) else None

    return s.map(bare)


def _unhashed(c: Column) -> Column:
    return _without_hash(c)


def chained(events: list[dict]) -> list[str]:
    """Canonical lines of envelopes, each with the hash of the one before it and its own; for logs that one writer appends to."""
    lines, previous = [], None
    for e in events:
        bare = {k: v for k, v in e.items() if k != "hash"} | {"previousHash": previous}
        text = json.dumps(bare, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        previous = "sha256:" + hashlib.sha256(text.encode()).hexdigest()
        lines.append(json.dumps(bare | {"hash": previous}, ensure_ascii=False, sort_keys=True, separators=(",", ":")))
    return lines
