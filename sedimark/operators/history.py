"""Problem 4: the history of an attribute from restated values.

Snapshots (batches of statements) are co-partitioned by the same ranges of (entity, time) and each is written sorted,
once. A task merges the sorted files of its range from all snapshots, k ways, into one iterator, takes the statement
that holds of those with the same start, and emits a version when the payload changes or its period ends, so no history
is held in memory, a new snapshot is added without sorting the old ones, and an entity that has a third of all rows
spans many ranges. Versions at the ranges' edges are closed from a summary of two rows per range.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.identity import instant_ms, outer_trim
from sedimark.runtime import scratch, staged

OPEN = -1
#: Snapshots that one merge reads, at most; batches beyond are taken together.
RUNS = 16
#: Ranges that snapshots are cut into, at most, and keys that their bounds are taken from for each.
RANGES, KEYS = 512, 64
_FRAGMENT = "part_no int, fragment_no long, entity string, payload string, from_ms long, until_ms long, is_first boolean, is_last boolean"


def scope_statements(ledger: DataFrame) -> DataFrame:
    """(entity, payload, from_ms, until_ms, said, row_id, run) of the decisions: one row per entity, start and snapshot, the latest by event time (said, in microseconds; then the largest row_id).

    Rows whose start can't be read or that end before they begin are void; until_ms is -1 if open. A blank or
    unreadable end is none. The snapshot is the row's batch, modulo RUNS.
    """
    scope = F.lower(outer_trim(F.col("authority_scope")))
    start = F.when(F.coalesce(outer_trim(F.col("valid_from")), F.lit("")) == "", F.unix_millis("event_timestamp")).otherwise(instant_ms(F.col("valid_from")))
    run = F.pmod(F.coalesce("batch_id", F.lit(0)), F.lit(RUNS)).cast("int")
    rows = (
        ledger.where("kind = 'decision' and subject_id is not null")
        .select(F.col("subject_id").alias("entity"), scope.alias("payload"), start.alias("from_ms"), F.coalesce(instant_ms(F.col("valid_until")), F.lit(OPEN)).alias("until_ms"), F.coalesce(F.unix_micros("event_timestamp"), F.lit(-(2**63))).alias("said"), F.coalesce("row_id", F.lit(-(2**63))).alias("row_id"), run.alias("run"))
        .where((F.col("payload") != "") & F.col("from_ms").isNotNull() & ((F.col("until_ms") == OPEN) | (F.col("until_ms") > F.col("from_ms"))))
    )
    # combined before the shuffle, so that a start that is restated very often is one row a task
    latest = F.max_by(F.struct("payload", "until_ms", "said", "row_id"), F.struct("said", "row_id"))
    return rows.groupBy("entity", "from_ms", "run").agg(latest.alias("v")).select("entity", "v.payload", "from_ms", "v.until_ms", "v.said", "v.row_id", "run")


_SORTED = ["entity", "from_ms", "said", "row_id"]


def ranges(statements: DataFrame) -> list[tuple[str, int]]:
    """Bounds of as many ranges of (entity, from_ms) as the session has shuffle partitions, from a sample of keys of a fixed size."""
    n = min(RANGES, int(statements.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    total = statements.count()
    share = F.pmod(F.xxhash64("entity", "from_ms"), F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * 2 * n * KEYS / max(1, total)) + 1)
    keys = sorted({(r.entity, r.from_ms) for r in statements.where(share).select("entity", "from_ms").orderBy(F.xxhash64("entity", "from_ms")).limit(n * KEYS).collect()})
    return sorted({keys[i * len(keys) // n] for i in range(1, n)}) if keys else []


def write_snapshots(statements: DataFrame, bounds: list[tuple[str, int]], path: str) -> None:
    """Adds the snapshots (run) of statements below path, cut by bounds into ranges, each file sorted by entity and start. Runs that are there already must not come again."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(bounds, k) for k in zip(b.column("entity").to_pylist(), b.column("from_ms").to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], names=[*b.schema.names, "range"])

    rows = statements.select("entity", "payload", "from_ms", "until_ms", "said", "row_id", "run")
    kinds = "entity string, payload string, from_ms long, until_ms long, said long, row_id long, run int, range int"
    rows.mapInArrow(place, kinds).repartition("range").sortWithinPartitions("run", "range", *_SORTED).write.mode("append").partitionBy("run", "range").parquet(path)


def _files(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Addresses of the files below path by range, as Spark lists them; at most one for each snapshot and range."""
    out: dict[int, list[str]] = {}
    for f in sorted(spark.read.schema("entity string").parquet(path).inputFiles()):
        out.setdefault(int(f.rsplit("range=", 1)[1].split("/")[0]), []).append(f)
    return out


def _rows(address: str) -> Iterator[tuple]:
    """The rows of one sorted file, a batch at a time; raises if they aren't in order."""
    last: tuple = ("",)
    system, path = fs.FileSystem.from_uri(address)
    with system.open_input_file(path) as f:
        for b in pq.ParquetFile(f).iter_batches(batch_size=4096, columns=["entity", "from_ms", "said", "row_id", "payload", "until_ms"]):
            for r in zip(*(b.column(c).to_pylist() for c in ("entity", "from_ms", "said", "row_id", "payload", "until_ms"))):
                if r[:4] < last:
                    raise ValueError(f"{path} isn't sorted")
                last = r[:4]
                yield r


def _versions_in(number: int, in_order: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    """Fragments of one range's rows (entity, from_ms, said, row_id, payload, until_ms) in order."""
    names, m, n, out = [x.split()[0] for x in _FRAGMENT.split(", ")], _Merge(), 0, []
    for (entity, start), same in groupby(in_order, key=lambda r: r[:2]):
        # the latest said holds
        *_, (_, _, _, _, payload, until) = same
        if done := m.push(entity, payload, start, until):
            out.append([number, n, *done, n == 0, False])
            n += 1
            if len(out) == 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
    if m.pending:
        out.append([number, n, *m.pending, n == 0, True])
    if out:
        yield pd.DataFrame(out, columns=names)


def readable(files: dict[int, list[str]]) -> bool:
    """Whether the files can be read without Spark: so it is where the shared folder is mounted, or its store's client is installed."""
    try:
        for f in files.values():
            system, path = fs.FileSystem.from_uri(f[0])
            return system.get_file_info(path).is_file
    except (OSError, ValueError, ImportError):
        return False
    return True


def merged(spark: SparkSession, path: str, n_ranges: int) -> DataFrame:
    """Fragments of versions of each range: its sorted files from all snapshots merged k ways. Stages.

    Executors read the files themselves. Where a store can only be read by Spark, the ranges' rows are sorted anew instead.
    """
    files = _files(spark, path)

    def from_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number in (int(i) for b in batches for i in b["id"]):
            yield from _versions_in(number, heapq.merge(*(_rows(f) for f in files.get(number, ())), key=lambda r: r[:4]))

    def from_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for b in batches for r in b.itertuples(index=False, name=None))
        for number, own in groupby(rows, key=lambda r: r[0]):
            yield from _versions_in(number, (r[1:] for r in own))

    if readable(files):
        found = spark.range(0, n_ranges, 1, n_ranges).mapInPandas(from_files, _FRAGMENT)
    else:
        kinds = "entity string, payload string, from_ms long, until_ms long, said long, row_id long, run int, range int"
        rows = spark.read.schema(kinds).parquet(path).select("range", *_SORTED, "payload", "until_ms")
        found = rows.repartition("range").sortWithinPartitions("range", *_SORTED).mapInPandas(from_rows, _FRAGMENT)
    return staged(found, "fragments")


class _Merge:
    """Turns an ordered run of statements into versions; a version stays pending until what follows is known."""

    def __init__(self) -> None:
        self.pending: list | None = None  # entity, payload, from, until

    def push(self, entity: str, payload: str, start: int, until: int) -> list | None:
        p = self.pending
        if p and p[0] == entity:
            if p[3] == OPEN or p[3] > start:
                p[3] = start
            if p[1] == payload and p[3] == start:
                p[3] = until
                return None
        self.pending = [entity, payload, start, until]
        return p


def _stitch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the edge fragments in order: what becomes of each (merged into an earlier one: dropped; else its end)."""
    keep: list = []  # part, fragment, entity, payload, from, until
    out: list[list] = []
    cut = lambda r, drop: out.append([r[0], r[1], r[5], drop])
    for b in batches:
        for r in b[["part_no", "fragment_no", "entity", "payload", "from_ms", "until_ms", "is_last"]].itertuples(index=False):
            if keep and keep[2] == r.entity and keep[6]:
                if keep[5] == OPEN or keep[5] > r.from_ms:
                    keep[5] = r.from_ms
                if keep[3] == r.payload and keep[5] == r.from_ms:
                    keep[5], keep[6] = r.until_ms, r.is_last
                    cut(r, True)
                    continue
            if keep:
                cut(keep, False)
            keep = list(r)
        if out:
            yield pd.DataFrame(out, columns=["part_no", "fragment_no", "end_ms", "dropped"])
            out = []
    if keep:
        cut(keep, False)
        yield pd.DataFrame(out, columns=["part_no", "fragment_no", "end_ms", "dropped"])


def _bases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each partition's first and last entity with its count of versions: the versions of the first in earlier partitions."""
    total, last, out = 0, None, []
    for b in batches:
        for r in b.itertuples(index=False):
            if r.first_entity == last:
                out.append([r.part_no, last, total])
            if r.first_entity != r.last_entity or last != r.first_entity:
                total = 0
            total, last = total + r.last_count, r.last_entity
    yield pd.DataFrame(out, columns=["part_no", "entity", "base_no"])


def versions(statements: DataFrame) -> DataFrame:
    """(entity, version_no, payload, from_ms, until_ms) of statements(entity, payload, from_ms, until_ms, said, row_id, run).

    Of an entity's statements with the same start the latest said holds. Each holds until its own end or the next
    statement, whichever is first; periods of one payload that touch are one version. No null entities. Stages.
    """
    spark = statements.sparkSession
    statements = staged(statements, "statements")
    bounds, path = ranges(statements), scratch(spark, "snapshots")
    write_snapshots(statements, bounds, path)
    return numbered(merged(spark, path, len(bounds) + 1))


def numbered(fragments: DataFrame) -> DataFrame:
    """The versions of merged fragments, those at the edges closed, numbered by entity. What is joined by broadcast is at most two rows per range."""
    edges = fragments.where("is_first or is_last").coalesce(1).sortWithinPartitions("part_no", "fragment_no")
    fixes = edges.mapInPandas(_stitch, "part_no int, fragment_no long, end_ms long, dropped boolean")
    fixed = (
        fragments.join(F.broadcast(fixes), ["part_no", "fragment_no"], "left")
        .where("dropped is null or not dropped")
        .select("part_no", "fragment_no", "entity", "payload", "from_ms", F.coalesce("end_ms", "until_ms").alias("until_ms"))
    )
    # fragments of a partition are numbered in order, so a version's number in its partition needs no sort
    counts = fixed.groupBy("part_no", "entity").agg(F.min("fragment_no").alias("start_no"), F.count("*").alias("n"))
    ends = counts.groupBy("part_no").agg(F.min("entity").alias("first_entity"), F.max("entity").alias("last_entity"), F.max_by("n", "entity").alias("last_count"))
    bases = ends.coalesce(1).sortWithinPartitions("part_no").mapInPandas(_bases, "part_no int, entity string, base_no long")
    numbered = fixed.join(counts.select("part_no", "entity", "start_no"), ["part_no", "entity"]).join(F.broadcast(bases), ["part_no", "entity"], "left")
    return numbered.select("entity", (F.col("fragment_no") - F.col("start_no") + 1 + F.coalesce("base_no", F.lit(0))).alias("version_no"), "payload", "from_ms", "until_ms")
