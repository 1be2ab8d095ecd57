"""Problem 5: one row per message although messages were delivered at least once.

Identifiers that a producer numbers (call_0001, call_0002, ...) go through disjoint ranges of seen numbers: an
uncovered number is accepted once and its range merged with its neighbours, a covered one is a repeat. All other
identifiers are resolved by an exact lookup on the whole key. Both give the keys that were delivered more than once;
only their rows move further.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.identity import canonical_id, hook_name
from sedimark.runtime import staged

#: A producer's numbers are kept in blocks of this many, so that one producer never fills one task.
BLOCK = 1 << 16


class SeenRanges:
    """Disjoint inclusive ranges of numbers, kept sorted."""

    def __init__(self) -> None:
        self.lo: list[int] = []
        self.hi: list[int] = []

    def accept(self, n: int) -> bool:
        """True the first time n comes; merges n with ranges that it touches."""
        i = bisect_right(self.lo, n)
        if i and self.hi[i - 1] >= n:
            return False
        left, right = i > 0 and self.hi[i - 1] == n - 1, i < len(self.lo) and self.lo[i] == n + 1
        if left and right:
            self.hi[i - 1] = self.hi[i]
            del self.lo[i], self.hi[i]
        elif left:
            self.hi[i - 1] = n
        elif right:
            self.lo[i] = n
        else:
            self.lo.insert(i, n)
            self.hi.insert(i, n)
        return True


_NUMBERED = "message_key string, producer string, block long, number long, repeated boolean"


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Before the shuffle: each number of a batch once, so that an identifier that most rows carry costs one row a batch."""
    for b in batches:
        twice = b["message_key"].duplicated(keep=False)
        yield b.assign(repeated=twice).drop_duplicates("message_key")


def _repeats(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of rows clustered by producer and block: the keys whose number was covered already."""
    at, seen = None, SeenRanges()
    for b in batches:
        hit = []
        for i, (producer, block, number, repeated) in enumerate(zip(b["producer"], b["block"], b["number"], b["repeated"])):
            if (producer, block) != at:
                at, seen = (producer, block), SeenRanges()
            if not seen.accept(number) or repeated:
                hit.append(i)
        if hit:
            yield b.iloc[hit][["message_key"]]


def repeated_members(rows: DataFrame) -> DataFrame:
    """Of rows(rid long, producer string, ident string, ...): those whose (producer, ident) came more than once, with message_key.

    Rows with a null producer or ident are never copies. Extra columns pass through.
    """
    keyed = rows.where("producer is not null and ident is not null").withColumn("message_key", F.concat_ws("\x1f", "producer", "ident"))
    number = F.regexp_extract("ident", r"^[a-z]{1,12}[_-](\d{1,15})$", 1)
    numbered = keyed.where(number != "").select(
        "message_key",
        # the width and the prefix belong to the producer, so that call_1 and call_0001 differ
        F.concat_ws("\x1f", "producer", F.regexp_extract("ident", r"^([a-z]{1,12}[_-])\d", 1), F.length(number).cast("string")).alias("producer"),
        number.cast("long").alias("number"),
    ).select("message_key", "producer", F.floor(F.col("number") / BLOCK).cast("long").alias("block"), "number").mapInPandas(_combined, _NUMBERED)
    by_range = numbered.repartition("producer", "block").sortWithinPartitions("producer", "block").mapInPandas(_repeats, "message_key string")
    by_lookup = keyed.where(number == "").groupBy("message_key").count().where("count > 1").select("message_key")
    return keyed.join(by_range.union(by_lookup).distinct(), "message_key", "left_semi")


def ledger_keys(ledger: DataFrame) -> DataFrame:
    """rid, producer, ident, version (hash) and arrival of ledger rows. All rows count as one producer: event ids are global."""
    return ledger.select(F.col("row_id").alias("rid"), F.lit("ledger").alias("producer"), canonical_id(F.col("event_id")).alias("ident"), canonical_id(F.col("event_hash")).alias("version"), "batch_id", "received_at")


def hook_keys(hooks: DataFrame) -> DataFrame:
    """rid, producer, ident, version and arrival of hook rows; the producer is session and hook name, the identifier the tool use or, for prompts and stops, the prompt."""
    name = hook_name(F.col("hook_event_name"))
    ident = F.when(name.isin("userpromptsubmit", "stop"), canonical_id(F.col("prompt_id"))).otherwise(canonical_id(F.col("tool_use_id")))
    session = canonical_id(F.col("session_id"))
    return hooks.select(F.col("hook_id").alias("rid"), F.when(session.isNotNull() & name.isNotNull(), F.concat_ws("\x1f", session, name)).alias("producer"), ident.alias("ident"), F.lit(None).cast("string").alias("version"), "batch_id", "received_at")


def copy_pairs(keys: DataFrame, source: str) -> DataFrame:
    """Pairs (source_table, lo_id, hi_id) of rows with the same key and no two different versions.

    Every pair is asked for, so a group of n copies gives n(n-1)/2 rows; the join streams and spills, no group is
    collected. Null versions fit any.
    """
    # written once: canonical spellings are the dearest part, and four branches start from them
    keys = staged(keys.select("rid", "producer", "ident", "version"), "keys")
    members = repeated_members(keys).select("message_key", "rid", "version")
    a, b = members.alias("a"), members.alias("b")
    fits = F.col("a.version").isNull() | F.col("b.version").isNull() | (F.col("a.version") == F.col("b.version"))
    return a.join(b, (F.col("a.message_key") == F.col("b.message_key")) & (F.col("a.rid") < F.col("b.rid")) & fits).select(
        F.lit(source).alias("source_table"), F.col("a.rid").alias("lo_id"), F.col("b.rid").alias("hi_id")
    )


def once(df: DataFrame, keys: DataFrame, row_id: str) -> DataFrame:
    """df with one row per message: the first delivered (batch, time received, row).

    Rows without identifiers all stay. Where copies fit several versions (a missing version), they count as copies of
    the version that came first.
    """
    keys = staged(keys, "keys")
    members = repeated_members(keys).withColumn("arrival", F.struct("batch_id", "received_at", "rid"))
    first = members.groupBy("message_key").agg(F.min_by("version", F.when(F.col("version").isNotNull(), F.col("arrival"))).alias("first_version"))
    versioned = members.join(first, "message_key").withColumn("held", F.coalesce("version", "first_version"))
    winners = versioned.groupBy("message_key", "held").agg(F.min("arrival").alias("arrival")).select(F.col("arrival.rid").alias("rid"))
    losers = members.select("rid").join(winners, "rid", "left_anti")
    return df.join(losers.withColumnRenamed("rid", row_id), row_id, "left_anti")
