"""Incremental ingestion: files of events as a stream, kept once, in order, and written batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 16) -> DataFrame:
    """Parquet files of a folder, or one file, as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def once_by(stream: DataFrame, ids: list[str], event_time: str | None = None, lateness: str = "7 days") -> DataFrame:
    """The stream with the first row of each ids. With an event time the state is bounded: repeats that are later than lateness aren't known any more."""
    if event_time is None:
        return stream.dropDuplicates(ids)
    return stream.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(ids)


def run_to_table(stream: DataFrame, path: str) -> DataFrame:
    """Runs a stream over what is there and returns the written table.

    Each micro-batch overwrites the folder of its own number, so a batch that is run again after a failure leaves its
    rows once.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/batch={number}")

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table/batch=*")


_STATUS = "producer string, number long, status string"


def _continuity(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    head, last = state.get if state.exists else (0, None)
    # a producer's rows of a micro-batch come in several Arrow batches; only when all are there is their order known
    rows = pd.concat(list(batches)).sort_values("number", kind="stable")
    out = []
    for n, own, before in zip(rows["number"], rows["hash"], rows["previous"]):
        n = int(n)
        status = "replay" if n <= head else "gap" if n > head + 1 else "broken" if before is not None and last is not None and before != last else "next"
        out.append((key[0], n, status))
        if n > head:
            head, last = n, own
    state.update((head, last))
    for i in range(0, len(out), 10_000):
        yield pd.DataFrame(out[i : i + 10_000], columns=["producer", "number", "status"])


def sequence_continuity(stream: DataFrame) -> DataFrame:
    """(producer, number, status) of a stream(producer, number[, hash, previous]): next if it follows the producer's head, replay if not above it, gap if numbers are missing before it, broken if it follows but names another hash as the one before it.

    The state is the head's number and hash of each producer. Within a micro-batch numbers are taken in order, for which
    one producer's numbers and hashes of the micro-batch are held by one task; maxFilesPerTrigger bounds them.
    """
    text = lambda c: (F.col(c) if c in stream.columns else F.lit(None)).cast("string").alias(c)
    return stream.select("producer", "number", text("hash"), text("previous")).groupBy("producer").applyInPandasWithState(_continuity, _STATUS, "head long, last string", "append", GroupStateTimeout.NoTimeout)


def statuses(rows: DataFrame) -> DataFrame:
    """The same for a table: what each number of a producer is, numbers in order."""
    from pyspark.sql import Window

    before = F.coalesce(F.lag("number").over(Window.partitionBy("producer").orderBy("number")), F.lit(0))
    return rows.select("producer", "number", F.when(F.col("number") == before + 1, "next").when(F.col("number") <= before, "replay").otherwise("gap").alias("status"))
