"""Problem 7: filling containers of fixed capacity with items, with little space left.

Each partition keeps a fixed number of open windows. An item goes into the open window that it fills best; if it fits
none and all windows are in use, the fullest is emitted. What the partitions leave open is merged: windows are items
again and are packed in groups of partitions, round after round, so that no task sees all of them.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.runtime import staged

CAPACITY = 2048
#: Open windows per partition.
WINDOWS = 256
#: Partitions whose leftovers are merged by one task.
FAN_IN = 64


class OpenWindows:
    """A bounded set of open windows, kept by free space."""

    def __init__(self, capacity: int, windows: int) -> None:
        self.capacity, self.windows = capacity, windows
        self.free: list[tuple[int, int]] = []  # (free space, window)
        self.made = 0
        self.used: dict[int, int] = {}  # items in each open window

    def add(self, size: int) -> tuple[int, int, tuple[int, int] | None]:
        """Places an item: its window, its place there from 1, and (window, filled) if one was emitted."""
        i = bisect_left(self.free, (size, -1))
        out = None
        if i < len(self.free):
            space, window = self.free.pop(i)
        else:
            if len(self.free) >= self.windows:
                space, window = self.free.pop(0)  # the fullest
                self.used.pop(window)
                out = (window, self.capacity - space)
            space, window = self.capacity, self.made
            self.made += 1
            self.used[window] = 0
        self.used[window] += 1
        insort(self.free, (space - size, window))
        return window, self.used[window], out


def _first_round(capacity: int, windows: int):
    """Items -> rows of items placed in windows, and rows (piece_no null) of windows left open with what fills them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, packer, cut = TaskContext.get().partitionId(), OpenWindows(capacity, windows), 0
        names = ["window", "place", "doc_id", "piece_no", "n_tokens", "part"]
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])

            def put(*row: object) -> None:
                for x, v in zip(out, row):
                    x.append(v)

            for doc, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                piece = 1
                while n > capacity:
                    # a whole container by itself
                    put(f"c{part}-{cut}", 1, doc, piece, capacity)
                    cut, piece, n = cut + 1, piece + 1, n - capacity
                if n:
                    window, place, _ = packer.add(n)
                    put(f"w{part}-{window}", place, doc, piece, n)
            yield _batch(out, part, names)
        still = [(f"w{part}-{w}", packer.used[w], None, None, capacity - space) for space, w in packer.free]
        yield _batch(tuple(map(list, zip(*still))) if still else ([],) * 5, part, names)

    return run


def _batch(out: tuple[list, ...], part: int, names: list[str]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([*(pa.array(v, k) for v, k in zip(out, kinds)), pa.array([part] * len(out[0]), pa.int32())], names=names)


_MERGED = "window string, into string, base int, filled int, items int, is_open boolean, part int"


def _merge(capacity: int, windows: int, round_no: int, last: bool):
    """Leftover windows, largest first -> the window each goes into and the number of items before it there."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("filled", "window", "items", "task"))), key=lambda r: (-r[0], r[1]))
        packer, into, filled, items = OpenWindows(capacity, len(rows) + 1 if last else windows), [], {}, {}
        for size, window, n, task in rows:
            w, _, _ = packer.add(size)
            into.append((window, w, items.get(w, 0)))
            filled[w], items[w] = filled.get(w, 0) + size, items.get(w, 0) + n
        open_ = set() if last else {w for _, w in packer.free}
        task = rows[0][3] if rows else 0
        return pa.table(
            {"window": pa.array([x for x, _, _ in into], pa.string()), "into": pa.array([f"m{round_no}-{task}-{w}" for _, w, _ in into], pa.string()), "base": pa.array([x for _, _, x in into], pa.int32()),
             "filled": pa.array([filled[w] for _, w, _ in into], pa.int32()), "items": pa.array([items[w] for _, w, _ in into], pa.int32()), "is_open": pa.array([w in open_ for _, w, _ in into], pa.bool_()), "part": pa.array([task] * len(into), pa.int32())}
        )

    return run


def fill_containers(items: DataFrame, capacity: int = CAPACITY, windows: int = WINDOWS, fan_in: int = FAN_IN) -> DataFrame:
    """(container_id, place, doc_id, piece_no, n_tokens) of items(doc_id, n_tokens).

    Items without tokens (0 or null) are in no container; one of more than capacity is cut into pieces, all but the
    last of them full. place counts from 1 in a container. Stages the placed items and each merge round; a merge task
    holds at most fan_in * windows windows.
    """
    sized = items.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0").sortWithinPartitions("doc_id")
    placed = staged(sized.mapInArrow(_first_round(capacity, windows), "window string, place int, doc_id long, piece_no int, n_tokens int, part int"), "placed")
    left = placed.where("piece_no is null").select("window", F.col("n_tokens").alias("filled"), F.col("place").alias("items"), "part")
    moves = None
    parts = (left.agg(F.max("part")).first()[0] or 0) + 1
    round_no = 0
    while True:
        last = parts <= fan_in
        tasks = left.withColumn("task", F.floor(F.col("part") / fan_in).cast("int"))
        merged = staged(tasks.groupBy("task").applyInArrow(_merge(capacity, windows, round_no, last), _MERGED), f"merge{round_no}")
        step = merged.select("window", "into", "base")
        if moves is None:
            moves = step
        else:
            again = step.select(F.col("window").alias("into"), F.col("into").alias("to"), F.col("base").alias("more"))
            moves = moves.join(again, "into", "left").select("window", F.coalesce("to", "into").alias("into"), (F.col("base") + F.coalesce("more", F.lit(0))).alias("base"))
        if last:
            break
        left = merged.where("is_open").groupBy(F.col("into").alias("window")).agg(F.max("filled").alias("filled"), F.max("items").alias("items"), F.max("part").alias("part"))
        parts, round_no = -(-parts // fan_in), round_no + 1
    return placed.where("piece_no is not null").join(moves, "window", "left").select(
        F.coalesce("into", "window").alias("container_id"), (F.col("place") + F.coalesce("base", F.lit(0))).alias("place"), "doc_id", "piece_no", "n_tokens"
    )


def space(filled: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, lower_bound (tokens / capacity, rounded up) and unused, the share of the containers' space that is left (0 without containers)."""
    t = filled.groupBy("container_id").agg(F.sum("n_tokens").alias("n")).agg(F.count("*").alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"))
    return t.select("containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("lower_bound"), F.when(F.col("containers") > 0, F.round(1 - F.col("tokens") / (F.col("containers") * capacity), 6)).otherwise(0.0).alias("unused"))
