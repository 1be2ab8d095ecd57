"""Numbering rows in order within keys, when a key may hold a third of all rows.

Rows are range-partitioned by key and order, so that a large key spans several partitions; each partition is one
sorted iterator, and what the partitions' edges lack comes from a summary of one row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimark.runtime import staged


def key_sorted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Range-partitioned and sorted by the columns; a partition's rows are the merge of its sorted runs."""
    return df.repartitionByRange(*columns).sortWithinPartitions(*columns)


def positions(df: DataFrame, key: str, order: list[str], carry: list[str]) -> DataFrame:
    """Adds row_no (from 1, by order within key) and prev_<c> for each c of carry (null in a key's first row).

    key must not be null. Ties in order get an arbitrary but single order. The edges are joined back by broadcast;
    they are at most one row per partition. Stages its input once.
    """
    kept = df.columns
    fields = {f.name: f.dataType for f in df.schema.fields}
    local = T.StructType(
        df.schema.fields
        + [T.StructField("part_no", T.IntegerType()), T.StructField("local_no", T.LongType()), T.StructField("is_last", T.BooleanType())]
        + [T.StructField(f"prev_{c}", fields[c]) for c in carry]
    )

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last_key, count, prev, held = TaskContext.get().partitionId(), None, 0, {}, None
        for b in batches:
            if b.empty:
                continue
            n = b.groupby(key, sort=False).cumcount() + 1
            same = b[key] == last_key
            b = b.assign(part_no=part, local_no=n.where(~same, n + count), is_last=False)
            starts = (b["local_no"] == 1).to_numpy()
            for c in carry:
                shifted = b[c].astype(object).shift(1)
                if len(b) and same.iloc[0]:
                    shifted.iloc[0] = prev[c]
                b[f"prev_{c}"] = shifted.where(~pd.Series(starts, index=b.index), None)
            last_key, count = b[key].iloc[-1], int(b["local_no"].iloc[-1])
            prev = {c: b[c].iloc[-1] for c in carry}
            if held is not None:
                yield held
            held = b
        if held is not None:
            held.iloc[-1, held.columns.get_loc("is_last")] = True
            yield held

    rows = staged(key_sorted(df, [key, *order]).mapInPandas(number, local), "positions")

    edge = T.StructType([T.StructField("part_no", T.IntegerType()), T.StructField(key, fields[key]), T.StructField("base_no", T.LongType())] + [T.StructField(f"edge_{c}", fields[c]) for c in carry])

    def carry_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, last_key, prev = 0, None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                if r["first_key"] == last_key:
                    out.append({"part_no": r["part_no"], key: last_key, "base_no": total} | {f"edge_{c}": prev[c] for c in carry})
                total = r["last_no"] + (total if r["first_key"] == last_key == r["last_key"] else 0)
                last_key, prev = r["last_key"], {c: r[f"last_{c}"] for c in carry}
            if out:
                yield pd.DataFrame(out, columns=edge.names)

    ends = rows.groupBy("part_no").agg(
        F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max_by("local_no", "is_last").alias("last_no"), *[F.max_by(c, "is_last").alias(f"last_{c}") for c in carry]
    )
    fixes = ends.coalesce(1).sortWithinPartitions("part_no").mapInPandas(carry_over, edge)
    joined = rows.join(F.broadcast(fixes), ["part_no", key], "left")
    first = F.col("local_no") == 1
    return joined.select(
        *kept,
        (F.col("local_no") + F.coalesce(F.col("base_no"), F.lit(0))).alias("row_no"),
        *[F.when(first & F.col("base_no").isNotNull(), F.col(f"edge_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in carry],
    )


def last_seen(df: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds last_<value>: the value of the nearest earlier row of the same key that has one.

    key must not be null. Each range partition carries values forward by itself; what its first key has seen before
    comes from a summary of one row per partition. Stages its input once.
    """
    kind = df.schema[value].dataType
    local = T.StructType(df.schema.fields + [T.StructField("part_no", T.IntegerType()), T.StructField("is_last", T.BooleanType()), T.StructField("seen", kind), T.StructField("upto", kind)])

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last_key, last, held = TaskContext.get().partitionId(), None, None, None
        for b in batches:
            if b.empty:
                continue
            own = b[value].astype(object).where(b[value].notna(), None)
            upto = own.groupby(b[key], sort=False).ffill()
            leading = (b[key] == last_key) & upto.isna()
            upto = upto.astype(object).where(~leading, last)
            same = b[key] == b[key].shift(1, fill_value=last_key)
            seen = upto.shift(1).astype(object)
            seen.iloc[0] = last
            b = b.assign(part_no=part, is_last=False, seen=seen.where(same, None).where(lambda x: x.notna(), None), upto=upto.where(upto.notna(), None))
            last_key, last = b[key].iloc[-1], b["upto"].iloc[-1]
            if held is not None:
                yield held
            held = b
        if held is not None:
            held.iloc[-1, held.columns.get_loc("is_last")] = True
            yield held

    rows = staged(key_sorted(df, [key, *order]).mapInPandas(carry, local), "seen")
    edge = T.StructType([T.StructField("part_no", T.IntegerType()), T.StructField(key, df.schema[key].dataType), T.StructField("before", kind)])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, last = None, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                own = None if pd.isna(r["upto"]) else r["upto"]
                if r["first_key"] == last_key and last is not None:
                    out.append((r["part_no"], last_key, last))
                last = own if own is not None else last if r["first_key"] == last_key == r["last_key"] else None
                last_key = r["last_key"]
            if out:
                yield pd.DataFrame(out, columns=edge.names)

    ends = rows.groupBy("part_no").agg(F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.max_by(F.struct("upto"), "is_last").alias("end")).select("part_no", "first_key", "last_key", "end.upto")
    fixes = ends.coalesce(1).sortWithinPartitions("part_no").mapInPandas(chain, edge)
    joined = rows.join(F.broadcast(fixes), ["part_no", key], "left")
    return joined.select(*df.columns, F.coalesce("seen", "before").alias(f"last_{value}"))


def running_totals(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Adds before_<c> for each c of sums (long): its sum over all rows that come earlier in order. order must be unique.

    Each range partition adds up its own rows; what lies before it comes from one row per partition. Stages.
    """
    schema = T.StructType(df.schema.fields + [T.StructField("part_no", T.IntegerType())] + [T.StructField(f"own_{c}", T.LongType()) for c in sums])

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, total = TaskContext.get().partitionId(), dict.fromkeys(sums, 0)
        for b in batches:
            if b.empty:
                continue
            new = {}
            for c in sums:
                upto = b[c].fillna(0).astype("int64").cumsum() + total[c]
                new[f"own_{c}"] = upto.shift(1, fill_value=total[c])
                total[c] = int(upto.iloc[-1])
            yield b.assign(part_no=part, **new)

    rows = staged(key_sorted(df, order).mapInPandas(add, schema), "totals")
    each = rows.groupBy("part_no").agg(*[F.sum(c).alias(f"all_{c}") for c in sums])
    w = Window.orderBy("part_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("part_no", *[F.coalesce(F.sum(f"all_{c}").over(w), F.lit(0)).alias(f"off_{c}") for c in sums])
    joined = rows.join(F.broadcast(offsets), "part_no")
    return joined.select(*df.columns, *[(F.col(f"own_{c}") + F.col(f"off_{c}")).alias(f"before_{c}") for c in sums])


def greedy_skip(df: DataFrame, key: str, order: list[str], size: str, budgets: list[int]) -> DataFrame:
    """Adds kept (one boolean per budget): whether the row fits after what is kept of its key's earlier rows; what is too big is skipped.

    key must not be null, order must be unique within key, size is a long of 0 or more. A key may span partitions: each
    is folded as if nothing came before it and also tells, for every amount that may be used already, the amount after
    its first key. Chaining these gives the true start of each partition, and only the rows of a first key that starts
    with a used budget are folded again. Stages once.
    """
    edge = [T.StructField("first_key", df.schema[key].dataType), T.StructField("after", T.ArrayType(T.LongType())), T.StructField("last_used", T.ArrayType(T.LongType()))]
    local = T.StructType(df.schema.fields + [T.StructField("kept", T.ArrayType(T.BooleanType())), T.StructField("part_no", T.IntegerType()), *edge])
    zero, columns = [0] * len(budgets), df.columns

    def fold(keys: np.ndarray, sizes: np.ndarray, used: list[int], last: object, start: dict) -> tuple[list, list[int], object]:
        kept = []
        for k, t in zip(keys, sizes, strict=True):
            if k != last:
                used, last = list(start.get(k, zero)), k
            fits = [u + t <= b for u, b in zip(used, budgets, strict=True)]
            used = [u + t if f else u for u, f in zip(used, fits, strict=True)]
            kept.append(fits)
        return kept, used, last

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used, last, held = TaskContext.get().partitionId(), zero, None, None
        # for each budget the amounts used after the first key, by the amounts before it
        after, head, leading = [np.arange(b + 1) for b in budgets], None, True
        least = zero
        for b in batches:
            if b.empty:
                continue
            keys, sizes = b[key].to_numpy(), [int(t) for t in b[size]]
            head = keys[0] if head is None else head
            for k, t in zip(keys, sizes, strict=True) if leading else ():
                if k != head:
                    leading = False
                    break
                for i, limit in enumerate(budgets):
                    if 0 < t <= limit - least[i]:
                        a = after[i]
                        a[a <= limit - t] += t
                        least = [*least[:i], int(a.min()), *least[i + 1 :]]
            kept, used, last = fold(keys, sizes, used, last, {})
            if held is not None:
                yield held
            held = b.assign(kept=kept, part_no=part, first_key=None, after=None, last_used=None)
        if held is not None:
            summary = {"first_key": head, "after": np.concatenate(after).tolist(), "last_used": [int(u) for u in used]}
            for c, v in summary.items():
                held[c] = pd.Series([None] * (len(held) - 1) + [v], index=held.index, dtype=object)
            yield held

    rows = staged(key_sorted(df, [key, *order]).mapInPandas(first, local), "greedy")

    begun = T.StructType([T.StructField("part_no", T.IntegerType()), T.StructField(key, df.schema[key].dataType), T.StructField("begun", T.ArrayType(T.LongType()))])
    offsets = np.cumsum([0] + [b + 1 for b in budgets])[:-1]

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, last = zero, None
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                used = used if r["first_key"] == last else zero
                if any(used):
                    out.append((r["part_no"], r["first_key"], used))
                used = [int(r["after"][o + u]) for o, u in zip(offsets, used, strict=True)] if r["first_key"] == r[key] else [int(u) for u in r["last_used"]]
                last = r[key]
            if out:
                yield pd.DataFrame(out, columns=begun.names)

    ends = rows.where("after is not null").select("part_no", key, "first_key", "after", "last_used")
    starts = ends.coalesce(1).sortWithinPartitions("part_no").mapInPandas(chain, begun)

    def again(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used, last = zero, None
        for b in batches:
            if b.empty:
                continue
            # a key has one start in each partition that it goes on in
            keys = list(zip(b["part_no"], b[key], strict=True))
            start = {k: [int(u) for u in v] for k, v in zip(keys, b["begun"], strict=True)}
            kept, used, last = fold(keys, [int(t) for t in b[size]], used, last, start)
            yield b[columns].assign(kept=kept)

    out = T.StructType(df.schema.fields + [local["kept"]])
    joined = rows.select(*out.names, "part_no").join(F.broadcast(starts), ["part_no", key], "left")
    redone = joined.where("begun is not null").repartition("part_no").sortWithinPartitions("part_no", *order).mapInPandas(again, out)
    return joined.where("begun is null").select(*out.names).unionByName(redone)
