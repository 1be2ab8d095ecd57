"""Connected components by alternating large-star and small-star joins.

Each operation points a node's neighbours at the smallest one: large-star the larger neighbours, small-star the smaller
ones and the node itself. A step is an aggregation (minimum by node, combined before the shuffle) and a join with it,
so a node of very many links costs no task more than its share; neighbours are never collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.runtime import staged


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(nodes: DataFrame, links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reached over links(u, v); a node without links is its own.

    Links with a null or unknown end and loops are ignored. Every round is staged; the number of rounds grows with the
    logarithm of the number of nodes. The driver sees two numbers of a round.
    """
    known = nodes.select("node").where("node is not null").distinct()
    edges = links.where("u is not null and v is not null and u <> v").select("u", "v").distinct()
    edges = staged(edges.join(known.withColumnRenamed("node", "u"), "u", "left_semi").join(known.withColumnRenamed("node", "v"), "v", "left_semi").select("u", "v"), "links")
    mark = lambda e: tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    seen = mark(edges)
    if seen[0]:
        for n in range(max_rounds):
            edges = staged(_small_star(_large_star(edges)), f"star{n}")
            now = mark(edges)
            if now == seen:
                break
            seen = now
        else:
            raise RuntimeError(f"components aren't stable after {max_rounds} rounds")
    return known.join(edges.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("component"))
