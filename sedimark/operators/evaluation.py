"""Measures of rankings and classifiers, as aggregations."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import rounded
from sedimark.operators.ordered import positions, running_totals


def retrieval_metrics(ranked: DataFrame, key: str) -> DataFrame:
    """(key, recall_1/5/10, precision_5/10, rr_10, ndcg_10) of rows(key, rank, grade); gain 2^grade - 1. Keys without a relevant row are left out.

    The ideal order is by grade; its first ten come from a bounded window, so a long list isn't collected.
    """
    w = Window.partitionBy(key).orderBy(F.desc("grade"), "rank")
    ideal = ranked.withColumn("_i", F.row_number().over(w)).where("_i <= 10").groupBy(key).agg(F.sum((F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("_i") + 1)).alias("ideal"))
    rel = F.col("grade") > 0
    within = lambda k: F.count_if(rel & (F.col("rank") <= k))
    gain = F.when(F.col("rank") <= 10, (F.pow(F.lit(2.0), "grade") - 1) / F.log2(F.col("rank") + 1)).otherwise(0.0)
    got = ranked.groupBy(key).agg(
        F.count_if(rel).alias("n"), *[within(k).alias(f"w{k}") for k in (1, 5, 10)], F.coalesce(1 / F.min(F.when(rel & (F.col("rank") <= 10), F.col("rank"))), F.lit(0.0)).alias("rr"), F.sum(gain).alias("dcg")
    )
    return got.where("n > 0").join(ideal, key).select(
        key, *[rounded(F.col(f"w{k}") / F.col("n")).alias(f"recall_{k}") for k in (1, 5, 10)], *[rounded(F.col(f"w{k}") / float(k)).alias(f"precision_{k}") for k in (5, 10)], rounded(F.col("rr")).alias("rr_10"), rounded(F.col("dcg") / F.col("ideal")).alias("ndcg_10")
    )


def by_score(obs: DataFrame) -> DataFrame:
    """(score, n, pos, above_n, above_pos): observations(score, positive) by distinct score, with what scores higher. Stages."""
    g = obs.where("score is not null").groupBy((-F.col("score")).alias("_s")).agg(F.count("*").alias("n"), F.count_if("positive").alias("pos"))
    return running_totals(g, ["_s"], ["n", "pos"]).select((-F.col("_s")).alias("score"), "n", "pos", F.col("before_n").alias("above_n"), F.col("before_pos").alias("above_pos"))


def roc_auc(obs: DataFrame) -> DataFrame:
    """One row: positives, negatives and auc, ties a half. Scores are grouped first; null if a class is missing. Null scores are left out."""
    g = by_score(obs)
    t = g.agg(F.sum("pos").alias("positives"), F.sum(F.col("n") - F.col("pos")).alias("negatives"), F.sum((F.col("n") - F.col("pos")) * (F.col("above_pos") + F.col("pos") / 2.0)).alias("u"))
    return t.select("positives", "negatives", rounded(F.try_divide(F.col("u"), F.col("positives") * F.col("negatives"))).alias("auc"))


def average_precision(obs: DataFrame) -> DataFrame:
    """One row: average precision with equal scores taken as one step."""
    g = by_score(obs)
    return g.agg(rounded(F.try_divide(F.sum(F.col("pos") * (F.col("above_pos") + F.col("pos")) / (F.col("above_n") + F.col("n"))), F.sum("pos"))).alias("average_precision"))


def calibration(obs: DataFrame, bins: int = 10) -> DataFrame:
    """One row: Brier score and expected calibration error over equal bins, the last closed."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1))
    y = F.col("positive").cast("double")
    g = obs.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.sum("score").alias("s"), F.sum(y).alias("y"), F.sum((F.col("score") - y) * (F.col("score") - y)).alias("e"))
    return g.agg(rounded(F.sum("e") / F.sum("n")).alias("brier"), rounded(F.sum(F.abs(F.col("s") - F.col("y"))) / F.sum("n")).alias("ece"))


def risk_coverage(obs: DataFrame, shares: tuple[float, ...] = (0.1, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """(coverage, n, risk): share of negatives among the best-scored share of observations(eid, score, positive); equal scores by id. Stages."""
    placed = positions(obs.select("eid", "positive", F.lit("").alias("_k"), (-F.col("score")).alias("_s")), "_k", ["_s", "eid"], [])
    total = obs.agg(F.count("*").alias("total"))
    levels = F.explode(F.array(*[F.struct(F.lit(s).alias("coverage"), F.ceil(F.col("total") * s).alias("k")) for s in shares])).alias("l")
    cuts = total.select(levels).select("l.*")
    # five rows
    return placed.join(F.broadcast(cuts), F.col("row_no") <= F.col("k")).groupBy("coverage").agg(F.count("*").alias("n"), rounded(F.count_if(~F.col("positive")) / F.count("*")).alias("risk"))


def leave_one_out(obs: DataFrame, key: str, grid: tuple[float, ...] = (0.65, 0.7, 0.75, 0.8)) -> DataFrame:
    """(key, threshold, tp, fp): for each key the threshold of the grid that, on all other keys, has no false positive and the most true ones (then the lowest), and what it gives on the key itself. Null threshold if none qualifies."""
    g = obs.groupBy(key).agg(*[F.count_if((F.col("score") >= t) & F.col("positive")).alias(f"tp{i}") for i, t in enumerate(grid)], *[F.count_if((F.col("score") >= t) & ~F.col("positive")).alias(f"fp{i}") for i, t in enumerate(grid)])
    all_ = g.agg(*[F.sum(f"{k}{i}").alias(f"all_{k}{i}") for k in ("tp", "fp") for i in range(len(grid))])
    options = F.array(*[F.when(F.col(f"all_fp{i}") == F.col(f"fp{i}"), F.struct((F.col(f"all_tp{i}") - F.col(f"tp{i}")).alias("others"), F.lit(-t).alias("minus"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))) for i, t in enumerate(grid)])
    best = F.array_max(F.filter(options, lambda o: o.isNotNull()))
    return g.crossJoin(F.broadcast(all_)).withColumn("b", best).select(key, (-F.col("b.minus")).alias("threshold"), F.col("b.tp").alias("tp"), F.col("b.fp").alias("fp"))


def relevance_grades(files: DataFrame) -> DataFrame:
    """(repo, row_id, grade) of the records of files(repo, row_id, path, scope) before each repository's last: 2 if a file is also in the last one, 1 if only a module is; others have no row."""
    last = files.groupBy("repo").agg(F.max("row_id").alias("last"))
    known = files.join(last, "repo")
    now, old = known.where("row_id = last"), known.where("row_id < last")
    direct = old.join(now.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "row_id", F.lit(2).alias("grade"))
    near = old.join(now.select("repo", "scope").distinct(), ["repo", "scope"], "left_semi").select("repo", "row_id", F.lit(1).alias("grade"))
    return direct.union(near).groupBy("repo", "row_id").agg(F.max("grade").alias("grade"))


def ranking_hits(ranked: DataFrame, key: str) -> DataFrame:
    """One row of rows(key, rank, grade): keys with a relevant row, those with one among the first 1, 5 and 10, and the mean reciprocal rank up to 10 (null without keys)."""
    first = ranked.where("grade > 0").groupBy(key).agg(F.min("rank").alias("f"))
    return first.agg(F.count("*").alias("subjects"), *[F.count_if(F.col("f") <= k).alias(f"hit_{k}") for k in (1, 5, 10)], rounded(F.try_divide(F.sum(F.when(F.col("f") <= 10, 1 / F.col("f")).otherwise(0.0)), F.count("*"))).alias("mrr_10"))


def summarized(rows: DataFrame, key: str, value: str) -> DataFrame:
    """(key, n, mean, p50, p95, most) of a number by key; percentiles by nearest rank. Values are counted before they are ordered, so a key costs its distinct values."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    kind = rows.schema[value].dataType
    return rows.groupBy(key).agg(F.count("*").alias("n"), rounded(F.avg(value)).alias("mean"), p(0.5).cast(kind).alias("p50"), p(0.95).cast(kind).alias("p95"), F.max(value).alias("most"))


def complete_prefix(ranked: DataFrame, required: DataFrame, key: str, most: int = 32) -> DataFrame:
    """(key, prefix): the smallest number of first ranks of ranked(key, eid, rank) that holds all required(key, eid); null if one is missing or ranked below most."""
    j = required.select(key, "eid").distinct().join(ranked.where(F.col("rank") <= most).select(key, "eid", "rank"), [key, "eid"], "left")
    return j.groupBy(key).agg(F.when(F.count("rank") == F.count("*"), F.max("rank")).alias("prefix"))


def exact_top(ranked: DataFrame, key: str) -> DataFrame:
    """(key, k, exact) of rows(key, rank, required): k required rows, and whether they are exactly the first k. Keys without a required row are left out."""
    g = ranked.where("required").groupBy(key).agg(F.count("*").alias("k"), F.max("rank").alias("last"))
    return g.select(key, "k", (F.col("k") == F.col("last")).alias("exact"))


def compared(ranked: DataFrame, key: str, most: int = 32) -> DataFrame:
    """One row per method of rows(method, key, rank, required, tokens): cases, those with all required rows among the first `most`, those with exactly them first, the tokens of the prefixes that hold them, of all rows, and what the prefixes save.

    Tokens of prefixes are compared only if each case of the method has one, else they are null.
    """
    need = ranked.where("required").groupBy("method", key).agg(F.count("*").alias("k"), F.max("rank").alias("last"))
    both = ranked.join(need, ["method", key]).groupBy("method", key, "k", "last").agg(F.sum("tokens").alias("history"), F.sum(F.when(F.col("rank") <= F.col("last"), F.col("tokens")).otherwise(0)).alias("prefix"))
    g = both.groupBy("method").agg(F.count("*").alias("cases"), F.count_if(F.col("last") <= most).alias("eligible"), F.count_if(F.col("k") == F.col("last")).alias("exact"), F.sum("prefix").alias("p"), F.sum("history").alias("history_tokens"))
    whole = F.col("cases") == F.col("eligible")
    return g.select("method", "cases", "eligible", "exact", F.when(whole, F.col("p")).alias("prefix_tokens"), "history_tokens", F.when(whole, rounded(1 - F.try_divide(F.col("p"), F.col("history_tokens")))).alias("reduction"))


def winner(methods: DataFrame) -> DataFrame:
    """One row of compared methods: decision (none if a method isn't eligible in all cases, tie, winner) and winner, the one with the fewest tokens."""
    g = methods.agg(F.count("*").alias("n"), F.count("prefix_tokens").alias("known"), F.min("prefix_tokens").alias("least"), F.max("prefix_tokens").alias("most"), F.min_by("method", "prefix_tokens").alias("first"))
    decision = F.when((F.col("n") == 0) | (F.col("known") < F.col("n")), "none").when(F.col("least") == F.col("most"), "tie").otherwise("winner")
    return g.select(decision.alias("decision"), F.when(decision == "winner", F.col("first")).alias("winner"))


def strata(ranked: DataFrame, sizes: tuple[int, ...] = (20, 19, 10)) -> DataFrame:
    """ranked(rank) with stratum: 1 for the first sizes[0] ranks, 2 for the next, and so on; ranks beyond are left out."""
    out, upto = F, 0
    for i, n in enumerate(sizes, 1):
        upto += n
        out = out.when(F.col("rank") <= upto, i)
    return ranked.where(F.col("rank") <= upto).withColumn("stratum", out)


def balanced_sample(tasks: list[tuple[str, str, str]], most: int) -> list[str]:
    """Ids of tasks(id, group, band): one after the other the task whose group, then whose band has been taken least, equals by id. For evaluation sets of some hundreds."""
    left, taken, groups, bands = sorted(tasks), [], {}, {}
    while left and len(taken) < most:
        t = min(left, key=lambda x: (groups.get(x[1], 0), bands.get(x[2], 0), x[0]))
        left.remove(t)
        taken.append(t[0])
        groups[t[1]], bands[t[2]] = groups.get(t[1], 0) + 1, bands.get(t[2], 0) + 1
    return taken


def paired_difference(pairs: DataFrame, samples: int = 1000, seed: str = "sedimark") -> DataFrame:
    """One row: mean of b - a over pairs(cluster, a, b) with an interval from whole clusters resampled."""
    return cluster_bootstrap(pairs.groupBy("cluster").agg(F.sum(F.col("b") - F.col("a")).alias("total"), F.count("*").alias("n")), samples, seed)


def zero_edge_interval(successes: Column, n: Column) -> Column:
    """Exact 95 % bound when none or all of n succeed: (lower, upper) as a struct; null in between."""
    edge = F.pow(F.lit(0.025), 1 / n)
    return F.when(successes == 0, F.struct(F.lit(0.0).alias("lower"), (1 - edge).alias("upper"))).when(successes == n, F.struct(edge.alias("lower"), F.lit(1.0).alias("upper")))


def _binomial(n: int, p: float) -> list[float]:
    return [math.comb(n, k) * p**k * (1 - p) ** (n - k) for k in range(n + 1)]


def mcnemar_power(pairs: int, discordance: float, effect: float, alpha: float = 0.05) -> float:
    """Power of the exact two-sided test of paired outcomes."""
    win = (discordance + effect) / (2 * discordance)
    power = 0.0
    for m, pm in enumerate(_binomial(pairs, discordance)):
        half = _binomial(m, 0.5)
        for b, pb in enumerate(_binomial(m, win)):
            p = min(1.0, 2 * sum(half[: min(b, m - b) + 1]))
            if p <= alpha:
                power += pm * pb
    return power


def xorshift(seed: str, n: int) -> np.ndarray:
    """n numbers of a 32-bit xorshift started from the digest of seed."""
    x = int(hashlib.sha256(seed.encode()).hexdigest()[:8], 16) or 1
    out = np.empty(n, np.uint32)
    for i in range(n):
        x ^= (x << 13) & 0xFFFFFFFF
        x ^= x >> 17
        x ^= (x << 5) & 0xFFFFFFFF
        out[i] = x
    return out


def cluster_bootstrap(clusters: DataFrame, samples: int = 1000, seed: str = "sedimark") -> DataFrame:
    """One row: mean and 95 % interval of clusters(cluster, total, n) resampled whole.

    Clusters are groups such as repositories, two numbers each; they are sent to the tasks that draw samples.
    """
    spark = clusters.sparkSession
    rows = clusters.orderBy("cluster").collect()
    totals, sizes = np.array([float(r["total"]) for r in rows]), np.array([float(r["n"]) for r in rows])
    k = len(rows)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for i in b["id"]:
                pick = xorshift(f"{seed}:{i}", k) % max(1, k)
                out.append(totals[pick].sum() / max(1.0, sizes[pick].sum()) if k else float("nan"))
            yield pd.DataFrame({"mean": out})

    drawn = spark.range(samples).mapInPandas(draw, "mean double")
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by mean)")
    whole = float(totals.sum() / max(1.0, sizes.sum())) if k else float("nan")
    return drawn.agg(F.lit(k).alias("clusters"), F.lit(whole).alias("mean"), p(0.025).alias("lower"), p(0.975).alias("upper"))
