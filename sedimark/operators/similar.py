"""Exact join of similar texts over word shingles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import normalized, shingles
from sedimark.runtime import staged


def audit_text(c: Column) -> Column:
    """Lower-case text with addresses of the web, hashes and (dotted) numbers as marks; of the rest the letters, numbers and underscores of all scripts."""
    space, alone = r"\s\p{Z}\x{feff}", r"(?<![0-9A-Za-z_]){}(?![0-9A-Za-z_])"
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), rf"https?://[^{space}]+", " <url> ")
    c = F.regexp_replace(c, alone.format("[0-9a-f]{7,40}"), " <sha> ")
    c = F.regexp_replace(c, alone.format(r"[0-9]+(?:\.[0-9]+)*"), " <num> ")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}_<>]+", " "))


def similar_classes(docs: DataFrame, threshold: float = 0.85, n: int = 5, audit: Callable[[Column], Column] | None = audit_text) -> DataFrame:
    """(doc_id, class_id, n_links) of docs(doc_id, text): class_id the smallest id with the same normalised text, n_links the other classes whose shingles are similar.

    Null texts and those that have no words are in a class by themselves. Texts are similar if the Jaccard similarity of
    their shingles is at least threshold (0.8 or more); a text of fewer than n words is similar to none. Only rare
    shingles of a text can be its first common one (prefix filter over shingles from rare to frequent), and from there
    on both must have enough shingles left (positional filter), so frequent shingles give few candidates; no partner is
    lost. Stages.
    """
    own = docs.select("doc_id", (audit(F.col("text")) if audit else normalized(F.col("text"), 1 << 30)).alias("t"))
    # written once: the text expressions are the dearest part and three branches need them
    keyed = staged(own.select("doc_id", "t", F.when(F.col("t") != "", F.sha2("t", 256)).alias("key")), "audited")
    reps = keyed.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("class_id"))
    texts = keyed.join(reps.select(F.col("class_id").alias("doc_id")), "doc_id", "left_semi").select("doc_id", F.transform(shingles(F.col("t"), n), lambda s: F.xxhash64(s)).alias("s")).where("size(s) > 0")
    rows = staged(texts.select("doc_id", F.size("s").alias("n"), F.explode("s").alias("h")), "shingles")
    common = rows.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    sets = staged(rows.join(common, "h").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("c")), "sets")
    # shingles that only this text has are the rarest and fill the prefix first
    prefix = F.col("n") - F.ceil(F.lit(threshold) * F.col("n")) + 1 - (F.col("n") - F.size("c"))
    first = sets.withColumn("p", prefix.cast("int")).where("p > 0").select("doc_id", "n", F.size("c").alias("m"), F.posexplode(F.slice("c", 1, F.col("p"))).alias("i", "x")).select("doc_id", "n", F.col("x.h").alias("h"), (F.col("m") - F.col("i")).alias("left"))
    a, b = first.select("h", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("left").alias("la")), first.select("h", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("left").alias("lb"))
    near = (F.col("na") >= F.lit(threshold) * F.col("nb")) & (F.col("nb") >= F.lit(threshold) * F.col("na"))
    # at their first common shingle similar texts have all that they share before them
    enough = F.least("la", "lb") * (1 + threshold) >= F.lit(threshold) * (F.col("na") + F.col("nb")) - 1e-9
    pairs = staged(a.join(b, "h").where((F.col("a") < F.col("b")) & near & enough).select("a", "b").distinct(), "pairs")
    s = sets.select("doc_id", "n", F.transform("c", lambda x: x["h"]).alias("h"))
    full = pairs.join(s.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("h").alias("ha")), "a").join(s.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("h").alias("hb")), "b")
    both = F.size(F.array_intersect("ha", "hb"))
    links = full.where(both / (F.col("na") + F.col("nb") - both) >= threshold).select("a", "b")
    counts = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    of_doc = keyed.drop("t").join(reps, "key", "left").withColumn("class_id", F.coalesce("class_id", "doc_id"))
    return of_doc.join(counts, "class_id", "left").select("doc_id", "class_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
