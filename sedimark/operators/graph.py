"""The project's graph: directories, files, what they refer to, and files that change together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def node_id(kind: str, value: Column) -> Column:
    """An id that follows from what the node is."""
    return F.concat(F.lit(f"project:{kind}:"), F.substring(F.sha2(value, 256), 1, 32))


def directories(path: Column) -> Column:
    """All directories above a path, '.' first."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    return F.concat(F.array(F.lit(".")), F.when(F.size(parts) > 1, above).otherwise(F.array().cast("array<string>")))


def parent(path: Column) -> Column:
    """The directory of a path, '.' at the top."""
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(up == "", ".").otherwise(up)


def project_nodes(files: DataFrame, references: DataFrame) -> DataFrame:
    """(repo, id, type, name) of files(repo, path) and references(repo, path, specifier, target): directories, files, and one node for each specifier whose target is no file, unresolved if it names one, external if not."""
    d = files.select("repo", F.explode(directories(F.col("path"))).alias("name")).distinct()
    lost = references.join(files.select("repo", F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), ["repo", "target"], "left").where("there is null and specifier is not null")
    outer = lost.groupBy("repo", "specifier").agg(F.bool_or(F.col("target").isNotNull()).alias("named"))
    return (
        d.select("repo", node_id("directory", F.col("name")).alias("id"), F.lit("project.directory").alias("type"), "name")
        .union(files.select("repo", "path").distinct().select("repo", node_id("file", F.col("path")), F.lit("project.file"), "path"))
        .union(outer.select("repo", node_id("reference", F.col("specifier")), F.when(F.col("named"), "project.unresolved").otherwise("project.external"), "specifier"))
    )


def project_edges(files: DataFrame, references: DataFrame) -> DataFrame:
    """(repo, source, type, target): directories contain directories and files, files refer to files or to outer nodes by the type of the reference (imports, links; references without one)."""
    d = files.select("repo", F.explode(directories(F.col("path"))).alias("name")).distinct().where("name <> '.'")
    held = d.select("repo", node_id("directory", parent(F.col("name"))).alias("source"), F.lit("contains").alias("type"), node_id("directory", F.col("name")).alias("target"))
    inside = files.select("repo", "path").distinct().select("repo", node_id("directory", parent(F.col("path"))), F.lit("contains"), node_id("file", F.col("path")))
    r = references.where("specifier is not null").join(files.select("repo", F.col("path").alias("target"), F.lit(True).alias("there")).distinct(), ["repo", "target"], "left")
    kind = F.coalesce("type", F.lit("references")) if "type" in references.columns else F.lit("references")
    refers = r.select("repo", node_id("file", F.col("path")), kind, F.when(F.col("there"), node_id("file", F.col("target"))).otherwise(node_id("reference", F.col("specifier")))).distinct()
    return held.union(inside).union(refers)


def changed_together(records: DataFrame, mentioned: DataFrame) -> DataFrame:
    """(id, score) of records(id, path): mentioned(path) files it has, and a half for each file that changed with a mentioned one elsewhere or here."""
    m = mentioned.select("path").distinct()
    rows = records.select("id", "path").distinct()
    seeds = rows.join(m, "path")
    # a file's neighbours are the other files of the records that have it
    pairs = seeds.select("id", F.col("path").alias("seed")).join(rows, "id").where("seed <> path").select("path").distinct()
    direct = seeds.groupBy("id").agg(F.count("*").alias("direct"))
    near = rows.join(pairs, "path").groupBy("id").agg(F.count("*").alias("near"))
    both = direct.join(near, "id", "full_outer")
    return both.select("id", (F.coalesce("direct", F.lit(0)) + 0.5 * F.coalesce("near", F.lit(0))).alias("score"))


# fixed values, in order: what a specifier without ending may stand for
ENDINGS = ("", ".js", ".mjs", ".cjs", ".ts", ".tsx", ".jsx", ".json", "/index.js", "/index.mjs", "/index.ts")


def normal_path(path: Column) -> Column:
    """A relative path without '.', empty and '..' steps, however many; null if it climbs out of its root."""
    outside = F.lit(None).cast("array<string>")
    step = lambda kept, x: F.when(x.isin("", "."), kept).when(x != "..", F.concat(kept, F.array(x))).when(F.size(kept) > 0, F.slice(kept, F.lit(1), F.size(kept) - 1)).otherwise(outside)
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def resolved(references: DataFrame, files: DataFrame) -> DataFrame:
    """(repo, path, specifier, target) of relative specifiers: the first existing of the path itself, with an ending, or as a folder's index."""
    base = F.when(parent(F.col("path")) == ".", F.lit("")).otherwise(F.concat(parent(F.col("path")), F.lit("/")))
    clean = normal_path(F.concat(base, F.col("specifier")))
    options = references.where("specifier like './%' or specifier like '../%'").withColumn("_c", clean)
    tried = options.select("repo", "path", "specifier", F.posexplode(F.array(*[F.concat("_c", F.lit(e)) for e in ENDINGS])).alias("n", "target"))
    hit = tried.join(files.select("repo", F.col("path").alias("target")).distinct(), ["repo", "target"])
    return hit.groupBy("repo", "path", "specifier").agg(F.min_by("target", "n").alias("target"))


QUALITY = {  # measure: (expected, got) columns of ids
    "decision_recall": ("required", "recalled"), "citation_accuracy": ("returned", "valid"), "stale_rejection": ("stale", "rejected_stale"), "conflict_detection": ("conflicts", "detected"), "supersession_correctness": ("superseded", "resolved"),
    "repository_isolation": ("cross", "rejected_cross"), "disclosure_rejection": ("unauthorized", "rejected_unauthorized"),
}


def context_quality(cases: DataFrame) -> DataFrame:
    """One row of measures over cases with array columns of ids (QUALITY), completed, mistake_expected, mistake_avoided, baseline_tokens, tokens, baseline_cost, cost, latency_ms. Ratios to 4 places, null without a denominator; missing columns count as empty."""
    have = set(cases.columns)
    ids = lambda n: F.array_distinct(F.coalesce(F.col(n), F.array().cast("array<string>"))) if n in have else F.array().cast("array<string>")
    number = lambda n: F.sum(F.coalesce(F.col(n), F.lit(0))) if n in have else F.lit(0)
    yes = lambda n: F.coalesce(F.col(n), F.lit(False)) if n in have else F.lit(False)
    ratio = lambda a, b: F.floor(F.try_divide(a, b) * 10000 + 0.5) / 10000
    parts = [ratio(F.sum(F.size(F.array_intersect(ids(e), ids(g)))), F.sum(F.size(ids(e)))).alias(k) for k, (e, g) in QUALITY.items()]
    return cases.agg(
        F.count("*").alias("cases"), *parts, number("tokens").alias("tokens"), ratio(number("baseline_tokens") - number("tokens"), number("baseline_tokens")).alias("token_reduction"), ratio(F.count_if(yes("completed")), F.count("*")).alias("completion"),
        ratio(F.count_if(yes("mistake_expected") & yes("mistake_avoided")), F.count_if(yes("mistake_expected"))).alias("mistake_prevention"), ratio(number("baseline_cost") - number("cost"), number("baseline_cost")).alias("cost_reduction"), ratio(number("latency_ms"), F.count("*")).alias("mean_latency_ms"),
    )
