"""Derived relations of the ledger: edges, entities, sources, decisions, scopes, freshness, snapshots and integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coalesced_edges(edges: DataFrame) -> DataFrame:
    """(source, type, target, occurrences, first_edge): one row per distinct edge. Null ends stay as they are."""
    return edges.groupBy("source", "type", "target").agg(F.count("*").alias("occurrences"), F.min("edge_id").alias("first_edge"))


def dangling_targets(edges: DataFrame, events: DataFrame) -> DataFrame:
    """(target, entity_type, n_edges) of targets that are no event: entity.session, .turn, .toolcall, .agent by prefix, else entity.reference."""
    prefix = F.split_part("target", F.lit(":"), F.lit(1))
    kind = F.when(prefix.isin("session", "turn", "toolcall", "agent") & F.contains("target", F.lit(":")), F.concat(F.lit("entity."), prefix)).otherwise("entity.reference")
    lost = edges.where("target is not null").join(events.select(F.col("eid").alias("target")), "target", "left_anti")
    return lost.groupBy("target", kind.alias("entity_type")).agg(F.count("*").alias("n_edges"))


def whole_json(c: Column) -> Column:
    """The text if it is one well-formed JSON value, else null."""
    return F.when(F.try_parse_json(c).isNotNull(), c)


def latest(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """One row per key, the one with the largest order (last writer wins); rows without key are left out."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("v")).select(key, "v.*")


def decision_status(events: DataFrame, edges: DataFrame) -> DataFrame:
    """(eid, status, until_ms) of decisions: superseded if an existing event supersedes it, until its own end or the first superseder's time."""
    by = edges.where("type = 'supersedes' and source <> target").select("source", F.col("target").alias("eid"))
    since = by.join(events.select(F.col("eid").alias("source"), F.coalesce("vf", "ts").alias("since")), "source").groupBy("eid").agg(F.min("since").alias("since"), F.count("*").alias("n"))
    d = events.where("kind = 'decision'").join(since, "eid", "left")
    return d.select("eid", F.when(F.col("n") > 0, "superseded").otherwise("current").alias("status"), F.coalesce("vu", "since").alias("until_ms"))


def active_scopes(attachments: DataFrame, as_of: int) -> DataFrame:
    """(attachment, scope) in force at as_of: of rows(attachment, revoked, scopes, ts, seq), the last up to as_of that isn't a revocation, its scopes apart."""
    last = latest(attachments.where(F.col("ts") <= as_of).withColumn("_o", F.struct("ts", "seq")), "attachment", "_o", ["revoked", "scopes"])
    return last.where("not revoked").select("attachment", F.explode(F.array_distinct("scopes")).alias("scope")).where("scope is not null")


def freshness(cited: DataFrame, observed: DataFrame) -> DataFrame:
    """(path, status) of cited(path, hash) against observed(path, hash): missing, unverified (no hash to compare), changed, current."""
    o = observed.select("path", F.col("hash").alias("now"), F.lit(True).alias("there"))
    status = F.when(F.col("there").isNull(), "missing").when(F.col("hash").isNull() | F.col("now").isNull(), "unverified").when(F.col("hash") != F.col("now"), "changed").otherwise("current")
    return cited.join(o, "path", "left").select("path", status.alias("status"))


def freshness_summary(states: DataFrame) -> DataFrame:
    """One row of freshness: current, changed, missing, unverified, and status (unavailable without any, stale if something changed or is missing, else current)."""
    n = states.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("current", "changed", "missing", "unverified")], F.count("*").alias("n"))
    return n.select("current", "changed", "missing", "unverified", F.when(F.col("n") == 0, "unavailable").when(F.col("changed") + F.col("missing") > 0, "stale").otherwise("current").alias("status"))


def dependency_freshness(cited: DataFrame, resolved: DataFrame | None) -> DataFrame:
    """(name, version, repo, status) of the last cited dependencies(name, version, repo, hash, seq) against a resolver's table(name, version, repo, hash): unverified without one, missing if it has none or a null hash, changed, current."""
    last = latest(cited, "name", "seq", ["version", "repo", "hash"])
    if resolved is None:
        return last.select("name", "version", "repo", F.lit("unverified").alias("status"))
    o = resolved.groupBy("name", "version", "repo").agg(F.max("hash").alias("now"))
    same = last.name.eqNullSafe(o.name) & last.version.eqNullSafe(o.version) & last.repo.eqNullSafe(o.repo)
    status = F.when(F.col("now").isNull(), "missing").when(F.col("now").eqNullSafe(F.col("hash")), "current").otherwise("changed")
    return last.join(o.select(o.name, o.version, o.repo, "now"), same, "left").select(last.name, last.version, last.repo, status.alias("status"))


def snapshot_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(repo, path, change, old_path) between snapshots(repo, path, hash), paths unique in each: added, removed, modified, renamed.

    A rename is an added path whose hash has exactly one removed path in the repository; of several added paths with
    that hash the first by name takes it. Null hashes are never renamed and count as changed only against a hash.
    """
    b, a = before.select("repo", "path", F.col("hash").alias("old"), F.lit(True).alias("was")), after.select("repo", "path", F.col("hash").alias("new"), F.lit(True).alias("now"))
    both = b.join(a, ["repo", "path"], "full_outer")
    removed = both.where("was and now is null").select("repo", F.col("path").alias("old_path"), F.col("old").alias("hash"))
    added = both.where("now and was is null").select("repo", "path", F.col("new").alias("hash"))
    modified = both.where("was and now and not (old <=> new)").select("repo", "path", F.lit("modified").alias("change"), F.lit(None).cast("string").alias("old_path"))
    unique = removed.where("hash is not null").groupBy("repo", "hash").agg(F.count("*").alias("n"), F.min("old_path").alias("old_path")).where("n = 1").select("repo", "hash", "old_path")
    taken = added.where("hash is not null").groupBy("repo", "hash").agg(F.min("path").alias("path")).join(unique, ["repo", "hash"]).select("repo", "path", F.lit("renamed").alias("change"), "old_path")
    new = added.join(taken.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path", F.lit("added").alias("change"), F.lit(None).cast("string").alias("old_path"))
    gone = removed.join(taken.select("repo", "old_path"), ["repo", "old_path"], "left_anti").select("repo", F.col("old_path").alias("path"), F.lit("removed").alias("change"), F.lit(None).cast("string").alias("old_path"))
    return modified.union(taken).union(new).union(gone)


def verify_chain(rows: DataFrame, key: str) -> DataFrame:
    """(key, n_rows, roots, orphans, forks) of rows(key, hash, previous): a whole chain has one root, no orphans and no forks.

    A self join on the previous hash, so a long chain is checked in parallel.
    """
    heads = rows.select(key, F.col("hash").alias("previous")).distinct().withColumn("known", F.lit(True))
    j = rows.join(heads, [key, "previous"], "left")
    forks = rows.where("previous is not null").groupBy(key, "previous").count().where("count > 1").groupBy(key).agg(F.count("*").alias("forks"))
    one = j.groupBy(key).agg(F.count("*").alias("n_rows"), F.count_if(F.col("previous").isNull()).alias("roots"), F.count_if(F.col("previous").isNotNull() & F.col("known").isNull()).alias("orphans"))
    return one.join(forks, key, "left").withColumn("forks", F.coalesce("forks", F.lit(0).cast("long")))


def size_class(n: Column) -> Column:
    """Coarse size of a number of bytes; none for null."""
    return F.when(n.isNull(), "none").when(n == 0, "empty").when(n <= 64, "tiny").when(n <= 1024, "small").when(n <= 16384, "medium").when(n <= 65536, "large").otherwise("very_large")


# fixed values: shapes of secrets; the last takes a private key up to its end or, if that is missing, to the text's
SECRETS = [r"(?i)\bBearer\s+[A-Za-z0-9._~+/-]+=*", r"\bsk-[A-Za-z0-9_-]{16,}\b", r"\b(?:gh[pousr]|github_pat)_[A-Za-z0-9_]{16,}\b", r"\bnpm_[A-Za-z0-9]{16,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)"]


def without_secrets(c: Column, mark: str = "[REDACTED]") -> Column:
    for p in SECRETS:
        c = F.regexp_replace(c, p, mark)
    return c


# fixed values: file endings by language
LANGUAGES = {
    "javascript": ("cjs", "js", "jsx", "mjs",),
    "typescript": ("ts", "tsx",),
    "markdown": ("md",),
    "json": ("json",),
    "jsonc": ("jsonc",),
    "python": ("py",),
    "rust": ("rs",),
    "java": ("java",),
    "kotlin": ("kt",),
    "ruby": ("rb",),
    "css": ("css",),
    "html": ("html",),
    "svelte": ("svelte",),
    "vue": ("vue",),
    "yaml": ("yaml", "yml",),
    "toml": ("toml",),
    "sql": ("sql",),
    "xml": ("xml",),
    "shell": ("sh",),
}


def language(path: Column) -> Column:
    """Language of a path by its ending, text if unknown."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    w = F
    for name, ends in LANGUAGES.items():
        w = w.when(ending.isin(*ends), name)
    return w.otherwise("text")
