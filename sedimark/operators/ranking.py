"""Scoring and fusing candidates of a text query.

Scores are computed row by row: only the query's few terms are counted in each text, and what is needed of the corpus
(number of texts, mean length, texts per term) is one row from one aggregation. Nothing is shuffled but the candidates
that are fused. Ranks of long lists are numbered over range partitions, never in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import grams, jaccard, normalized, query_terms, rounded, terms
from sedimark.operators.ordered import positions
from sedimark.runtime import staged

# fixed values: weights of relation types and of fused lists, and constants of the scorers
RELATION_WEIGHTS = {"contradicts": 1.0, "supersedes": 0.95, "supports": 0.9, "derived_from": 0.8, "authorized_by": 0.8, "governed_by": 0.8, "produced": 0.65, "changed": 0.65, "affects": 0.55, "references": 0.5}
OTHER_WEIGHT = 0.4
LIST_WEIGHTS = {"fts": 1.05, "bm25": 1.0, "fuzzy": 0.75, "graph": 0.65, "authority": 1.25}
RRF_K = 60
K1, B, TITLE_BOOST = 1.2, 0.75, 1.8
FIELD_WEIGHTS = {"title": 4.0, "body": 2.0, "data": 1.0}
SEEDS = 32
FUZZY_FLOOR = 0.025


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns) if columns else F.lit(0.0)


def _is(term: str):
    # a function of one argument: a second one would get the place in the list
    return lambda x: x == term


def counted(events: DataFrame, text: Column, query: list[str]) -> DataFrame:
    """events with dl (terms of the text), tf_<i> of each query term, and has_title_<i>."""
    own = events.withColumn("_terms", terms(text)).withColumn("_title", terms(F.col("title")))
    out = own.withColumn("dl", F.size("_terms")).withColumns({f"tf_{i}": F.size(F.filter("_terms", _is(t))) for i, t in enumerate(query)} | {f"in_title_{i}": F.array_contains("_title", t) for i, t in enumerate(query)})
    return out.drop("_terms", "_title")


def corpus_stats(rows: DataFrame, query: list[str]) -> DataFrame:
    """One row: n (at least 1), avgdl, df_<i>."""
    return rows.agg(F.greatest(F.count("*"), F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"tf_{i}") > 0).alias(f"df_{i}") for i in range(len(query))])


def bm25(rows: DataFrame, stats: DataFrame, query: list[str], title_boost: bool = True, keep_zero: bool = False) -> DataFrame:
    """rows with score, rounded to 6 places; rows that score nothing are left out unless keep_zero. stats is one row."""
    joined = rows.crossJoin(F.broadcast(stats))
    parts = []
    for i in range(len(query)):
        tf, df = F.col(f"tf_{i}"), F.col(f"df_{i}")
        idf = F.ln(1 + (F.col("n") - df + 0.5) / (df + 0.5))
        one = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))))
        parts.append(F.when(tf > 0, one * F.when(F.col(f"in_title_{i}"), TITLE_BOOST).otherwise(1.0) if title_boost else one).otherwise(0.0))
    scored = joined.withColumn("score", rounded(_sum(parts)))
    return scored if keep_zero else scored.where("score > 0")


def field_counts(events: DataFrame, query: list[str], fields: dict[str, Column], weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """events with field_dl (terms of all fields) and w_<i>: how often the query's term is in each field, by the field's weight."""
    own = events.withColumns({f"_{f}": terms(c) for f, c in fields.items()})
    own = own.withColumn("field_dl", _sum([F.size(f"_{f}") for f in fields]))
    return own.withColumns({f"w_{i}": _sum([F.size(F.filter(f"_{f}", _is(t))) * weights[f] for f in fields]) for i, t in enumerate(query)}).drop(*[f"_{f}" for f in fields])


def fielded(rows: DataFrame, query: list[str]) -> DataFrame:
    """Weighted field search: rows of field_counts that have any term, with score.

    Rarer terms weigh ln((n - df + .5) / (df + .5)), a millionth at least. Ties are left to the order by time and id.
    """
    stats = rows.agg(F.count("*").alias("n"), F.avg("field_dl").alias("avgdl"), *[F.count_if(F.col(f"w_{i}") > 0).alias(f"wdf_{i}") for i in range(len(query))])
    joined = rows.crossJoin(F.broadcast(stats))
    parts = []
    for i in range(len(query)):
        w, df = F.col(f"w_{i}"), F.col(f"wdf_{i}")
        idf = F.greatest(F.ln((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        parts.append(F.when(w > 0, idf * (w * (K1 + 1) / (w + K1 * (1 - B + B * F.col("field_dl") / F.col("avgdl"))))).otherwise(0.0))
    return joined.withColumn("score", rounded(_sum(parts))).where("score > 0")


def with_likeness(events: DataFrame, text: Column, query: str, gram_chars: int | None = None, phrase_chars: int | None = None) -> DataFrame:
    """events with like: similarity of 3-grams with the query, plus a half if the text holds it; null if the query is shorter than a gram.

    The whole text counts unless it is cut for the grams (4,096 characters, say) and for the phrase (8,192).
    """
    q = " ".join(query.lower().split())
    if len(q) < 3:
        return events.withColumn("like", F.lit(None).cast("double"))
    own = F.array(*[F.lit(g) for g in dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2))])
    # columns of their own, so that the text is normalised and cut into grams once
    rows = events.withColumn("_n", normalized(text, phrase_chars or 2**31 - 1)).withColumn("_g", grams(F.substring("_n", 1, gram_chars) if gram_chars else F.col("_n")))
    return rows.withColumn("like", jaccard(F.col("_g"), own) + F.when(F.contains("_n", F.lit(q)), 0.5).otherwise(0.0)).drop("_n", "_g")


def fuzzy(rows: DataFrame, floor: float = FUZZY_FLOOR) -> DataFrame:
    """rows(like) whose likeness is at least floor, before it is rounded to score."""
    return rows.where(F.col("like") >= floor).withColumn("score", rounded(F.col("like")))


def relation_weight(c: Column) -> Column:
    w = F
    for name, v in RELATION_WEIGHTS.items():
        w = w.when(c == name, v)
    return w.otherwise(OTHER_WEIGHT)


def one_hop(seeds: DataFrame, edges: DataFrame, eligible: DataFrame, top: int = SEEDS) -> DataFrame:
    """(eid, score): the best weighted seed one relation away in either direction. seeds(eid, ts, score); only the top seeds count, scaled by the first's score.

    Targets must be eligible; that is tested after the hop, so a forbidden event can't come back through a relation.
    """
    best = seeds.orderBy(F.desc("score"), F.desc_nulls_last("ts"), "eid").limit(top)
    scaled = best.select(F.col("eid").alias("source"), (F.col("score") / F.max("score").over(_whole())).alias("share"))
    both = edges.select("source", "type", "target").union(edges.select(F.col("target").alias("source"), "type", F.col("source").alias("target")))
    # at most `top` seeds
    hop = both.join(F.broadcast(scaled), "source").select(F.col("target").alias("eid"), rounded(F.col("share") * relation_weight(F.col("type"))).alias("score"))
    return hop.groupBy("eid").agg(F.max("score").alias("score")).where("score > 0").join(eligible.select("eid"), "eid", "left_semi")


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy()


def authority(events: DataFrame, scopes: list[str]) -> DataFrame:
    """events of the asked scopes with score 1 + rank / 100."""
    return events.where(F.col("scope").isin(scopes)).withColumn("score", 1 + F.coalesce("arank", F.lit(0)) / 100)


def ranked(rows: DataFrame) -> DataFrame:
    """(eid, ts, score, rank) by score, then later time, then id. Numbered over range partitions; stages."""
    return ranked_lists({"": rows})[""]


def ranked_lists(lists: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each list ranked apart, all in one pass over range partitions; stages once."""
    keyed = reduce(DataFrame.unionByName, [df.select("eid", "ts", "score", F.lit(n).alias("_k"), (-F.col("score")).alias("_s"), (-F.coalesce("ts", F.lit(-(2**62)))).alias("_t")) for n, df in lists.items()])
    # written before it is sampled for ranges, or everything would be scored twice
    placed = positions(staged(keyed, "scored"), "_k", ["_s", "_t", "eid"], []).select("_k", "eid", "ts", "score", F.col("row_no").alias("rank"))
    return {n: placed.where(F.col("_k") == n).drop("_k") for n in lists}


def reciprocal_rank_fusion(lists: dict[str, DataFrame]) -> DataFrame:
    """(eid, ts, score): sum of weight / (60 + rank) over the lists(eid, ts, rank) that have the event, not rounded."""
    parts = [df.select("eid", "ts", (F.lit(LIST_WEIGHTS[n]) / (RRF_K + F.col("rank"))).alias("part"), F.lit(i).alias("list")) for i, (n, df) in enumerate(lists.items())]
    every = reduce(DataFrame.unionByName, parts)
    # summed in the lists' order, so that the result doesn't hang on the shuffle
    gathered = every.groupBy("eid").agg(F.max("ts").alias("ts"), F.array_sort(F.collect_list(F.struct("list", "part"))).alias("p"))
    return gathered.select("eid", "ts", F.aggregate("p", F.lit(0.0), lambda a, x: a + x["part"]).alias("score"))


def lexical_cascade(lists: dict[str, DataFrame]) -> DataFrame:
    """(eid, ts, tier, tier_rank, score) of lists(eid, ts, rank): 0 authority among primary (fts or bm25), 1 primary, 2 fuzzy, 3 graph; score 1 / (1 + 1000 tier + rank)."""
    parts = [df.select("eid", "ts", F.col("rank"), F.lit(n).alias("list")) for n, df in lists.items()]
    rows = reduce(DataFrame.unionByName, parts).groupBy("eid").agg(F.max("ts").alias("ts"), *[F.min(F.when(F.col("list") == n, F.col("rank"))).alias(n) for n in LIST_WEIGHTS])
    primary = F.least("fts", "bm25")
    tier = F.when(F.col("authority").isNotNull() & primary.isNotNull(), 0).when(primary.isNotNull(), 1).when(F.col("fuzzy").isNotNull(), 2).when(F.col("graph").isNotNull(), 3)
    by_tier = F.when(F.col("tier") == 0, F.col("authority")).when(F.col("tier") == 1, primary).when(F.col("tier") == 2, F.col("fuzzy")).otherwise(F.col("graph"))
    out = rows.withColumn("tier", tier).where("tier is not null").withColumn("tier_rank", by_tier)
    return out.select("eid", "ts", "tier", "tier_rank", primary.alias("primary_rank"), (1 / (1 + 1000 * F.col("tier") + F.col("tier_rank"))).alias("score"))


def superseding(edges: DataFrame, eligible: DataFrame, as_of: int) -> DataFrame:
    """(target, source): eligible events with each eligible event, in force at as_of, that supersedes them. Chains and cycles all count."""
    by = eligible.select(F.col("eid").alias("source"), F.coalesce("vf", "ts").alias("since"))
    s = edges.where("type = 'supersedes' and source <> target").select("source", "target").distinct()
    return s.join(by.where(F.col("since") <= as_of), "source").join(eligible.select(F.col("eid").alias("target")), "target", "left_semi").select("target", "source")


def superseded(edges: DataFrame, eligible: DataFrame, as_of: int) -> DataFrame:
    """(target, n_superseders, first_superseder) of superseding."""
    return superseding(edges, eligible, as_of).groupBy("target").agg(F.count("*").alias("n_superseders"), F.min("source").alias("first_superseder"))


def current_only(rows: DataFrame, gone: DataFrame, query: str = "", history: bool = False) -> DataFrame:
    """rows(eid, ...) without those of gone(target); an event that the query names stays, and with history all do."""
    if history:
        return rows
    named = F.lit(query).contains(F.col("target"))
    return rows.join(gone.where(~named).select(F.col("target").alias("eid")), "eid", "left_anti")


def reranked(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """rows(eid, rank) in the order of scores(eid, score in 0..1) from elsewhere: higher first, unscored last, equals by their old rank; adds new_rank. Only reorders: ids that rows lacks are ignored. For lists of at most 1,000."""
    from pyspark.sql import Window

    s = scores.where("score between 0 and 1").groupBy("eid").agg(F.max("score").alias("given"))
    joined = rows.join(s, "eid", "left")
    return joined.withColumn("new_rank", F.row_number().over(Window.partitionBy().orderBy(F.desc(F.coalesce("given", F.lit(-1.0))), "rank"))).drop("given")


def conflicts(edges: DataFrame, eligible: DataFrame) -> DataFrame:
    """(a, b): distinct unordered pairs of eligible events that contradict each other, no event with itself."""
    p = edges.where("type = 'contradicts' and source <> target").select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    ids = eligible.select("eid")
    return p.join(ids.withColumnRenamed("eid", "a"), "a", "left_semi").join(ids.withColumnRenamed("eid", "b"), "b", "left_semi").select("a", "b")


def coverage(rows: DataFrame, query: list[str], any_candidate: DataFrame) -> DataFrame:
    """One row: status (no-query, none, direct, partial) and the most query terms in one row. any_candidate has a row if there is a lexical candidate."""
    found = _sum([(F.col(f"tf_{i}") > 0).cast("int") for i in range(len(query))]) if query else F.lit(0)
    best = rows.agg(F.coalesce(F.max(found), F.lit(0)).alias("matched"))
    there = any_candidate.limit(1).agg((F.count("*") > 0).alias("there"))
    status = F.when(F.lit(len(query) == 0), "no-query").when(~F.col("there"), "none").when(F.col("matched") == len(query), "direct").otherwise("partial")
    return best.crossJoin(there).select(status.alias("status"), F.col("matched").cast("int").alias("matched_terms"), F.lit(len(query)).alias("query_terms"))


# fixed values: what an event's confidence counts for
CONFIDENCE = {"verified": 1.0, "claimed": 0.8, "extracted": 0.7, "inferred": 0.5}


def code_entities(query: str) -> list[str]:
    """Terms of what a query names in code: spans between back-ticks, paths and dotted identifiers; at most 64."""
    import regex

    text = query[:8192]
    named = [x for x in regex.findall(r"`([^`]+)`", text) if len(x) <= 256]
    for word in regex.split(r"[^\p{L}\p{N}_./-]+", text):
        if "/" in word:
            if len(word) <= 1024 and all(regex.fullmatch(r"[\p{L}\p{N}_.-]{1,256}", x) for x in word.split("/")):
                named.append(word)
        elif "." in word and len(word) <= 1024 and all(regex.fullmatch(r"[\p{L}_][\p{L}\p{N}_]{0,255}", x) for x in word.split(".")):
            named.append(word)
    return query_terms(" ".join(named))[:64]


def sufficiency(rows: DataFrame, n_terms: int, n_entities: int = 0, candidates: DataFrame | None = None) -> DataFrame:
    """One row: how well the rows answer the query. rows have tf_<i> of the query's terms, then of its code entities.

    score = .65 ratio + .15 min(1, support / 2) + .2 confidence, or with entities .45 ratio + .3 entity coverage
    + .1 min(1, support / 2) + .15 confidence, of the best row: most terms, then most entities, then first stored.
    support counts the rows with a fifth of the terms or any entity. candidates are the rows that a lexical or fuzzy
    scorer found (by default those with a term); without any the evidence can't be partial.
    """
    if n_terms == 0:
        none = rows.sparkSession.range(1)
        return none.select(F.lit(0.0).alias("ratio"), F.lit(0).cast("long").alias("support"), F.lit(0).alias("entities"), F.lit(0.0).alias("confidence"), F.lit(0.0).alias("score"), F.lit("INSUFFICIENT_EVIDENCE").alias("state"), F.lit("ABSTAIN").alias("decision"), F.lit("NO_QUERY").alias("reasons"))
    hit = [(F.col(f"tf_{i}") > 0).cast("int") for i in range(n_terms + n_entities)]
    conf = F
    for k, v in CONFIDENCE.items():
        conf = conf.when(F.col("confidence") == k, v)
    own = rows.select((_sum(hit[:n_terms]) / float(n_terms)).alias("ratio"), (_sum(hit[n_terms:]) if n_entities else F.lit(0)).alias("ents"), conf.otherwise(0.5).alias("conf"), "seq")
    best = F.max_by(F.struct("ratio", "ents", "conf"), F.struct("ratio", "ents", -F.col("seq")))
    a = own.agg(best.alias("b"), F.count_if((F.col("ratio") >= 0.2) | (F.col("ents") > 0)).alias("support"))
    found = rows.where(" or ".join(f"tf_{i} > 0" for i in range(n_terms))) if candidates is None else candidates
    a = a.crossJoin(found.limit(1).agg((F.count("*") > 0).alias("there")))
    ratio, ents = F.coalesce("b.ratio", F.lit(0.0)), F.coalesce("b.ents", F.lit(0))
    a = a.select(ratio.alias("r"), ents.alias("entities"), F.when((ratio > 0) | (ents > 0), F.col("b.conf")).otherwise(0.0).alias("confidence"), "support", "there")
    alone = F.least(F.lit(1.0), F.col("support") / 2.0)
    raw = 0.45 * F.col("r") + 0.3 * (F.col("entities") / float(n_entities)) + 0.1 * alone + 0.15 * F.col("confidence") if n_entities else 0.65 * F.col("r") + 0.15 * alone + 0.2 * F.col("confidence")
    state = F.when(F.col("score") >= 0.65, "DIRECTLY_SUPPORTED").when((F.col("score") >= 0.4) & F.col("there"), "PARTIALLY_SUPPORTED").otherwise("INSUFFICIENT_EVIDENCE")
    direct, partial = F.col("state") == "DIRECTLY_SUPPORTED", F.col("state") == "PARTIALLY_SUPPORTED"
    reasons = F.concat_ws(
        ",", F.when(~F.col("there"), "NO_DIRECT_CANDIDATE"), F.when(F.col("r") < 0.2, "LOW_TERM_COVERAGE"), F.when((F.col("entities") == 0) & F.lit(n_entities > 0), "NO_CODE_ENTITY_MATCH"), F.when(F.col("support") < 2, "SINGLE_OR_NO_SUPPORT"),
        F.when(direct, "CONSERVATIVE_DIRECT_THRESHOLD_MET").when(partial, "PARTIAL_EVIDENCE_ONLY").otherwise("INSUFFICIENT_THRESHOLD"), F.when(~direct, "ABSTAIN"),
    )
    out = a.withColumn("score", rounded(raw)).withColumn("state", state)
    return out.select(rounded(F.col("r")).alias("ratio"), "support", "entities", "confidence", "score", "state", F.when(direct, "ACCEPT_DIRECT").otherwise("ABSTAIN").alias("decision"), reasons.alias("reasons"))
