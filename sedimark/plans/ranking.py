"""Queries that admit, score, fuse and judge events for one text query."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.data import json_words, primitive_lines, project_lines
from sedimark.functions.text import query_terms, terms
from sedimark.operators import admission as A
from sedimark.operators import packs
from sedimark.operators import ranking as R
from sedimark.plans.base import AS_OF, CODE_QUERY, EDGES_SQL, EVENTS_SQL, OWN_LINES_SQL, PROJECT_LINES_SQL, QUERY, WORDS_SQL, REPOSITORIES, SCOPES, edges, events, in_sql, terms_sql
from sedimark.runtime import staged, table

TOP = 50
_Q = query_terms(QUERY)


def _by():
    """Order of equal candidates: score, then later time, then id."""
    return [F.desc("score"), F.desc_nulls_last("ts"), F.asc("eid")]


def search_text():
    """What terms are counted in: title, body, the data's own strings, numbers and booleans, and the files of a project's snapshot."""
    return F.concat_ws("\n", "title", "body", primitive_lines(F.col("j")), project_lines(F.col("j")))


def similar_text():
    """What grams are compared in: the same without the files."""
    return F.concat_ws("\n", "title", "body", primitive_lines(F.col("j")))


def _fields():
    return {"title": F.col("title"), "body": F.col("body"), "data": json_words(F.col("j"))}


def _eligible(spark: SparkSession, d: str, strict: bool = False) -> DataFrame:
    return A.admitted(events(spark, d), AS_OF, SCOPES, REPOSITORIES, strict)


_TEXTS = ("title", "body", "j", "session", "hash", "subject", "kind")


def _counted(ev: DataFrame, query: list[str] = _Q) -> DataFrame:
    """ev with the counts of the query's terms instead of its texts; written, so that statistics and scores don't read the texts twice."""
    return staged(R.counted(ev, search_text(), query).drop(*_TEXTS), "counted")


def measured(ev: DataFrame, query: str) -> DataFrame:
    """ev with all that the scorers need of its texts, which are read once: counts of terms, of terms by field, and likeness. Stages."""
    q = query_terms(query)
    rows = ev.withColumn("_own", primitive_lines(F.col("j"))).withColumn("_near", F.concat_ws("\n", "title", "body", "_own"))
    rows = R.field_counts(R.counted(rows, F.concat_ws("\n", "_near", project_lines(F.col("j"))), q), q, _fields())
    return staged(R.with_likeness(rows, F.col("_near"), query).drop("_own", "_near", *_TEXTS), "measured")


def inverted_index_df(spark: SparkSession, d: str) -> DataFrame:
    """Events and occurrences of every term."""
    one = events(spark, d).select("eid", F.explode(terms(search_text())).alias("term")).groupBy("term", "eid").agg(F.count("*").alias("tf"))
    return one.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def term_frequencies(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every term of every event."""
    return events(spark, d).select("eid", F.explode(terms(search_text())).alias("term")).groupBy("eid", "term").agg(F.count("*").alias("tf"))


def avg_doc_len(spark: SparkSession, d: str) -> DataFrame:
    """Number of events and their mean length in terms."""
    return events(spark, d).agg(F.count("*").alias("n"), R.rounded(F.avg(F.size(terms(search_text())))).alias("avgdl"))


def _bm25(spark: SparkSession, d: str, boost: bool) -> DataFrame:
    rows = _counted(events(spark, d))
    return R.bm25(rows, R.corpus_stats(rows, _Q), _Q, boost)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    """The best events by BM25 without title boost."""
    return _bm25(spark, d, False).orderBy(*_by()).limit(TOP).select("eid", "score")


def bm25_title_boost(spark: SparkSession, d: str) -> DataFrame:
    """All events with a BM25 score, terms in the title counting 1.8 times; statistics over all events, scores of admitted ones."""
    rows = _counted(events(spark, d))
    return R.bm25(A.admitted(rows, AS_OF, SCOPES, REPOSITORIES), R.corpus_stats(rows, _Q), _Q).select("eid", "score")


def bm25_filtered_stats(spark: SparkSession, d: str) -> DataFrame:
    """BM25 whose statistics are those of the admitted events only; events that score nothing stay."""
    rows = _counted(_eligible(spark, d))
    return R.bm25(rows, R.corpus_stats(rows, _Q), _Q, False, keep_zero=True).select("eid", "score")


def fts_weighted(spark: SparkSession, d: str) -> DataFrame:
    """Weighted field search over title, body and data."""
    rows = staged(R.field_counts(events(spark, d), _Q, _fields()).drop(*_TEXTS), "fields")
    return R.fielded(rows, _Q).select("eid", "score")


def fuzzy_trigram(spark: SparkSession, d: str) -> DataFrame:
    """Similarity of 3-grams with the query, and the bonus of the whole phrase."""
    return R.fuzzy(R.with_likeness(events(spark, d).select("eid", similar_text().alias("t")), F.col("t"), QUERY)).select("eid", "score")


def admission_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Reasons against each event that isn't admitted."""
    r = events(spark, d).select("eid", F.array_join(A.reasons(AS_OF, SCOPES, REPOSITORIES), ",").alias("reasons"))
    return r.where("reasons <> ''")


def admission_counters(spark: SparkSession, d: str) -> DataFrame:
    """How many events are admitted and why the others aren't."""
    return A.counters(events(spark, d), AS_OF, SCOPES, REPOSITORIES)


def strict_before(spark: SparkSession, d: str) -> DataFrame:
    """Events admitted strictly before the instant, here the time of the latest event of a prompt."""
    ev = events(spark, d)
    return A.admitted(ev, AS_OF, [], [], strict_before=True).groupBy("kind").agg(F.count("*").alias("n"), F.max("ts").alias("latest"))


def disclosure_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events that the scopes allow, by kind and whether they are restricted."""
    ev = events(spark, d).where(~F.array_contains(A.reasons(AS_OF, SCOPES, []), "disclosure"))
    return ev.groupBy("kind", "restricted").agg(F.count("*").alias("n"))


def recency_rank(spark: SparkSession, d: str) -> DataFrame:
    """Without a query: admitted events by time, scored 1 / rank."""
    r = R.ranked(_eligible(spark, d).withColumn("score", F.lit(0.0)))
    return r.select("eid", "rank", R.rounded(1 / F.col("rank"), 9).alias("score"))


def authority_rank(spark: SparkSession, d: str) -> DataFrame:
    """Admitted events of the asked scopes, scored by the rank of their authority."""
    return R.ranked(R.authority(_eligible(spark, d), SCOPES)).select("eid", R.rounded(F.col("score")).alias("score"), "rank")


@dataclass(frozen=True)
class Ask:
    """A text query and what may answer it.

    history keeps superseded events, reciprocal fuses by reciprocal ranks instead of the lexical cascade, and diversity
    below 1 trades score for difference. Without terms in the query events are ranked by time.
    """

    query: str = QUERY
    as_of: int = AS_OF
    scopes: tuple[str, ...] = tuple(SCOPES)
    repositories: tuple[str, ...] = tuple(REPOSITORIES)
    strict_before: bool = False
    history: bool = False
    reciprocal: bool = False
    with_fuzzy: bool = True
    with_graph: bool = True
    diversity: float = 1.0
    limit: int = 20


@dataclass(frozen=True)
class Ranking:
    """fused (eid, ts, score, tier, tier_rank, primary_rank) of current events, the ranked lists by name, rows of all events, eligible ones, edges, and excluded (eid, n_superseders, first_superseder)."""

    ask: Ask
    fused: DataFrame
    lists: dict[str, DataFrame]
    rows: DataFrame
    eligible: DataFrame
    edges: DataFrame
    excluded: DataFrame


def _lists(spark: SparkSession, d: str, ask: Ask = Ask()) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """Ranked lists of all scorers, the measured events and the edges."""
    q = query_terms(ask.query)
    rows = measured(events(spark, d), ask.query)
    eligible = A.admitted(rows, ask.as_of, list(ask.scopes), list(ask.repositories), ask.strict_before)
    scored = {"bm25": R.bm25(eligible, R.corpus_stats(rows, q), q), "fts": R.fielded(eligible, q)}
    if ask.with_fuzzy:
        scored["fuzzy"] = R.fuzzy(eligible)
    # the ranked lists are written; from here on nothing is scored again
    ranks = R.ranked_lists({n: s.select("eid", "ts", "score") for n, s in scored.items()})
    parts = [ranks[n].select("eid", "ts", "score" if n != "fts" else (1 / F.col("rank")).alias("score")) for n in ("bm25", "fuzzy", "fts") if n in ranks]
    seeds = reduce(DataFrame.union, parts).groupBy("eid").agg(F.max("ts").alias("ts"), R.rounded(F.sum("score")).alias("score"))
    ed = edges(spark, d)
    more = {"authority": R.authority(eligible.join(seeds.select("eid"), "eid", "left_semi"), list(ask.scopes)).select("eid", "ts", "score")}
    if ask.with_graph:
        more["graph"] = R.one_hop(seeds, ed, eligible).join(eligible.select("eid", "ts"), "eid").select("eid", "ts", "score")
    ranks |= R.ranked_lists(more)
    return {n: ranks[n] for n in ("bm25", "fuzzy", "fts", "graph", "authority") if n in ranks}, rows, ed


def rank_events(spark: SparkSession, d: str, ask: Ask = Ask()) -> Ranking:
    """Events that answer an ask: admitted, scored by all lists, fused, and without those that an event in force supersedes (but for those that the query names)."""
    admit = lambda df: A.admitted(df, ask.as_of, list(ask.scopes), list(ask.repositories), ask.strict_before)
    none = F.lit(None).cast("long")
    if query_terms(ask.query):
        lists, rows, ed = _lists(spark, d, ask)
        if ask.reciprocal:
            fused = R.reciprocal_rank_fusion(lists).select("eid", "ts", F.lit(0).alias("tier"), none.alias("tier_rank"), none.alias("primary_rank"), R.rounded(F.col("score")).alias("score"))
        else:
            fused = R.lexical_cascade(lists).withColumn("score", R.rounded(F.col("score"), 9))
    else:
        rows, ed = staged(events(spark, d).drop(*_TEXTS), "events"), edges(spark, d)
        newest = R.ranked(admit(rows).withColumn("score", F.lit(0.0)))
        fused = newest.select("eid", "ts", F.lit(0).alias("tier"), F.col("rank").alias("tier_rank"), none.alias("primary_rank"), R.rounded(1 / F.col("rank"), 9).alias("score"))
        lists = {"recency": newest}
    eligible = admit(rows)
    gone = R.superseded(ed, eligible, ask.as_of)
    # written: what is left and what is left out both come from it
    fused = staged(fused, "fused")
    current = R.current_only(fused, gone, ask.query, ask.history)
    excluded = fused.select("eid").join(gone.withColumnRenamed("target", "eid"), "eid").join(current.select("eid"), "eid", "left_anti")
    return Ranking(ask, current, lists, rows, eligible, ed, excluded)


def with_texts(spark: SparkSession, d: str, rows: DataFrame) -> DataFrame:
    """rows with title, body, j, kind and confidence of their events."""
    return rows.join(events(spark, d).select("eid", "title", "body", "j", "kind", "confidence"), "eid")


def selected(ranking: Ranking, spark: SparkSession, d: str) -> DataFrame:
    """(eid, place, score, components) of the first events, at most limit; with diversity below 1 those of maximal marginal relevance."""
    from pyspark.sql import Window

    ask = ranking.ask
    if ask.diversity < 1:
        texts = events(spark, d).select("eid", search_text().alias("text"))
        picks = packs.diverse(ranking.fused.join(texts, "eid").select("eid", "ts", "score", terms(F.col("text")).alias("terms")), ask.diversity, ask.limit).select("eid", F.col("rank").alias("place"), "score")
    else:
        order = [F.desc("score"), *in_order()] if ask.reciprocal else in_order()
        # at most 1,000 rows
        picks = ranking.fused.orderBy(*order).limit(ask.limit).select("eid", F.row_number().over(Window.orderBy(*order)).alias("place"), "score")
    picks = staged(picks, "picks")
    # their places in the lists, at most five each
    ranks = reduce(DataFrame.union, [r.select("eid", F.lit(i).alias("i"), F.concat(F.lit(f"{n}#"), F.col("rank").cast("string")).alias("c")) for i, (n, r) in enumerate(ranking.lists.items())])
    own = ranks.join(picks.select("eid"), "eid").groupBy("eid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda x: x["c"]), ", ").alias("components"))
    return picks.join(own, "eid").select("eid", "place", "score", "components")


def in_order():
    """Order of a cascade's events: tier, rank in it, primary rank, later time, id."""
    return [F.asc("tier"), F.asc("tier_rank"), F.asc_nulls_last("primary_rank"), F.desc_nulls_last("ts"), F.asc("eid")]


def graph_one_hop(spark: SparkSession, d: str) -> DataFrame:
    """Events one relation away from the best by BM25."""
    rows = _counted(events(spark, d))
    eligible = A.admitted(rows, AS_OF, SCOPES, REPOSITORIES)
    seeds = R.bm25(A.admitted(rows, AS_OF, SCOPES, REPOSITORIES), R.corpus_stats(rows, _Q), _Q).select("eid", "ts", "score")
    return R.one_hop(seeds, edges(spark, d), eligible)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Reciprocal rank fusion of the five lists."""
    lists, _, _ = _lists(spark, d)
    return R.reciprocal_rank_fusion(lists).select("eid", R.rounded(F.col("score")).alias("score"))


def cascade_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Lexical cascade of the five lists."""
    lists, _, _ = _lists(spark, d)
    return R.lexical_cascade(lists).select("eid", "tier", "tier_rank", R.rounded(F.col("score"), 9).alias("score"))


def ranked_context(spark: SparkSession, d: str) -> DataFrame:
    """The first twenty events that answer the query, with the lists and ranks that brought them there."""
    return selected(rank_events(spark, d), spark, d)


def recent_context(spark: SparkSession, d: str) -> DataFrame:
    """The same without a query: the latest admitted and current events."""
    return selected(rank_events(spark, d, Ask(query="")), spark, d)


def context_exclusions(spark: SparkSession, d: str) -> DataFrame:
    """Events that would answer the query but are superseded."""
    return rank_events(spark, d).excluded.select("eid", "n_superseders", "first_superseder")


def supersession_current(spark: SparkSession, d: str) -> DataFrame:
    """Admitted decisions that nothing in force supersedes."""
    el = _eligible(spark, d)
    gone = R.superseding(edges(spark, d), el, AS_OF).select(F.col("target").alias("eid"))
    return el.where("kind = 'decision'").join(gone, "eid", "left_anti").select("eid", "subject")


def supersession_history(spark: SparkSession, d: str) -> DataFrame:
    """Superseded admitted events, each with every event that supersedes it."""
    return R.superseding(edges(spark, d), _eligible(spark, d), AS_OF).select(F.col("target").alias("eid"), F.col("source").alias("superseder"))


def conflict_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of admitted events that contradict each other."""
    return R.conflicts(edges(spark, d), _eligible(spark, d))


def coverage_status(spark: SparkSession, d: str) -> DataFrame:
    """Whether one admitted event has all terms of the query."""
    rows = _counted(_eligible(spark, d))
    return R.coverage(rows, _Q, rows.where(" or ".join(f"tf_{i} > 0" for i in range(len(_Q)))))


def evidence_sufficiency(spark: SparkSession, d: str) -> DataFrame:
    """How well the admitted events answer the query; candidates are what the lexical or the fuzzy list finds."""
    rows = A.admitted(measured(events(spark, d), QUERY), AS_OF, SCOPES, REPOSITORIES)
    return R.sufficiency(rows, len(_Q), candidates=rows.where(F.array_max(F.array(*[F.col(f"tf_{i}") for i in range(len(_Q))])) > 0).select("eid").union(R.fuzzy(rows).select("eid")))


def evidence_with_code(spark: SparkSession, d: str) -> DataFrame:
    """The same for a query that names things in code."""
    q, named = query_terms(CODE_QUERY), R.code_entities(CODE_QUERY)
    rows = A.admitted(staged(R.counted(events(spark, d), search_text(), q + named).drop(*_TEXTS), "counted"), AS_OF, SCOPES, REPOSITORIES)
    return R.sufficiency(rows, len(q), len(named))


def federated_packs(spark: SparkSession, d: str) -> DataFrame:
    """Each repository's best three admitted and current events; repositories are ranked apart and never merged."""
    from pyspark.sql import Window

    r = rank_events(spark, d)
    own = r.fused.join(r.eligible.where("repo is not null").select("eid", "repo"), "eid")
    # three rows a repository are kept before the shuffle, so a large one costs no task more
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("repo").orderBy(*in_order()))).where("rank <= 3").select("repo", "rank", "eid", "tier", "score")


def semantic_rerank(spark: SparkSession, d: str) -> DataFrame:
    """Vectors reranked by cosine with the first one, mapped to 0..1."""
    v = table(spark, d, "embeddings")
    first = v.agg(F.min_by("embedding", "vec_id").alias("q"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    e, q = F.col("embedding"), F.col("q")
    return v.crossJoin(F.broadcast(first)).select("vec_id", R.rounded((dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)) + 1) / 2).alias("score"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            inverted_index_df, term_frequencies, avg_doc_len, bm25_topk, bm25_title_boost, bm25_filtered_stats, fts_weighted, fuzzy_trigram, admission_reasons, admission_counters, strict_before, disclosure_filter,
            recency_rank, authority_rank, graph_one_hop, rrf_fusion, cascade_fusion, ranked_context, recent_context, context_exclusions, supersession_current, supersession_history, conflict_pairs, coverage_status, evidence_sufficiency, evidence_with_code, federated_packs, semantic_rerank,
        )
    }


_R6 = "floor(({}) * 1000000 + 0.5) / 1000000"
_SIMILAR = f"concat_ws(chr(10), title, body, {OWN_LINES_SQL})"
_FULL = f"concat_ws(chr(10), title, body, {OWN_LINES_SQL}, {PROJECT_LINES_SQL})"


def _reasons_sql(strict: bool = False, scopes: list[str] = SCOPES, repositories: list[str] = REPOSITORIES) -> str:
    scope = f"(restricted and not coalesce(scope in {in_sql(scopes)}, false))" if scopes else "restricted"
    repo = f"(repo is not null and repo not in {in_sql(repositories)})" if repositories else "false"
    tests = [f"expires <= {AS_OF}", f"ts {'>=' if strict else '>'} {AS_OF}", f"vf > {AS_OF}", f"vu <= {AS_OF}", scope, repo]
    return "list_filter([" + ", ".join(f"case when {t} then '{n}' end" for t, n in zip(tests, A.REASONS)) + "], lambda r: r is not null)"


def _counted_sql(source: str, name: str = "ct", query: list[str] = _Q) -> str:
    own = ", ".join(f"len(list_filter(tk, lambda x: x = '{t}')) tf_{i}, list_contains(tt, '{t}') in_title_{i}" for i, t in enumerate(query))
    return f"{name} as (select *, len(tk) dl, {own} from (select *, {terms_sql(_FULL)} tk, {terms_sql('title')} tt from {source}))"


def _stats_sql(source: str, name: str = "st") -> str:
    return f"{name} as (select greatest(count(*), 1) n, avg(dl) avgdl, " + ", ".join(f"count(*) filter (tf_{i} > 0) df_{i}" for i in range(len(_Q))) + f" from {source})"


def _bm25_sql(boost: bool) -> str:
    parts = []
    for i in range(len(_Q)):
        one = f"ln(1 + (n - df_{i} + 0.5::double) / (df_{i} + 0.5::double)) * (tf_{i} * 2.2::double / (tf_{i} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl)))"
        parts.append(f"(case when tf_{i} > 0 then {one}" + (f" * case when in_title_{i} then 1.8::double else 1.0::double end" if boost else "") + " else 0.0::double end)")
    return _R6.format(" + ".join(parts))


def _fts_sql(source: str, name: str) -> str:
    w = ", ".join(f"len(list_filter(tt, lambda x: x = '{t}')) * 4.0::double + len(list_filter(tb, lambda x: x = '{t}')) * 2.0::double + len(list_filter(td, lambda x: x = '{t}')) * 1.0::double w_{i}" for i, t in enumerate(_Q))
    df = ", ".join(f"count(*) filter (w_{i} > 0) df_{i}" for i in range(len(_Q)))
    parts = " + ".join(f"(case when w_{i} > 0 then greatest(ln((n - df_{i} + 0.5::double) / (df_{i} + 0.5::double)), 1e-6::double) * (w_{i} * 2.2::double / (w_{i} + 1.2::double * (1 - 0.75::double + 0.75::double * dl / avgdl))) else 0.0::double end)" for i in range(len(_Q)))
    return f"""{name}_c as (select *, len(tt) + len(tb) + len(td) dl, {w} from (select *, {terms_sql('title')} tt, {terms_sql('body')} tb, {terms_sql(WORDS_SQL)} td from {source})), {name}_s as (select count(*) n, avg(dl) avgdl, {df} from {name}_c),
 {name} as (select * from (select eid, ts, {_R6.format(parts)} score from {name}_c, {name}_s) where score > 0)"""


def _fuzzy_sql(source: str, name: str) -> str:
    q = " ".join(QUERY.lower().split())
    grams = list(dict.fromkeys(q[i : i + 3] for i in range(len(q) - 2)))
    own = "[" + ", ".join(f"'{g}'" for g in grams) + "]"
    return f"""{name}_n as (select eid, ts, trim(regexp_replace(lower({_SIMILAR}), '[\\s\\x0b\\x{{1c}}-\\x{{1f}}\\x{{85}}\\p{{Z}}]+', ' ', 'g')) nt from {source}),
 {name}_g as (select *, case when length(nt) > 3 then list_distinct(list_transform(range(1, length(nt) - 1), lambda i: substring(nt, i, 3))) when length(nt) > 0 then [nt] else [] end g from {name}_n),
 {name} as (select eid, ts, {_R6.format('raw')} score from (select *, case when len(g) = 0 then 0.0::double else len(list_intersect(g, {own})) / (len(g) + {len(grams)} - len(list_intersect(g, {own})))::double end + case when contains(nt, '{q}') then 0.5::double else 0.0::double end raw from {name}_g) where raw >= 0.025)"""


def _rank_sql(source: str, name: str) -> str:
    return f"{name} as (select *, row_number() over (order by score desc, ts desc nulls last, eid) rank from {source})"


_EL = f"el as (select * from ev where len({_reasons_sql()}) = 0)"
_WEIGHT = "case \"type\" " + " ".join(f"when '{k}' then {v}::double" for k, v in R.RELATION_WEIGHTS.items()) + f" else {R.OTHER_WEIGHT}::double end"


def _hop_sql(seeds: str, name: str) -> str:
    return f"""{name}_b as (select * from {seeds} order by score desc, ts desc nulls last, eid limit 32), {name}_n as (select eid source, score / max(score) over () share from {name}_b),
 {name}_e as (select source, "type", target from ed union all select target, "type", source from ed),
 {name} as (select target eid, max({_R6.format(f'share * {_WEIGHT}')}) score from {name}_e join {name}_n using (source) group by 1 having target in (select eid from el) and max({_R6.format(f'share * {_WEIGHT}')}) > 0)"""


def _sufficiency_sql(query: list[str], named: list[str]) -> str:
    """One row from ct (counts of the query's and then the named terms) and th (whether there is a candidate)."""
    n, m = len(query), len(named)
    conf = "case confidence " + " ".join(f"when '{k}' then {v}::double" for k, v in R.CONFIDENCE.items()) + " else 0.5::double end"
    hits = lambda a, b: " + ".join(f"(tf_{i} > 0)::int" for i in range(a, b)) or "0"
    raw = f"0.45::double * ratio + 0.3::double * (ents / {float(m)}::double) + 0.1::double * least(1.0::double, support / 2.0::double) + 0.15::double * confidence" if m else "0.65::double * ratio + 0.15::double * least(1.0::double, support / 2.0::double) + 0.2::double * confidence"
    return f"""o as (select ({hits(0, n)}) / {float(n)}::double ratio, ({hits(n, n + m)})::int ents, {conf} conf, seq from ct), bo as (select * from o order by ratio desc, ents desc, seq limit 1),
 a as (select coalesce((select ratio from bo), 0.0::double) ratio, coalesce((select ents from bo), 0) ents, (select conf from bo) conf, (select count(*) from o where ratio >= 0.2 or ents > 0) support, there from th),
 s as (select *, case when ratio > 0 or ents > 0 then conf else 0.0::double end confidence from a), z as (select *, {_R6.format(raw)} score from s),
 y as (select *, case when score >= 0.65 then 'DIRECTLY_SUPPORTED' when score >= 0.4 and there then 'PARTIALLY_SUPPORTED' else 'INSUFFICIENT_EVIDENCE' end state from z)
 select {_R6.format('ratio')} ratio, support, ents::int entities, confidence, score, state, case when state = 'DIRECTLY_SUPPORTED' then 'ACCEPT_DIRECT' else 'ABSTAIN' end decision,
  concat_ws(',', case when not there then 'NO_DIRECT_CANDIDATE' end, case when ratio < 0.2 then 'LOW_TERM_COVERAGE' end, case when ents = 0 and {m} > 0 then 'NO_CODE_ENTITY_MATCH' end, case when support < 2 then 'SINGLE_OR_NO_SUPPORT' end, case state when 'DIRECTLY_SUPPORTED' then 'CONSERVATIVE_DIRECT_THRESHOLD_MET' when 'PARTIALLY_SUPPORTED' then 'PARTIAL_EVIDENCE_ONLY' else 'INSUFFICIENT_THRESHOLD' end, case when state <> 'DIRECTLY_SUPPORTED' then 'ABSTAIN' end) reasons from y"""


def oracle() -> dict[str, str]:
    ev = f"with {EVENTS_SQL}, "
    boosted = f"b as (select eid, ts, score from (select ct.*, {_bm25_sql(True)} score from ct, st) where score > 0 and len({_reasons_sql()}) = 0)"
    base = ev + f"{EDGES_SQL}, {_EL}, {_counted_sql('ev')}, {_stats_sql('ct')}, {boosted}"
    lists = f"""{base}, {_fuzzy_sql('el', 'fz')}, {_fts_sql('el', 'ft')}, {_rank_sql('b', 'r_bm25')}, {_rank_sql('fz', 'r_fuzzy')}, {_rank_sql('ft', 'r_fts')},
 sd as (select eid, max(ts) ts, {_R6.format('sum(score)')} score from (select eid, ts, score from b union all select eid, ts, score from fz union all select eid, ts, 1.0::double / rank from r_fts) group by eid),
 {_hop_sql('sd', 'hp')}, gr as (select hp.eid, el.ts, hp.score from hp join el using (eid)), {_rank_sql('gr', 'r_graph')},
 au as (select eid, ts, 1 + coalesce(arank, 0) / 100.0::double score from el where scope in {in_sql(SCOPES)} and eid in (select eid from sd)), {_rank_sql('au', 'r_authority')}"""
    union = " union all ".join(f"select eid, ts, rank, '{n}' list, {i} pos, {w}::double w from r_{n}" for i, (n, w) in enumerate((n, R.LIST_WEIGHTS[n]) for n in ("bm25", "fuzzy", "fts", "graph", "authority")))
    gone = f"""sp as (select distinct source, target from ed where "type" = 'supersedes' and source <> target), gp as (select target, source from sp join el s on s.eid = sp.source where coalesce(s.vf, s.ts) <= {AS_OF} and target in (select eid from el)), gn as (select target, count(*) n, min(source) by_ from gp group by 1)"""
    cascade = f"""{lists}, u as (select eid, max(ts) ts, string_agg(list || '#' || rank, ', ' order by pos) components, min(rank) filter (list = 'fts') fts, min(rank) filter (list = 'bm25') bm25, min(rank) filter (list = 'fuzzy') fuzzy, min(rank) filter (list = 'graph') graph, min(rank) filter (list = 'authority') authority from ({union}) group by eid),
 p as (select *, least(fts, bm25) primary_ from u), t as (select *, case when authority is not null and primary_ is not null then 0 when primary_ is not null then 1 when fuzzy is not null then 2 when graph is not null then 3 end tier from p),
 kk as (select *, case tier when 0 then authority when 1 then primary_ when 2 then fuzzy else graph end tier_rank from t where tier is not null), k as (select *, floor(1.0::double / (1 + 1000 * tier + tier_rank) * 1000000000 + 0.5) / 1000000000 score from kk)"""
    current = f"{cascade}, {gone}, cu as (select * from k where eid not in (select target from gn where not contains('{QUERY}', target)))"
    ordered = "tier, tier_rank, primary_ nulls last, ts desc nulls last, eid"
    matched = " + ".join(f"(tf_{i} > 0)::int" for i in range(len(_Q)))
    code_q, code_e = query_terms(CODE_QUERY), R.code_entities(CODE_QUERY)
    has = lambda x: f"list_contains(r, '{x}')"
    return {
        "inverted_index_df": ev + f"o as (select eid, unnest({terms_sql(_FULL)}) term from ev), t as (select term, eid, count(*) tf from o group by all) select term, count(*) df, sum(tf)::bigint cf from t group by term",
        "term_frequencies": ev + f"o as (select eid, unnest({terms_sql(_FULL)}) term from ev) select eid, term, count(*) tf from o group by all",
        "avg_doc_len": ev + f"x as (select len({terms_sql(_FULL)}) dl from ev) select count(*) n, {_R6.format('avg(dl)')} avgdl from x",
        "bm25_topk": ev + f"{_counted_sql('ev')}, {_stats_sql('ct')} select eid, score from (select eid, ts, {_bm25_sql(False)} score from ct, st) where score > 0 order by score desc, ts desc nulls last, eid limit {TOP}",
        "bm25_title_boost": base + " select eid, score from b",
        "bm25_filtered_stats": ev + f"{_EL}, {_counted_sql('el')}, {_stats_sql('ct')} select eid, {_bm25_sql(False)} score from ct, st",
        "fts_weighted": ev + _fts_sql("ev", "ft") + " select eid, score from ft",
        "fuzzy_trigram": ev + _fuzzy_sql("ev", "fz") + " select eid, score from fz",
        "admission_reasons": ev + f"x as (select eid, array_to_string({_reasons_sql()}, ',') reasons from ev) select * from x where reasons <> ''",
        "admission_counters": ev + f"x as (select {_reasons_sql()} r from ev) select count(*) filter (len(r) = 0) admitted, count(*) filter ({has('expired')}) expired, count(*) filter ({has('future')}) future, count(*) filter ({has('not-yet-valid')}) not_yet_valid, count(*) filter ({has('stale')}) stale, count(*) filter ({has('disclosure')} or {has('repository')}) unauthorized from x",
        "strict_before": ev + f"x as (select * from ev where len({_reasons_sql(True, [], [])}) = 0) select kind, count(*) n, max(ts) latest from x group by kind",
        "disclosure_filter": ev + f"x as (select * from ev where not list_contains({_reasons_sql(False, SCOPES, [])}, 'disclosure')) select kind, restricted, count(*) n from x group by all",
        "recency_rank": ev + f"{_EL}, x as (select eid, row_number() over (order by ts desc nulls last, eid) rank from el) select eid, rank, floor(1.0::double / rank * 1000000000 + 0.5) / 1000000000 score from x",
        "authority_rank": ev + f"{_EL}, x as (select eid, ts, 1 + coalesce(arank, 0) / 100.0::double score from el where scope in {in_sql(SCOPES)}) select eid, {_R6.format('score')} score, row_number() over (order by score desc, ts desc nulls last, eid) rank from x",
        "graph_one_hop": base + f", {_hop_sql('b', 'hp')} select eid, score from hp",
        "rrf_fusion": lists + f" select eid, {_R6.format('list_reduce(list_prepend(0.0::double, list(w / (60 + rank) order by pos)), lambda a, x: a + x)')} score from ({union}) group by eid",
        "cascade_fusion": cascade + " select eid, tier, tier_rank, score from k",
        "ranked_context": current + f", o as (select eid, row_number() over (order by {ordered})::int place, score, components from cu) select * from o where place <= 20",
        "recent_context": ev + f"{EDGES_SQL}, {_EL}, {gone}, r as (select eid, row_number() over (order by ts desc nulls last, eid) rank from el), c as (select * from r where eid not in (select target from gn)), o as (select eid, row_number() over (order by rank)::int place, floor(1.0::double / rank * 1000000000 + 0.5) / 1000000000 score, 'recency#' || rank components from c) select * from o where place <= 20",
        "context_exclusions": f"{cascade}, {gone} select target eid, n n_superseders, by_ first_superseder from gn where target in (select eid from k) and not contains('{QUERY}', target)",
        "supersession_current": ev + f"{EDGES_SQL}, {_EL}, {gone} select eid, subject from el where kind = 'decision' and eid not in (select target from gn)",
        "supersession_history": ev + f"{EDGES_SQL}, {_EL}, {gone} select target eid, source superseder from gp",
        "conflict_pairs": ev + f"""{EDGES_SQL}, {_EL} select distinct least(source, target) a, greatest(source, target) b from ed where "type" = 'contradicts' and source <> target and source in (select eid from el) and target in (select eid from el)""",
        "coverage_status": ev + f"{_EL}, {_counted_sql('el')}, m as (select coalesce(max({matched}), 0) m from ct) select case when m = 0 then 'none' when m = {len(_Q)} then 'direct' else 'partial' end status, m::int matched_terms, {len(_Q)}::int query_terms from m",
        "evidence_sufficiency": ev + f"{_EL}, {_counted_sql('el')}, {_fuzzy_sql('el', 'fz')}, th as (select (select count(*) from ct where {matched} > 0) + (select count(*) from fz) > 0 there), " + _sufficiency_sql(_Q, []),
        "evidence_with_code": ev + f"{_EL}, {_counted_sql('el', query=code_q + code_e)}, th as (select count(*) > 0 there from ct where {' or '.join(f'tf_{i} > 0' for i in range(len(code_q)))}), " + _sufficiency_sql(code_q, code_e),
        "federated_packs": f"{current} select repo, row_number() over (partition by repo order by tier, tier_rank, primary_ nulls last, cu.ts desc nulls last, eid)::int rank, eid, tier, score from cu join el using (eid) where repo is not null qualify rank <= 3",
        "semantic_rerank": "with q as (select embedding q from embeddings order by vec_id limit 1) select vec_id, " + _R6.format("(list_dot_product(embedding::double[], q::double[]) / sqrt(list_dot_product(embedding::double[], embedding::double[]) * list_dot_product(q::double[], q::double[])) + 1) / 2") + " score from embeddings, q",
    }
