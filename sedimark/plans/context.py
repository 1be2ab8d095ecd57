"""A cited pack that answers a text: ranking, gates, budget and items."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sedimark.functions.text import query_terms
from sedimark.operators import admission as A
from sedimark.operators import packs
from sedimark.operators import ranking as R
from sedimark.plans.ranking import Ask, rank_events, selected, with_texts


def expanded(query: str, expand: Callable[[str], list[str]] | None) -> str:
    """The query with the terms that a function adds to it: at most 16, of at most 256 characters."""
    if expand is None:
        return query
    more = expand(query)
    if len(more) > 16 or any(not t.strip() or len(t) > 256 for t in more):
        raise ValueError("an expansion has at most 16 terms, none blank or longer than 256 characters")
    return " ".join([query, *sorted({t.strip() for t in more})])[:4096].strip()


def compile_context(
    spark: SparkSession, d: str, ask: Ask = Ask(), max_chars: int = 24_000, minimum_coverage: str = "any", minimum_evidence: str = "any", tokens: packs.TokenPlan | None = None, estimate: Callable[[str], int] = packs.estimate_tokens, expand: Callable[[str], list[str]] | None = None
) -> dict:
    """The pack of at most ask.limit items (1,000 at most) that fits max_chars and, if given, the plan of tokens.

    Only admitted and current events come into it. Raises if the coverage or the evidence is below what is asked. The
    header tells how the events were ranked, what admission and supersession left out, and conflicts among the items.
    """
    if not 1 <= ask.limit <= packs.MAX_ITEMS or not 512 <= max_chars <= 1_000_000 or len(ask.query) > 4096:
        raise ValueError("limit is 1 to 1,000, max_chars 512 to 1,000,000, the query at most 4,096 characters")
    asked = ask.query
    ask = replace(ask, query=expanded(ask.query, expand))
    ranking = rank_events(spark, d, ask)
    q = query_terms(ask.query)
    if q:
        any_term = ranking.eligible.where(" or ".join(f"tf_{i} > 0" for i in range(len(q))))
        candidates = any_term.select("eid").union(R.fuzzy(ranking.eligible).select("eid"))
        coverage = R.coverage(ranking.eligible, q, candidates).first()
        evidence = R.sufficiency(ranking.eligible, len(q), candidates=candidates).first()
    else:
        coverage = R.coverage(ranking.eligible, [], ranking.eligible.limit(0)).first()
        evidence = R.sufficiency(ranking.eligible, 0).first()
    packs.gate(coverage.status, evidence.state, minimum_coverage, minimum_evidence)
    first = selected(ranking, spark, d)
    rows = [r.asDict() for r in with_texts(spark, d, first).orderBy("place").select("eid", "kind", "confidence", "title", "body", F.col("j").alias("data"), "score", F.col("components").alias("reason")).collect()]
    chosen = {r["eid"] for r in rows}
    few = min(100, 2 * ask.limit)
    # pairs with one of at most 1,000 items, so both filters are small lists
    pairs = R.conflicts(ranking.edges, ranking.eligible).where(F.col("a").isin(list(chosen)) | F.col("b").isin(list(chosen))).orderBy("a", "b").limit(few).collect() if chosen else []
    left_out = ranking.excluded.orderBy("eid").limit(few).collect()
    counts = A.counters(ranking.rows, ask.as_of, list(ask.scopes), list(ask.repositories), ask.strict_before).first().asDict()
    header = {"query": asked, "as_of": ask.as_of, "coverage": coverage.asDict(), "filters": {k: v for k, v in counts.items() if k != "admitted" and v}, "conflicts": [[p.a, p.b] for p in pairs], "exclusions": [[x.eid, x.first_superseder] for x in left_out]}
    if minimum_evidence != "any":
        header["evidence"] = evidence.asDict()
    if expand is not None:
        header["added_terms"] = len(q) - len(query_terms(asked))
    return packs.fill(rows, max_chars, header, tokens, estimate, ask.query)
