"""Command line: python -m sedimark list | run QUERY --tables DIR --out DIR | query TEXT --tables DIR [--markdown] [--as-of MS] [--scope S]... [--repository R]... | build --tables DIR --out DIR."""

from __future__ import annotations

import argparse
import importlib
import json
import time

PLANS = ["problems", "ranking", "readmodel", "evaluation", "graph", "lifecycle", "parts"]


def queries() -> dict:
    """All queries of the core."""
    out: dict = {}
    for m in PLANS:
        out |= importlib.import_module(f"sedimark.plans.{m}").queries()
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="sedimark")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("list", help="names of the queries")
    run = sub.add_parser("run", help="write a query's result as Parquet")
    run.add_argument("name")
    ask = sub.add_parser("query", help="a cited pack that answers a text")
    ask.add_argument("text")
    ask.add_argument("--max-chars", type=int, default=12_000)
    ask.add_argument("--markdown", action="store_true")
    ask.add_argument("--as-of", type=int, help="instant in milliseconds; now if not given")
    ask.add_argument("--scope", action="append", default=[], help="authority scope that may be disclosed")
    ask.add_argument("--repository", action="append", default=[], help="repository to look in; all if none is given")
    ask.add_argument("--limit", type=int, default=20)
    ask.add_argument("--diversity", type=float, default=1.0)
    ask.add_argument("--history", action="store_true", help="keep superseded events")
    ask.add_argument("--strict-before", action="store_true", help="leave out events at the instant itself")
    ask.add_argument("--minimum-coverage", choices=["any", "partial", "direct"], default="any")
    ask.add_argument("--minimum-evidence", choices=["any", "partial", "direct"], default="any")
    ask.add_argument("--max-tokens", type=int, help="budget of estimated tokens, split over framing, citations and content")
    build = sub.add_parser("build", help="write the derived views")
    for x in (run, build):
        x.add_argument("--out", required=True)
    for x in (run, ask, build):
        x.add_argument("--tables", required=True)
    a = p.parse_args(argv)
    if a.verb == "list":
        print("\n".join(sorted(queries())))
        return 0
    from pyspark.sql import SparkSession

    from sedimark.operators import packs
    from sedimark.plans import base, ranking
    from sedimark.plans.context import compile_context
    from sedimark.sinks import export
    from sedimark.sources.log import publish

    spark = SparkSession.builder.appName("sedimark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.verb == "run":
        queries()[a.name](spark, a.tables).write.mode("overwrite").parquet(a.out)
    elif a.verb == "build":
        publish(export.views(base.events(spark, a.tables), base.edges(spark, a.tables)), a.out)
    else:
        as_of = int(time.time() * 1000) if a.as_of is None else a.as_of
        ask = ranking.Ask(a.text, as_of, tuple(a.scope), tuple(a.repository), a.strict_before, a.history, limit=a.limit, diversity=a.diversity)
        tokens = packs.token_plan(a.max_tokens) if a.max_tokens else None
        pack = compile_context(spark, a.tables, ask, a.max_chars, a.minimum_coverage, a.minimum_evidence, tokens)
        print(packs.markdown(pack) if a.markdown else json.dumps(pack, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
