"""Which events a query may see at an instant, and why not the others."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REASONS = ("expired", "future", "not-yet-valid", "stale", "disclosure", "repository")


def reasons(as_of: int, scopes: list[str], repositories: list[str], strict_before: bool = False) -> Column:
    """The reasons against each event in a fixed order; an empty list admits it.

    Null bounds never exclude, a null repository passes, an empty list of repositories allows all. Under strict_before
    an event at the instant itself is in the future.
    """
    t = F.lit(as_of)
    tests = [
        F.col("expires") <= t,
        F.col("ts") >= t if strict_before else F.col("ts") > t,
        F.col("vf") > t,
        F.col("vu") <= t,
        F.col("restricted") & ~F.coalesce(F.col("scope").isin(scopes) if scopes else F.lit(False), F.lit(False)),
        F.col("repo").isNotNull() & ~F.col("repo").isin(repositories) if repositories else F.lit(False),
    ]
    return F.filter(F.array(*[F.when(test, F.lit(name)) for test, name in zip(tests, REASONS)]), lambda r: r.isNotNull())


def admitted(events: DataFrame, as_of: int, scopes: list[str], repositories: list[str], strict_before: bool = False) -> DataFrame:
    """The events without a reason against them."""
    return events.where(F.size(reasons(as_of, scopes, repositories, strict_before)) == 0)


def counters(events: DataFrame, as_of: int, scopes: list[str], repositories: list[str], strict_before: bool = False) -> DataFrame:
    """One row: admitted, expired, future, not_yet_valid, stale and unauthorized events; disclosure and repository together count once."""
    r = events.select(reasons(as_of, scopes, repositories, strict_before).alias("r"))
    has = lambda n: F.array_contains("r", n)
    return r.agg(
        F.count_if(F.size("r") == 0).alias("admitted"), F.count_if(has("expired")).alias("expired"), F.count_if(has("future")).alias("future"), F.count_if(has("not-yet-valid")).alias("not_yet_valid"),
        F.count_if(has("stale")).alias("stale"), F.count_if(has("disclosure") | has("repository")).alias("unauthorized"),
    )
