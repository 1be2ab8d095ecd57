"""Bounded packs of cited evidence: token plans, diverse selection, filling and rendering.

A pack has at most 1,000 items; filling works on that many rows, after the ranking has been done by Spark. The diverse
selection goes over all candidates.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.functions.text import jaccard
from sedimark.runtime import staged

MAX_ITEMS = 1000
EXCERPT = 2000


def estimate_tokens(text: str) -> int:
    """A quarter of the characters, rounded up."""
    return math.ceil(len(text) / 4)


@dataclass(frozen=True)
class Reservation:
    """A part of the token budget: granted its minimum, then by priority its target, then its maximum."""

    name: str
    minimum: int
    target: int
    maximum: int
    priority: int
    overflow: str = "truncate"


@dataclass(frozen=True)
class TokenPlan:
    total: int
    reserved: int
    available: int
    grants: dict[str, int] = field(default_factory=dict)
    overflow: dict[str, str] = field(default_factory=dict)


def token_plan(total: int, reserved: int | None = None, reservations: list[Reservation] | None = None) -> TokenPlan:
    """Splits a budget over framing, citations and content. By default a tenth (2,048 at most) is held back, framing aims at a fifth and citations at a quarter (64 at least)."""
    if not 128 <= total <= 1_000_000:
        raise ValueError("total must be 128 to 1,000,000")
    held = min(2048, total // 10) if reserved is None else reserved
    if not 0 <= held <= total - 64:
        raise ValueError("reserved leaves less than 64")
    rest = total - held
    if reservations is None:
        framing, citations = max(64, rest // 5), max(64, rest // 4)
        reservations = [Reservation("framing", 0, framing, rest, 100, "error"), Reservation("citations", 0, citations, rest, 90), Reservation("content", 0, max(0, rest - framing - citations), rest, 50)]
    if len({r.name for r in reservations}) != len(reservations) or any(not 0 <= r.minimum <= r.target <= r.maximum for r in reservations):
        raise ValueError("reservations must have different names and minimum <= target <= maximum")
    grants = {r.name: r.minimum for r in reservations}
    left = rest - sum(grants.values())
    if left < 0:
        raise ValueError("minimums exceed the budget")
    for level in ("target", "maximum"):
        for r in sorted(reservations, key=lambda r: (-r.priority, r.name)):
            more = min(left, max(0, getattr(r, level) - grants[r.name]))
            grants[r.name] += more
            left -= more
    return TokenPlan(total, held, rest, grants, {r.name: r.overflow for r in reservations})


def diverse(candidates: DataFrame, trade: float = 0.82, limit: int = 20) -> DataFrame:
    """(eid, rank, score) by maximal marginal relevance of candidates(eid, ts, score, terms), of any number.

    Each step takes the largest trade * score / best - (1 - trade) * likeness, likeness being the largest Jaccard
    similarity of terms with what is selected; equals go by later time, then id. A step is a distributed maximum over
    all candidates, which are staged once and carry their likeness so far.
    """
    spark = candidates.sparkSession
    rows = staged(candidates.select("eid", "ts", F.col("score").cast("double").alias("score"), F.array_distinct("terms").alias("terms")), "candidates")
    best = rows.agg(F.max("score")).first()[0] or 1.0
    picks, near = [], F.lit(0.0)
    value = lambda: F.lit(trade) * F.col("score") / F.lit(best) - F.lit(1 - trade) * near
    while len(picks) < limit:
        left = rows.where(~F.col("eid").isin([p.eid for p in picks])) if picks else rows
        top = left.withColumn("_value", value()).orderBy(F.desc("_value"), F.desc_nulls_last("ts"), "eid").limit(1).collect()
        if not top:
            break
        picks += top
        own = F.array(*[F.lit(t) for t in top[0].terms]).cast("array<string>")
        near = F.greatest(near, jaccard(F.col("terms"), own))
    return spark.createDataFrame([(p.eid, i, p.score) for i, p in enumerate(picks, 1)], "eid string, rank int, score double")


def _text(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: object) -> str:
    """sha256 of the canonical JSON of a value."""
    return "sha256:" + hashlib.sha256(_text(value).encode()).hexdigest()


def excerpt(item: dict, query: str = "", limit: int = EXCERPT) -> str:
    """What an item says: body and data; of a project's snapshot the files that the query's words name, most words first."""
    data = item.get("data")
    parsed = json.loads(data) if data else None
    project = parsed.get("projectStructure") if isinstance(parsed, dict) else None
    files = project.get("files") if isinstance(project, dict) else None
    if isinstance(files, str):
        try:
            files = json.loads(files)
        except ValueError:
            files = None
    if isinstance(files, list):
        words = {w for w in query.lower().replace("/", " ").split() if len(w) > 1}
        named = [(sum(w in str(f.get("path", "")).lower() for w in words), str(f.get("path", ""))) for f in files if isinstance(f, dict)]
        lines = [path for _, path in sorted(named, key=lambda x: (-x[0], x[1]))]
        text = "\n".join([f"{len(files)} files", *lines])
    else:
        compact = _text(parsed) if parsed not in (None, {}, []) else ""
        text = "\n".join(x for x in (item.get("body") or "", compact if len(compact) <= 1200 else compact[:1197] + "...") if x)
    return text if len(text) <= limit else text[: limit - 3] + "..."


def fill(items: list[dict], max_chars: int, header: dict | None = None, tokens: TokenPlan | None = None, estimate: Callable[[str], int] = estimate_tokens, query: str = "") -> dict:
    """The pack of ranked items(eid, title, body, ...) that fits: whole items in order, and of the first that doesn't fit as much of the excerpt as does.

    used_chars counts the pack as it is written, itself included. With a plan of tokens the items' citations (all but
    their excerpts), the excerpts and the frame have their grants, and the pack's estimate stays within what is available.
    A grant whose reservation says `error` raises when it is exceeded, others end the pack. Raises if not even the
    header fits.
    """

    def written(chosen: list[dict]) -> dict:
        pack = {"header": header or {}, "items": chosen, "max_chars": max_chars, "used_chars": 0}
        for _ in range(12):
            n = len(_text(pack))
            if n == pack["used_chars"]:
                break
            pack["used_chars"] = n
        return pack

    def spent(chosen: list[dict]) -> dict[str, int]:
        cited = [{k: v for k, v in x.items() if k != "excerpt"} for x in chosen]
        return {"framing": estimate(_text(header or {})), "citations": estimate(_text(cited)) if cited else 0, "content": sum(estimate(x["excerpt"]) for x in chosen)}

    def fits(chosen: list[dict]) -> bool:
        if written(chosen)["used_chars"] > max_chars:
            return False
        if tokens is None:
            return True
        used = spent(chosen)
        for name, n in used.items():
            if n > tokens.grants.get(name, tokens.available):
                if tokens.overflow.get(name) == "error":
                    raise ValueError(f"{name} needs {n} tokens of {tokens.grants[name]}")
                return False
        return sum(used.values()) <= tokens.available

    if not fits([]):
        raise ValueError("the budget is too small for the query and the frame")
    chosen: list[dict] = []
    for item in items[:MAX_ITEMS]:
        one = {k: v for k, v in item.items() if k not in ("body", "data")} | {"excerpt": excerpt(item, query)}
        if one.get("reason"):
            one["reason"] = one["reason"] if len(one["reason"]) <= 512 else one["reason"][:509] + "..."
        if fits([*chosen, one]):
            chosen.append(one)
            continue
        low, high = 0, len(one["excerpt"])
        while low < high:
            mid = (low + high + 1) // 2
            if fits([*chosen, one | {"excerpt": one["excerpt"][:mid], "truncated": True}]):
                low = mid
            else:
                high = mid - 1
        if low:
            chosen.append(one | {"excerpt": one["excerpt"][:low], "truncated": True})
        break
    pack = written(chosen)
    return pack | {"manifest": digest({"header": pack["header"], "items": pack["items"]})} | ({"tokens": spent(chosen)} if tokens else {})


def gate(status: str, state: str, minimum_coverage: str = "any", minimum_evidence: str = "any") -> None:
    """Raises if the coverage or then the evidence of a query is below what is asked (any, partial, direct)."""
    order = {"any": 0, "partial": 1, "direct": 2}
    have = {"direct": 2, "partial": 1}.get(status, 0)
    if have < order[minimum_coverage]:
        raise LookupError(f"coverage is {status}, {minimum_coverage} is asked")
    have = {"DIRECTLY_SUPPORTED": 2, "PARTIALLY_SUPPORTED": 1}.get(state, 0)
    if have < order[minimum_evidence]:
        raise LookupError(f"evidence is {state}, {minimum_evidence} is asked")


def inline(text: str, limit: int = 512) -> str:
    """Text on one line, with Markdown's signs escaped."""
    flat = " ".join(str(text).split())[:limit]
    return "".join("\\" + c if c in "\\`*_{}[]()#+!|<>" else c for c in flat)


def markdown(pack: dict) -> str:
    """A pack as Markdown."""
    lines = ["# Evidence", ""]
    for i, item in enumerate(pack["items"], 1):
        lines += [f"## {i}. {inline(item.get('title') or item['eid'])}", "", f"- id: `{item['eid']}`", "", *("> " + x for x in item["excerpt"].splitlines()), ""]
    return "\n".join([*lines, f"Manifest: `{pack['manifest']}`", ""])


def capsule(summary: dict, pack: dict, limit: int = 4096) -> str:
    """A short handoff: one summary and the manifest of the pack it rests on."""
    head, tail = f"Handoff: {inline(summary.get('title') or '')}\n", f"\nPack: {pack['manifest']}\nItems: {len(pack['items'])}\n"
    body = summary.get("body") or ""
    room = limit - len(head) - len(tail)
    return head + (body if len(body) <= room else body[: max(0, room - 3)] + "...") + tail


# fixed values: words that a task's profile adds to its query
FOCUS = {
    "debugging": "failure error reproduction regression logs traces recent changes",
    "code-review": "design decision changed files policy security tests approval",
    "feature-implementation": "requirements architecture decision affected files interfaces tests",
    "database-migration": "schema migration rollback compatibility data integrity approval",
    "incident-response": "incident impact timeline mitigation evidence owner rollback",
    "release-preparation": "release version checks approval migration documentation rollback",
    "security-review": "threat boundary credential authorization policy dependency vulnerability evidence",
}


def task_query(task: str, query: str) -> str:
    """The query of a task with its profile's focus words; its pack asks for partial coverage unless told otherwise."""
    return f"{query.strip()} {FOCUS[task]}".strip()
