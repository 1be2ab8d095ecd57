"""Texts and names that the fit hasn't seen: five sixths of the directory are withheld, and half of the texts."""

import os
import random
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from sedimark.llm import pii

FOLDER = os.environ.get("HELDOUT_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def data():
    hooks = pq.read_table(f"{FOLDER}/claude_hooks.parquet", columns=["prompt", "tool_response"])
    bodies = pq.read_table(f"{FOLDER}/ledger_events.parquet", columns=["body"])["body"].to_pylist()
    texts = sorted({t for t in [*bodies, *hooks["prompt"].to_pylist(), *hooks["tool_response"].to_pylist()] if t and len(t) > 4})
    members = [(m["given_name"], m["family_name"]) for m in pq.read_table(f"{FOLDER}/workspace_members.parquet").to_pylist()]
    random.seed(1)
    random.shuffle(members)
    random.shuffle(texts)
    return texts, members


def test_names_outside_the_directory_are_found_in_unseen_texts(data):
    texts, members = data
    known, withheld = members[:60], members[60:]
    seen, unseen = texts[::2], texts[1::2]
    lexicon = pii.lexicon_of(seen, known)
    field = pii.fit(seen, known, lexicon)
    g, f = {pii.plain(a) for a, _ in known}, {pii.plain(b) for _, b in known}
    new = [(a, b) for a, b in withheld if pii.plain(a) not in g and pii.plain(b) not in f]
    pattern = re.compile("|".join(rf"\b{re.escape(a)}[  ]{re.escape(b)}\b|\b{re.escape(b)}, {re.escape(a)}\b" for a, b in new), re.I)
    whole = pii.lexicon_of(texts, members)
    full = pii.fit(texts, members, whole)
    hit = total = right = said = 0
    for t in unseen:
        clear, _ = pii.readable(t)
        got = {(s, e) for k, s, e in pii.items(clear, field, lexicon) if k == "person_name"}
        spots = [m.span() for m in pattern.finditer(clear)]
        total += len(spots)
        hit += sum(s in got for s in spots)
        # right if the fit on all texts and the whole directory says so too
        said += len(got)
        right += len(got & {(s, e) for k, s, e in pii.items(clear, full, whole) if k == "person_name"})
    print("names found", hit, "of", total, "right", right, "of", said)
    assert total >= 10 and hit / total >= 0.9 and right / said >= 0.9


def test_other_types_in_unseen_texts(data):
    """Signs taken away: of numbers the words that introduce them, of mail addresses the directory. The fit has other texts, and what it finds is held against all shapes that aren't part of a name in code or of a remote."""
    texts, members = data
    seen, unseen = texts[::2], texts[1::2]
    lexicon = pii.lexicon_of(seen, members[:60])
    field = pii.fit(seen, members[:60], lexicon)
    yes, hit, wrong = Counter(), Counter(), Counter()
    for t in unseen:
        clear, _ = pii.readable(t)
        clear = re.sub(pii._NUMBER_WORDS, "qq", clear, flags=re.I)
        got = {(k, s) for k, s, _ in pii.items(clear, field, {})}
        for n in pii.nodes_of(clear):
            if n.kind == "word" or n.kind == "id_number" and n.word.isdigit():
                continue
            after = clear[n.end : n.end + 2]
            real = not pii._continued(n.features) if n.kind == "id_number" else not (after[:1] == ":" and after[1:2].isalnum()) if n.kind == "email" else True
            yes[n.kind] += real
            hit[n.kind] += real and (n.kind, n.start) in got
            wrong[n.kind] += not real and (n.kind, n.start) in got
    print("found", {k: (hit[k], yes[k], wrong[k]) for k in yes})
    for k in ("email", "phone", "id_number", "address"):
        assert yes[k] >= 10 and hit[k] / yes[k] >= 0.9 and hit[k] / max(1, hit[k] + wrong[k]) >= 0.9, k
