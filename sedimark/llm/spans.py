"""Problem 8: spans of at least `least` characters that stand verbatim in more than one document.

Every run of `least` characters holds at least one anchor, the window's smallest hash of GRAM characters, and equal
runs hold equal anchors. Only the surroundings of anchors that two texts have can hold a shared run; these regions are
the reference shards, of at most SHARD characters each. A suffix automaton is built of each shard and regions of other
documents are streamed through it: their matching statistics give the maximal shared spans. The automata aren't
broadcast to all tasks, since they grow with the corpus; each goes to the tasks that its candidates are sent to.

Which documents are streamed through which automata depends on what is asked. For pairs, candidates must agree on
nearly a whole run around an anchor: one of SPLITS long grams. For the shared part of each document one partner per
run is enough, so each run of `least` characters names one document that stands for all that have it, and a text that
very many documents share costs one stream for each of them.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.runtime import staged

LEAST = 300
GRAM = 64
#: Characters hashed at once; longer texts are taken in chunks that overlap by a window.
CHUNK = 4 << 20
#: Candidates of one reference that go to one task.
SHARE = 2048
#: Characters of one automaton, at most; longer regions are cut with an overlap of least - 1, so that no run is lost.
SHARD = 1 << 16
#: Long grams around an anchor; each is least - (least - GRAM) / SPLITS characters long.
SPLITS = 4

_BASE = 0x9E3779B97F4A7C15
_NONE = np.uint64(2**64 - 1)
_LOW = np.uint64(0xFFFFFF)


def hashes(text: str, size: int) -> np.ndarray:
    """Hashes of all runs of size characters: polynomials over code points, got from prefix sums modulo 2**64, and mixed."""
    s = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    n = len(s)
    if n < size:
        return np.zeros(0, np.uint64)
    power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 2**64), np.uint64)
    power[0] = inverse[0] = 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((s + np.uint64(1)) * np.multiply.accumulate(power), out=sums[1:])
    h = (sums[size:] - sums[:-size]) * np.multiply.accumulate(inverse)[: n - size + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def anchors(pieces: list[str], least: int = LEAST, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, piece number, place) of the anchors of pieces, together at most 2**24 characters.

    The anchor of each window of least-gram+1 grams is the one with the smallest hash, the leftmost of equals.
    """
    window = least - gram + 1
    empty = np.zeros(0, np.int64)
    h = hashes("".join(pieces), gram)
    if len(h) < window:
        return empty.astype(np.uint64), empty, empty
    ends = np.cumsum([len(p) for p in pieces])
    v = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    across = (ends[:-1, None] - np.arange(1, gram)[None, :]).ravel()
    v[across[(across >= 0) & (across < len(v))]] = _NONE
    pad = -len(v) % window
    blocks = np.concatenate([v, np.full(pad, _NONE)]).reshape(-1, window)
    forward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least_of = np.minimum(back[: len(v) - window + 1], forward[window - 1 : len(v)])
    chosen = least_of[np.concatenate([[True], least_of[1:] != least_of[:-1]])]
    at = np.unique((chosen[chosen != _NONE] & _LOW).astype(np.int64))
    piece = np.searchsorted(ends, at, side="right")
    return h[at], piece, at - np.concatenate([[0], ends])[piece]


class SuffixAutomaton:
    """All substrings of a text, as states with transitions and suffix links."""

    __slots__ = ("next", "link", "length")

    def __init__(self, text: str) -> None:
        nxt: list[dict[str, int]] = [{}]
        link, length = array("i", [-1]), array("i", [0])
        last = 0
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][ch]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(nxt[q].copy())
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        self.next, self.link, self.length = nxt, link, length

    def spans(self, text: str, least: int, first_only: bool) -> list[tuple[int, int]]:
        """Maximal spans [start, end) of text whose matching statistic reaches least, overlapping ones united. With first_only it stops once there is one."""
        nxt, link, length = self.next, self.link, self.length
        state = matched = 0
        out: list[tuple[int, int]] = []
        for i, ch in enumerate(text):
            to = nxt[state].get(ch)
            if to is None:
                while state != -1 and (to := nxt[state].get(ch)) is None:
                    state = link[state]
                if state == -1:
                    state = matched = 0
                    continue
                matched = length[state]
            state = to
            matched += 1
            if matched >= least:
                start = i + 1 - matched
                if out and start <= out[-1][1]:
                    out[-1] = (min(start, out[-1][0]), i + 1)
                else:
                    out.append((start, i + 1))
                if first_only:
                    return out
        return out


def _thinned(doc: np.ndarray, h: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Which of the sorted anchors are needed: in text that repeats itself an equal anchor is left out if its neighbours are at most a window apart, so that every window still has one."""
    keep = np.ones(len(doc), bool)
    same = (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    last = -1
    for i in np.flatnonzero(same):
        if i == 0 or not same[i - 1]:
            last = at[i]  # the first of its group
            continue
        # anchors i and i + 1 are equal, and so is an earlier one that was kept at last
        if at[i + 1] - last <= window:
            keep[i] = False
        else:
            last = at[i]
    return keep


def _fingerprints(documents: DataFrame, least: int, gram: int) -> DataFrame:
    """(doc_id, digest of the text, anchors, their places, whether equal ones were left out) of texts that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            digest = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
            pieces = [(d, a, t[a : a + CHUNK]) for d, t in enumerate(texts) for a in range(0, max(1, len(t) - least + 1), CHUNK - least + 1)]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            some: list[tuple[int, int, str]] = []
            for k, p in enumerate(pieces):
                some.append(p)
                if k + 1 == len(pieces) or sum(len(x[2]) for x in some) + len(pieces[k + 1][2]) > CHUNK:
                    h, piece, at = anchors([x[2] for x in some], least, gram)
                    found.append((np.array([x[0] for x in some], np.int64)[piece], h.view(np.int64), at + np.array([x[1] for x in some], np.int64)[piece]))
                    some = []
            doc, h, at = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3
            order = np.lexsort((at, h, doc))
            doc, h, at = doc[order], h[order], at[order]
            keep = _thinned(doc, h, at, least - gram + 1)
            # whether others of the same document and hash were left out
            group = np.cumsum(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(doc) else doc
            thinned = np.isin(group, group[~keep])
            doc, h, at, thinned = doc[keep], h[keep], at[keep], thinned[keep]
            cuts = pa.array(np.searchsorted(doc, np.arange(len(ids) + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x)) for x in (h, at.astype(np.int32), thinned)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digest, pa.binary()), *lists], names=["doc_id", "digest", "hashes", "places", "thinned"])

    return documents.select("doc_id", "text").where(F.length("text") >= least).mapInArrow(run, "doc_id long, digest binary, hashes array<long>, places array<int>, thinned array<boolean>")


def _keys(text: str, places: list[int], least: int, gram: int) -> list[int]:
    """Hashes of the long grams around the anchors of a text, in order.

    A run that holds an anchor reaches some way to its left and the rest to its right, so it holds one of the grams that
    reach 0, 1, ... of SPLITS parts to the left and the other parts but one to the right.
    """
    part = (least - gram) // SPLITS
    out = []
    for p in places:
        for i in range(SPLITS):
            a, e = p - i * part, p + gram + (SPLITS - 1 - i) * part
            if a >= 0 and e <= len(text):
                out.append(int.from_bytes(hashlib.blake2b(text[a:e].encode(), digest_size=8).digest(), "little", signed=True))
    return out


def _regions(near: DataFrame, documents: DataFrame, least: int, gram: int, keys: bool) -> DataFrame:
    """(doc_id, starts, parts, keys): the parts of the texts in which a run of least characters around a shared anchor can lie, and the long grams around these anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            starts, parts, grams = [], [], []
            for text, places in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                cuts: list[list[int]] = []
                places = sorted(places)
                for p in places:
                    a, e = max(0, p - least + gram), min(len(text), p + least)
                    if cuts and a <= cuts[-1][1]:
                        cuts[-1][1] = e
                    else:
                        cuts.append([a, e])
                starts.append([a for a, _ in cuts])
                parts.append([text[a:e] for a, e in cuts])
                grams.append(_keys(text, places, least, gram) if keys else [])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts, pa.list_(pa.int32())), pa.array(parts, pa.list_(pa.string())), pa.array(grams, pa.list_(pa.int64()))], names=["doc_id", "starts", "parts", "keys"])

    return near.join(documents.select("doc_id", "text"), "doc_id").select("doc_id", "text", "places").mapInArrow(run, "doc_id long, starts array<int>, parts array<string>, keys array<long>")


def _shards(least: int):
    """Regions -> (ref, shard, parts) of at most SHARD characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            refs, numbers, shards = [], [], []
            for ref, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist()):
                some: list[list[str]] = [[]]
                size = 0
                for p in parts:
                    for a in range(0, max(1, len(p) - least + 1), SHARD - least + 1):
                        piece = p[a : a + SHARD]
                        if size and size + len(piece) > SHARD:
                            some.append([])
                            size = 0
                        some[-1].append(piece)
                        size += len(piece)
                refs += [ref] * len(some)
                numbers += range(len(some))
                shards += some
            yield pa.RecordBatch.from_arrays([pa.array(refs, pa.int64()), pa.array(numbers, pa.int32()), pa.array(shards, pa.list_(pa.string()))], names=["ref", "shard", "parts"])

    return run


_MATCH = "ref long, doc_id long, span_starts array<int>, span_ends array<int>"


def _matches(least: int, first_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task's rows are sorted: each shard's own row (doc_id null) comes before its candidates
        machine: list[SuffixAutomaton] = []
        for b in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for ref, doc, starts, parts in zip(*(b.column(c).to_pylist() for c in ("ref", "doc_id", "starts", "parts"))):
                if doc is None:
                    machine = [SuffixAutomaton(p) for p in parts]
                    continue
                spans = []
                for a, p in zip(starts, parts):
                    for m in machine:
                        spans += [(a + x, a + y) for x, y in m.spans(p, least, first_only)]
                        if spans and first_only:
                            break
                    if spans and first_only:
                        break
                if spans:
                    spans.sort()
                    for x, v in zip(out, (ref, doc, [s for s, _ in spans], [e for _, e in spans])):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int32())), pa.array(out[3], pa.list_(pa.int32()))], names=["ref", "doc_id", "span_starts", "span_ends"])

    return run


def _prepared(documents: DataFrame, least: int, keys: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(classes, near, regions): documents by the text that they share whole (rep, doc_id), the anchors that two texts have, and their regions. Stages three tables."""
    gram = min(GRAM, max(4, least // 2))
    documents = documents.where("doc_id is not null")
    prints = staged(_fingerprints(documents, least, gram), "prints")
    reps = prints.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    classes = prints.select("doc_id", "digest").join(reps, "digest").select("rep", "doc_id")
    own = prints.join(reps.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi")
    one = F.explode(F.arrays_zip("hashes", "places", "thinned")).alias("a")
    places = own.select("doc_id", one).select("doc_id", F.col("a.hashes").alias("anchor"), F.col("a.places").alias("place"), F.col("a.thinned").alias("thinned"))
    common = places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor")
    near = staged(places.join(common, "anchor"), "near")
    regions = staged(_regions(near.groupBy("doc_id").agg(F.collect_list("place").alias("places")), documents, least, gram, keys), "regions")
    return classes, near, regions


def _streamed(pairs: DataFrame, regions: DataFrame, least: int, first_only: bool) -> DataFrame:
    """Matches (ref, doc_id, span_starts, span_ends) of pairs(ref, doc_id): the regions of doc_id streamed through the automata of ref. Stages two tables."""
    shards = staged(regions.join(pairs.select(F.col("ref").alias("doc_id")).distinct(), "doc_id", "left_semi").select("doc_id", "parts").mapInArrow(_shards(least), "ref long, shard int, parts array<string>"), "shards")
    counts = pairs.groupBy("ref").agg(F.ceil(F.count("*") / SHARE).alias("shares")).join(shards.groupBy("ref").agg(F.count("*").alias("n")), "ref")
    sent = pairs.join(counts, "ref").select("ref", "doc_id", F.pmod(F.xxhash64("doc_id"), F.col("shares")).alias("share"), F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("shard"))
    sent = staged(sent, "candidates")
    references = sent.select("ref", "share", "shard").distinct().join(shards, ["ref", "shard"]).select("ref", "share", "shard", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("array<int>").alias("starts"), "parts")
    candidates = sent.join(regions.select("doc_id", "starts", "parts"), "doc_id").select("ref", "share", "shard", "doc_id", "starts", "parts")
    rows = references.unionByName(candidates).repartition("ref", "share", "shard").sortWithinPartitions("ref", "share", "shard", F.col("doc_id").asc_nulls_first())
    return rows.mapInArrow(_matches(least, first_only), _MATCH)


def sharing_texts(documents: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of documents(doc_id, text).

    links (ref, doc_id), ref < doc_id: two documents that stand for their texts share a span of at least `least`
    characters. classes (rep, doc_id): the documents with the same text, rep being the smallest id. Null and shorter
    texts share nothing, rows without doc_id are left out.

    Candidates have a long gram in common; where they go on agreeing, only the first such gram names them. In text that
    repeats itself some of a document's equal anchors are left out, so such anchors by themselves name candidates too.
    """
    classes, near, regions = _prepared(documents, least, True)
    keyed = regions.select("doc_id", F.posexplode("keys").alias("n", "key"), "keys").select("doc_id", "key", F.when(F.col("n") > 0, F.element_at("keys", F.col("n"))).alias("before")).distinct()
    held = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("key")
    held = staged(keyed.join(held, "key"), "grams")
    a, b = held.select("key", F.col("doc_id").alias("ref"), F.col("before").alias("b1")), held.select("key", "doc_id", F.col("before").alias("b2"))
    pairs = a.join(b, "key").where("ref < doc_id and (b1 is null or b2 is null or b1 <> b2)").select("ref", "doc_id")
    thin = near.where("thinned").select("anchor").distinct()
    alike = near.join(thin, "anchor").groupBy("anchor", "doc_id").agg(F.max("thinned").alias("thinned"))
    x, y = alike.select("anchor", F.col("doc_id").alias("ref"), F.col("thinned").alias("t1")), alike.select("anchor", "doc_id", F.col("thinned").alias("t2"))
    pairs = pairs.union(x.join(y, "anchor").where("ref < doc_id and (t1 or t2)").select("ref", "doc_id"))
    return _streamed(staged(pairs.distinct(), "pairs"), regions, least, True).select("ref", "doc_id").distinct(), classes


def _runs(least: int):
    """Regions -> (run, doc_id): the hash of each distinct run of least characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, parts in zip(b.column("doc_id").to_pylist(), b.column("parts").to_pylist()):
                h = np.unique(np.concatenate([hashes(p, least) for p in parts])) if parts else np.zeros(0, np.uint64)
                for at in range(0, len(h), 1 << 16):
                    some = h[at : at + (1 << 16)].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.full(len(some), doc, np.int64))], names=["run", "doc_id"])

    return run


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by run and document: (ref, doc_id), the first document of a run for all others and the last for the first. Pairs of a batch once."""
    last_run, first, last = None, None, None
    for b in batches:
        run, doc = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(run):
            continue
        begins = np.concatenate([[last_run is None or run[0] != last_run], run[1:] != run[:-1]])
        at = np.flatnonzero(begins)
        firsts = np.where(np.cumsum(begins) == 0, first if first is not None else 0, doc[at[np.maximum(np.cumsum(begins) - 1, 0)]] if len(at) else first)
        refs, docs = [firsts[~begins]], [doc[~begins]]
        # runs that have ended: the last of theirs stands for the first
        stops = at[at > 0] - 1
        refs.append(doc[stops])
        docs.append(firsts[stops])
        if last_run is not None and begins[0]:
            refs.append(np.array([last]))
            docs.append(np.array([first]))
        last_run, first, last = run[-1], firsts[-1], doc[-1]
        yield _pairs(refs, docs)
    if last_run is not None:
        yield _pairs([np.array([last])], [np.array([first])])


def _pairs(refs: list[np.ndarray], docs: list[np.ndarray]) -> pa.RecordBatch:
    both = np.stack([np.concatenate(refs), np.concatenate(docs)], axis=1).astype(np.int64)
    both = np.unique(both[both[:, 0] != both[:, 1]], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["ref", "doc_id"])


def _by(*columns: str):
    return Window.partitionBy(*columns)


def document_pairs(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(lo_doc_id, hi_doc_id) of all documents that share a span, copies of one text included (every pair is asked for)."""
    links, classes = sharing_texts(documents, least)
    a, b = classes.select(F.col("rep").alias("ref"), F.col("doc_id").alias("one")), classes.select(F.col("rep").alias("doc_id"), F.col("doc_id").alias("two"))
    between = links.join(a, "ref").join(b, "doc_id").select(F.least("one", "two").alias("lo_doc_id"), F.greatest("one", "two").alias("hi_doc_id"))
    x, y = classes.alias("x"), classes.alias("y")
    within = x.join(y, (F.col("x.rep") == F.col("y.rep")) & (F.col("x.doc_id") < F.col("y.doc_id"))).select(F.col("x.doc_id").alias("lo_doc_id"), F.col("y.doc_id").alias("hi_doc_id"))
    return between.union(within)


def shared_share(documents: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, class_id, n_copies, partner_id, shared_chars, n_chars) of every document.

    class_id is the smallest document with the same whole text, n_copies the number of the others, shared_chars the
    characters that lie in a span shared with any other document, partner_id the smallest document with another text
    that such a span was found with (null if there is none). A text that has copies is shared as a whole if it has at
    least `least` characters. Pairs are never made: each run of `least` characters has one document that stands for all
    that hold it, and each document is streamed through the automata of the few that stand for its runs.
    """
    classes, _, regions = _prepared(documents, least, False)
    runs = regions.select("doc_id", "parts").mapInArrow(_runs(least), "run long, doc_id long")
    pairs = runs.repartition("run").sortWithinPartitions("run", "doc_id").mapInArrow(_partners, "ref long, doc_id long").distinct()
    matches = _streamed(staged(pairs, "partners"), regions, least, False)
    spans = matches.select("doc_id", "ref", F.explode(F.arrays_zip("span_starts", "span_ends")).alias("s")).groupBy("doc_id", F.col("s.span_starts").alias("a"), F.col("s.span_ends").alias("e")).agg(F.min("ref").alias("ref"))
    before = F.coalesce(F.max("e").over(_by("doc_id").orderBy("a", "e").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), F.col("e") - F.greatest(F.col("a"), before))).groupBy("doc_id").agg(F.sum("new").alias("covered"), F.min("ref").alias("partner_id"))
    sizes = classes.groupBy("rep").agg((F.count("*") - 1).alias("n_copies"))
    of_rep = sizes.join(covered.withColumnRenamed("doc_id", "rep"), "rep", "left")
    of_doc = classes.join(of_rep, "rep")
    zero = F.lit(0).cast("long")
    n = F.length("text").cast("long")
    return documents.select("doc_id", F.coalesce(n, zero).alias("n_chars")).join(of_doc, "doc_id", "left").select(
        "doc_id", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_copies", zero).alias("n_copies"), "partner_id", F.when(F.col("n_copies") > 0, F.col("n_chars")).otherwise(F.coalesce("covered", zero)).alias("shared_chars"), "n_chars"
    )
