"""Queries that judge rankings and classifiers, audit texts, build evaluation sets, and run as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.functions.identity import canonical_id, hook_name
from sedimark.functions.text import rounded
from sedimark.operators import evaluation as E
from sedimark.operators import packs, similar
from sedimark.operators import readmodel as M
from sedimark.operators.ordered import greedy_skip, positions
from sedimark.plans.base import EVENTS_SQL, QUERY, events
from sedimark.plans.problems import _trim, canonical_sql
from sedimark.plans.context import compile_context
from sedimark.plans.ranking import Ask, rank_events, selected
from sedimark.runtime import scratch, send_package, table
from sedimark.streaming import ingest

LEVEL = 0.7
GRID = (0.65, 0.7, 0.75, 0.8)
SHARES = (0.1, 0.25, 0.5, 0.75, 1.0)
BUDGETS = (512, 1024, 2048, 4096, 8192)


def _observations(spark: SparkSession, d: str) -> DataFrame:
    """(eid, repo, score, positive): events with an authority rank, positive if verified or claimed."""
    return events(spark, d).where("arank is not null").select("eid", "repo", (F.col("arank") / 100.0).alias("score"), F.coalesce(F.col("confidence").isin("verified", "claimed"), F.lit(False)).alias("positive"))


def _rankings(spark: SparkSession, d: str) -> DataFrame:
    """Decisions of each subject by authority, with grades by confidence."""
    last = lambda c: F.coalesce(-F.col(c).cast("long"), F.lit(2**63 - 1))
    grade = F.when(F.col("confidence") == "verified", 2).when(F.col("confidence") == "claimed", 1).otherwise(0)
    rows = events(spark, d).where("kind = 'decision' and subject is not null").select("subject", last("arank").alias("below"), last("ts").alias("age"), "eid", grade.alias("grade"))
    return positions(rows, "subject", ["below", "age", "eid"], []).select("subject", "eid", F.col("row_no").alias("rank"), "grade")


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Recall, precision, reciprocal rank and nDCG of each subject's ranking."""
    return E.retrieval_metrics(_rankings(spark, d), "subject")


def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    """Area under the ROC curve, ties a half."""
    return E.roc_auc(_observations(spark, d))


def average_precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision, equal scores as one step."""
    return E.average_precision(_observations(spark, d))


def brier_ece(spark: SparkSession, d: str) -> DataFrame:
    """Brier score and expected calibration error."""
    return E.calibration(_observations(spark, d))


def risk_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Risk at five levels of coverage."""
    return E.risk_coverage(_observations(spark, d), SHARES)


def threshold_loro(spark: SparkSession, d: str) -> DataFrame:
    """For each repository the threshold that the others choose."""
    return E.leave_one_out(_observations(spark, d).where("repo is not null"), "repo", GRID)


def decision_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1, false accepts and coverage of each repository at one threshold; null where nothing can be divided by."""
    o = _observations(spark, d)
    yes, pos = F.col("score") >= LEVEL, F.col("positive")
    g = o.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(yes & pos).alias("tp"), F.count_if(yes & ~pos).alias("fp"), F.count_if(~yes & pos).alias("fn"))
    ratio = lambda a, b: rounded(F.try_divide(a, b))
    c = F.col
    return g.select("repo", "n", ratio(c("tp"), c("tp") + c("fp")).alias("precision"), ratio(c("tp"), c("tp") + c("fn")).alias("recall"), ratio(2 * c("tp"), 2 * c("tp") + c("fp") + c("fn")).alias("f1"), ratio(c("fp"), c("n") - c("tp") - c("fn")).alias("false_accept_rate"), ratio(c("tp") + c("fp"), c("n")).alias("coverage"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Share of positives with an interval from resampled repositories."""
    g = _observations(spark, d).where("repo is not null").groupBy(F.col("repo").alias("cluster")).agg(F.count_if("positive").alias("total"), F.count("*").alias("n"))
    return E.cluster_bootstrap(g, 10_000)


def mcnemar_power(spark: SparkSession, d: str) -> DataFrame:
    """Power of the exact paired test for 40 pairs over a grid of discordance and effect."""
    grid = [(p, e) for p in (0.1, 0.2, 0.3, 0.4) for e in (0.05, 0.1, 0.15, 0.2) if e <= p]
    return spark.createDataFrame([(40, p, e, round(E.mcnemar_power(40, p, e), 6)) for p, e in grid], "pairs int, discordance double, effect double, power double")


def budget_curve(spark: SparkSession, d: str) -> DataFrame:
    """How many of each subject's decisions by authority a token budget holds, skipping what is too big, for five budgets."""
    last = lambda c: F.coalesce(-F.col(c).cast("long"), F.lit(2**63 - 1))
    tokens = F.ceil(F.length(F.coalesce("body", F.lit(""))) / 4).cast("long")
    rows = events(spark, d).where("kind = 'decision' and subject is not null").select("subject", last("arank").alias("below"), last("ts").alias("age"), "eid", tokens.alias("tokens"))
    kept = greedy_skip(rows, "subject", ["below", "age", "eid"], "tokens", list(BUDGETS))
    each = [F.struct(F.lit(b).alias("budget"), F.count_if(F.col("kept")[i]).alias("n"), F.sum(F.when(F.col("kept")[i], F.col("tokens")).otherwise(0)).alias("used")) for i, b in enumerate(BUDGETS)]
    return kept.groupBy("subject").agg(F.array(*each).alias("all")).select("subject", F.inline("all"))


def near_dup_shingles(spark: SparkSession, d: str) -> DataFrame:
    """Classes of documents with the same audited text, and how many other classes are nearly the same."""
    return similar.similar_classes(table(spark, d, "documents"), 0.85)


def exact_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Audited texts that several documents have, and from how many sources they are."""
    t = table(spark, d, "documents").select("source", similar.audit_text(F.col("text")).alias("t")).where("t <> ''")
    g = t.groupBy(F.sha2("t", 256).alias("digest"), "source").agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n_documents"), F.count("source").alias("n_sources"))
    return g.where("n_documents > 1")


def _timed(spark: SparkSession, d: str) -> DataFrame:
    """(repo, ts, eid, kind, n, total): events of each repository numbered by time over range partitions, with how many it has."""
    rows = events(spark, d).where("repo is not null and ts is not null").select("repo", "ts", "eid", "kind")
    placed = positions(rows, "repo", ["ts", "eid"], []).withColumnRenamed("row_no", "n")
    return placed.join(placed.groupBy("repo").agg(F.count("*").alias("total")), "repo")


def _phase():
    return F.when(F.col("n") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("total") + 0.5)), "warmup").otherwise("heldout")


def chrono_split(spark: SparkSession, d: str) -> DataFrame:
    """The first fifth of each repository's events by time as warm-up, the rest held out."""
    return _timed(spark, d).select("repo", "eid", _phase().alias("phase"))


def date_quartile(spark: SparkSession, d: str) -> DataFrame:
    """Quarter of each repository's events by time: floor(4 i / n) + 1 for i from 0."""
    return _timed(spark, d).select("repo", "eid", (F.floor((F.col("n") - 1) * 4 / F.col("total")) + 1).alias("quartile"))


def repository_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Events, first and last time and repeated deliveries of each repository."""
    r = table(spark, d, "ledger_events").select("repository_id", canonical_id(F.col("event_id")).alias("eid"), F.unix_millis("event_timestamp").alias("ts"))
    one = r.groupBy("repository_id", "eid").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return one.groupBy("repository_id").agg(F.count("eid").alias("events"), F.min("first").alias("first_ms"), F.max("last").alias("last_ms"), F.sum(F.when(F.col("eid").isNotNull(), F.col("n") - 1).otherwise(0)).alias("repeats"))


def task_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Claims that can be asked about: not in the warm-up and with earlier events of their repository, by how long that history is."""
    t = _timed(spark, d)
    # what is earlier is all before the first of the same time
    firsts = t.groupBy("repo", "ts").agg((F.min("n") - 1).alias("history"))
    c = t.where("kind = 'claim'").join(firsts, ["repo", "ts"])
    state = F.when(_phase() == "warmup", "development").when(F.col("history") == 0, "no prior memory").when(F.col("history") <= 3, "1-3").when(F.col("history") <= 10, "4-10").otherwise("11+")
    return c.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def file_history(spark: SparkSession, d: str) -> DataFrame:
    """For each artifact and file the artifact before it that has the same file."""
    rows = table(spark, d, "ledger_events").where("kind = 'artifact'").select("row_id", M.whole_json(F.col("data_json")).alias("j"))
    raw = F.get_json_object("j", "$.projectStructure.files")
    # elements are taken as texts: a list may hold other things than files
    files = F.when(F.startswith(F.ltrim(raw), F.lit("{")), F.array(raw)).otherwise(F.from_json(raw, "array<string>"))
    one = rows.select("row_id", F.explode(F.array_distinct(F.transform(files, lambda f: F.get_json_object(f, "$.path")))).alias("path")).where("path is not null")
    return positions(one, "path", ["row_id"], ["row_id"]).select("row_id", "path", F.col("prev_row_id").alias("previous"))


def mmr_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Twenty events that answer the query and differ from one another."""
    return selected(rank_events(spark, d, Ask(diversity=0.82)), spark, d).select("eid", F.col("place").alias("rank"), "score")


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    """Items of the pack of 12,000 characters that answers the query."""
    pack = compile_context(spark, d, Ask(limit=50), max_chars=12_000)
    return _items(spark, pack)


def task_pack(spark: SparkSession, d: str) -> DataFrame:
    """Items of the pack for a task: the query with the words of its profile, and at least partial coverage."""
    pack = compile_context(spark, d, Ask(query=packs.task_query("incident-response", QUERY), limit=20), max_chars=8_000, minimum_coverage="partial")
    return _items(spark, pack)


def _items(spark: SparkSession, pack: dict) -> DataFrame:
    rows = [(i, x["eid"], x["title"], x["excerpt"], float(x["score"]), x["reason"]) for i, x in enumerate(pack["items"], 1)]
    return spark.createDataFrame(rows, "place int, eid string, title string, excerpt string, score double, reason string")


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    """The ledger read as a stream, each id and hash once."""
    rows = ingest.file_stream(spark, f"{d}/ledger_events.parquet*", spark.read.parquet(f"{d}/ledger_events.parquet").schema)
    own = rows.select(canonical_id(F.col("event_id")).alias("eid"), canonical_id(F.col("event_hash")).alias("hash")).where("eid is not null")
    return ingest.run_to_table(ingest.once_by(own, ["eid", "hash"]), scratch(spark, "stream"))


def stream_sequence(spark: SparkSession, d: str) -> DataFrame:
    """Numbered tool calls read as a stream: whether each follows its producer's last."""
    send_package(spark)
    rows = ingest.file_stream(spark, f"{d}/claude_hooks.parquet*", spark.read.parquet(f"{d}/claude_hooks.parquet").schema)
    ident = canonical_id(F.col("tool_use_id"))
    number = F.regexp_extract(ident, r"^call_(\d{1,15})$", 1)
    producer = F.concat(canonical_id(F.col("session_id")), F.lit("|"), hook_name(F.col("hook_event_name")))
    calls = rows.select(F.when(number != "", producer).alias("producer"), F.when(number != "", number).try_cast("long").alias("number")).where("producer is not null and number is not null")
    return ingest.run_to_table(ingest.sequence_continuity(calls), scratch(spark, "stream"))


_FUNCTIONS = (
    retrieval_metrics, roc_auc, average_precision, brier_ece, risk_coverage, threshold_loro, decision_metrics, bootstrap_ci, mcnemar_power, budget_curve, near_dup_shingles, exact_overlap, chrono_split, date_quartile,
    repository_manifest, task_manifest, file_history, mmr_diverse, context_pack, task_pack, stream_dedup, stream_sequence,
)


def queries() -> dict:
    return {f.__name__: f for f in _FUNCTIONS}


def oracle() -> dict[str, str]:
    ev = f"with {EVENTS_SQL}, "
    r6 = "floor(({}) * 1000000 + 0.5) / 1000000"
    obs = ev + "ob as (select eid, repo, arank / 100.0::double score, coalesce(confidence in ('verified', 'claimed'), false) positive from ev where arank is not null)"
    rk = ev + "rk as (select subject, eid, body, row_number() over (partition by subject order by arank desc nulls last, ts desc nulls last, eid) rank, case confidence when 'verified' then 2 when 'claimed' then 1 else 0 end grade from ev where kind = 'decision' and subject is not null)"
    steps = "g as (select score, count(*) n, count(*) filter (positive) pos from ob group by 1), s as (select *, coalesce(sum(n) over w, 0) above_n, coalesce(sum(pos) over w, 0) above_pos from g window w as (order by score desc rows between unbounded preceding and 1 preceding))"
    audit = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(text, '')), 'https?://[^\s\x0b\x{1c}-\x{1f}\x{85}\p{Z}\x{feff}]+', ' <url> ', 'g'), '\b[0-9a-f]{7,40}\b', ' <sha> ', 'g'), '\b[0-9]+(?:\.[0-9]+)*\b', ' <num> ', 'g'), '[^\p{L}\p{N}_<>]+', ' ', 'g'))"
    timed = ev + "t as (select repo, eid, ts, kind, row_number() over (partition by repo order by ts, eid) n, count(*) over (partition by repo) total, rank() over (partition by repo order by ts) - 1 history from ev where repo is not null and ts is not null)"
    phase = "case when n <= greatest(1, floor(0.2::double * total + 0.5::double)) then 'warmup' else 'heldout' end"
    grid = ", ".join(f"({t}::double)" for t in GRID)
    budgets = ", ".join(f"({b})" for b in BUDGETS)
    shares = ", ".join(f"({t}::double)" for t in SHARES)
    div = lambda a, b: r6.format(f"({a}) / nullif({b}, 0)::double")
    return {
        "retrieval_metrics": rk + f""", i as (select subject, sum((pow(2, grade) - 1) / log2(i + 1)) ideal from (select *, row_number() over (partition by subject order by grade desc, rank) i from rk) where i <= 10 group by 1),
 m as (select subject, count(*) filter (grade > 0) n, {', '.join(f'count(*) filter (grade > 0 and rank <= {k}) w{k}' for k in (1, 5, 10))}, coalesce(1.0::double / min(rank) filter (grade > 0 and rank <= 10), 0) rr, sum(case when rank <= 10 then (pow(2, grade) - 1) / log2(rank + 1) else 0 end) dcg from rk group by 1)
 select m.subject, {', '.join(f"{r6.format(f'w{k} / n::double')} recall_{k}" for k in (1, 5, 10))}, {', '.join(f"{r6.format(f'w{k} / {k}.0::double')} precision_{k}" for k in (5, 10))}, {r6.format('rr')} rr_10, {r6.format('dcg / ideal')} ndcg_10 from m join i using (subject) where n > 0""",
        "roc_auc": obs + f", {steps} select sum(pos)::bigint positives, sum(n - pos)::bigint negatives, {r6.format('sum((n - pos) * (above_pos + pos / 2.0::double)) / nullif(sum(pos) * sum(n - pos), 0)')} auc from s",
        "average_precision": obs + f", {steps} select {r6.format('sum(pos * (above_pos + pos) / (above_n + n)::double) / nullif(sum(pos), 0)')} average_precision from s",
        "brier_ece": obs + f", b as (select least(floor(score * 10), 9) b, count(*) n, sum(score) s, sum(positive::int) y, sum((score - positive::int) * (score - positive::int)) e from ob group by 1) select {r6.format('sum(e) / sum(n)')} brier, {r6.format('sum(abs(s - y)) / sum(n)')} ece from b",
        "risk_coverage": obs + f", r as (select positive, row_number() over (order by score desc, eid) n, count(*) over () total from ob), l as (select * from (values {shares}) v(coverage)) select coverage, count(*) n, {r6.format('count(*) filter (not positive) / count(*)::double')} risk from r join l on n <= ceil(total * coverage) group by 1",
        "threshold_loro": obs + f""", l as (select * from (values {grid}) v(t)), r as (select repo, t, count(*) filter (score >= t and positive) tp, count(*) filter (score >= t and not positive) fp from ob, l where repo is not null group by all),
 a as (select t, sum(tp) atp, sum(fp) afp from r group by 1), c as (select repo, t, tp, fp from r join a using (t) where afp = fp qualify row_number() over (partition by repo order by atp - tp desc, t) = 1)
 select r.repo, c.t threshold, c.tp, c.fp from (select distinct repo from r) r left join c using (repo)""",
        "decision_metrics": obs + f", g as (select repo, count(*) n, count(*) filter (score >= {LEVEL} and positive) tp, count(*) filter (score >= {LEVEL} and not positive) fp, count(*) filter (score < {LEVEL} and positive) fn from ob group by 1) select repo, n, {div('tp', '(tp + fp)')} \"precision\", {div('tp', '(tp + fn)')} recall, {div('2 * tp', '(2 * tp + fp + fn)')} f1, {div('fp', '(n - tp - fn)')} false_accept_rate, {div('tp + fp', 'n')} coverage from g",
        "budget_curve": ev + f"""t as (select subject, ceil(length(coalesce(body, '')) / 4.0)::bigint tokens, arank, ts, eid from ev where kind = 'decision' and subject is not null), g as (select subject, list(tokens order by arank desc nulls last, ts desc nulls last, eid) sizes from t group by 1), b as (select * from (values {budgets}) v(budget)),
 f as (select subject, budget, list_reduce(list_prepend({{'u': 0::bigint, 'n': 0::bigint}}, list_transform(sizes, lambda x: {{'u': x, 'n': 1::bigint}})), lambda a, x: case when a.u + x.u <= budget then {{'u': a.u + x.u, 'n': a.n + 1}} else a end) r from g, b) select subject, budget::int budget, r.n n, r.u used from f""",
        "mcnemar_power": """with g as (select p::double p, e::double e from (values (0.1), (0.2), (0.3), (0.4)) a(p), (values (0.05), (0.1), (0.15), (0.2)) b(e) where e <= p), m as (select range::double m from range(41)),
 c as (select m, range::double k, exp(lgamma(m + 1) - lgamma(range + 1) - lgamma(m - range + 1)) c from m, range(41) where range <= m), t as (select *, sum(c) over (partition by m order by k) / pow(2, m) below from c),
 r as (select c.m, c.k, c.c from c join t on t.m = c.m and t.k = least(c.k, c.m - c.k) where least(1.0, 2 * t.below) <= 0.05)
 select 40::int pairs, p discordance, e effect, round(sum(exp(lgamma(41) - lgamma(m + 1) - lgamma(41 - m)) * pow(p, m) * pow(1 - p, 40 - m) * c * pow((p + e) / (2 * p), k) * pow(1 - (p + e) / (2 * p), m - k)), 6) "power" from g, r group by p, e""",
        "near_dup_shingles": f"""with t as (select doc_id, {audit} t from documents), k as (select *, case when t = '' then doc_id else min(doc_id) over (partition by t) end class_id from t), w as (select doc_id, list_filter(string_split(t, ' '), lambda x: x <> '') w from k where doc_id = class_id),
 s as (select doc_id, unnest(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) s from w where len(w) >= 5), n as (select doc_id, count(*) n from s group by 1),
 p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by all), l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c / (x.n + y.n - c)::double >= 0.85::double),
 c as (select d class_id, count(*) n_links from (select a d from l union all select b from l) group by 1) select doc_id, k.class_id, coalesce(n_links, 0) n_links from k left join c on c.class_id = k.class_id""",
        "exact_overlap": f"with t as (select source, {audit} t from documents) select sha256(t) digest, count(*) n_documents, count(distinct source) n_sources from t where t <> '' group by t having count(*) > 1",
        "chrono_split": timed + f" select repo, eid, {phase} phase from t",
        "date_quartile": timed + " select repo, eid, (floor((n - 1) * 4 / total::double) + 1)::bigint quartile from t",
        "repository_manifest": f"with r as (select repository_id, {canonical_sql('event_id')} eid, epoch_ms(event_timestamp) ts from ledger_events) select repository_id, count(distinct eid) events, min(ts) first_ms, max(ts) last_ms, count(eid) - count(distinct eid) repeats from r group by 1",
        "task_manifest": timed + f" select case when {phase} = 'warmup' then 'development' when history = 0 then 'no prior memory' when history <= 3 then '1-3' when history <= 10 then '4-10' else '11+' end state, count(*) n from t where kind = 'claim' group by 1",
        "file_history": """with j as (select row_id, case when json_valid(data_json) then data_json end j from ledger_events where kind = 'artifact'), w as (select row_id, case json_type(j, '$.projectStructure.files') when 'VARCHAR' then json_extract(j ->> '$.projectStructure.files', '$') when 'OBJECT' then json_array(json_extract(j, '$.projectStructure.files')) else json_extract(j, '$.projectStructure.files') end w from j),
 f as (select distinct row_id, unnest(json_extract_string(w, '$[*].path')) path from w) select row_id, path, lag(row_id) over (partition by path order by row_id) previous from f where path is not null""",
        "stream_sequence": f"""with c as (select {canonical_sql('session_id')} || '|' || replace(lower({_trim('hook_event_name')}), '_', '') producer, try_cast(regexp_extract({canonical_sql('tool_use_id')}, '^call_([0-9]{{1,15}})$', 1) as bigint) number from claude_hooks)
 select producer, number, case when number <= coalesce(lag(number) over w, 0) then 'replay' when number = coalesce(lag(number) over w, 0) + 1 then 'next' else 'gap' end status from c where producer is not null and number is not null window w as (partition by producer order by number)""",
        "stream_dedup": f"select distinct {canonical_sql('event_id')} eid, {canonical_sql('event_hash')} hash from ledger_events where {canonical_sql('event_id')} is not null",
    }
