"""The text operators against brute force, round trips and dirty fixtures."""

import datetime as dt
import itertools
import math
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sedimark.llm import components, conversations, packing, pii, spans, tokens

DOCS = "doc_id long, text string, digest string, place int, n_tokens string"


def docs(spark, texts, first=0):
    return spark.createDataFrame([(i, t, "clash", 1, "x") for i, t in enumerate(texts, first)], DOCS)


# --- connected components and conversations


def roots(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return {i: find(i) for i in range(n)}


@pytest.mark.parametrize("kind", ["random", "path", "star", "none"])
def test_components(spark, kind):
    random.seed(4)
    n = 60
    links = {"random": [(random.randrange(n), random.randrange(n)) for _ in range(40)], "path": [(i, i + 1) for i in range(n - 1)], "star": [(n - 1, i) for i in range(n - 1)], "none": []}[kind]
    dirty = [(None, 3), (5, None), (7, 7), (3, 9999), *links, *links]
    got = components.connected_components(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(dirty, "u long, v long"))
    assert {r.node: r.component for r in got.collect()} == roots(n, links)


T = lambda s: dt.datetime(2025, 1, 1, 0, 0, s)
HOOKS = "hook_id long, session_id string, hook_event_name string, prompt_id string, event_id string, prompt string, last_assistant_message string, msg_no string, conversation string"
EVENTS = "event_id string, event_timestamp timestamp, conversation string"
EDGES = "source_event_id string, edge_type string, target_id string"


def talk(spark, rows, times, edges=(), attach=True):
    h = spark.createDataFrame([(i, s, n, p, e, t if n.lower().startswith("u") else None, t if n.lower().startswith("s") else None, "clash", "clash") for i, s, n, p, e, t in rows], HOOKS)
    m = conversations.hook_messages(h, spark.createDataFrame([(e, t, "clash") for e, t in times], EVENTS))
    links = conversations.message_links(m, spark.createDataFrame(list(edges), EDGES), attach)
    return conversations.with_texts(conversations.whole_conversations(conversations.resolved(m, links)), h)


def test_sessions(spark):
    times = [(f"evt_{c}", T(i)) for i, c in enumerate("abcdefghijklmnop")] + [("EVT_A", T(0))]
    rows = [
        # whole, out of order, with a copy and other spellings
        (1, "S1 ", "Stop", "p1", "evt_b", "hi"), (2, "s1", "user_prompt_submit", "P1", " EVT_A", "hello"), (3, "s1", "UserPromptSubmit", "p1", "a", "hello"), (4, "s1", "UserPromptSubmit", "p2", "evt_c", "more"), (5, "s1", "stop", "p2", "evt_d", "yes"), (6, "s1", "SessionEnd", None, None, None),
        # no reply
        (10, "s2", "UserPromptSubmit", "p3", "evt_e", "x"),
        # blank text
        (11, "s3", "UserPromptSubmit", "p4", "evt_f", " \t　"), (12, "s3", "Stop", "p4", "evt_g", "x"),
        # no time
        (13, "s4", "UserPromptSubmit", "p5", "evt_zz", "x"), (14, "s4", "Stop", "p5", "evt_h", "x"),
        # answers another prompt
        (15, "s5", "UserPromptSubmit", "p6", "evt_i", "x"), (16, "s5", "Stop", "p7", "evt_j", "x"),
        # no prompt_id
        (17, "s6", "UserPromptSubmit", None, "evt_k", "x"), (18, "s6", "Stop", None, "evt_l", "x"),
        # reply before prompt
        (19, "s7", "Stop", "p8", "evt_m", "x"), (20, "s7", "UserPromptSubmit", "p8", "evt_n", "x"),
        (21, None, "Stop", "p9", "evt_o", "x"),
    ]
    got = {(r.session_id, r.msg_no, r.speaker, r.prompt_id, r.text) for r in talk(spark, rows, times).where("identified").collect()}
    assert got == {("s1", 1, "user", "p1", "hello"), ("s1", 2, "assistant", "p1", "hi"), ("s1", 3, "user", "p2", "more"), ("s1", 4, "assistant", "p2", "yes")}


def test_conversations_without_identifiers(spark):
    times = [(c, T(i)) for i, c in enumerate("abcdef")]
    rows = [(1, None, "UserPromptSubmit", "p", "a", "q"), (2, " ", "Stop", "p", "b", "r"), (3, None, "UserPromptSubmit", "o", "c", "q2"), (4, None, "Stop", "o", "d", "r2"), (5, None, "Stop", "z", "e", "alone")]
    got = {(r.conversation, r.msg_no, r.text) for r in talk(spark, rows, times, [("c", "derived_from", "b"), ("e", "supports", "a")]).collect()}
    assert got == {("component:1", 1, "q"), ("component:1", 2, "r"), ("component:1", 3, "q2"), ("component:1", 4, "r2")}


def test_a_reply_without_session_joins_the_session_it_answers(spark):
    rows = [(1, "s1", "UserPromptSubmit", "p", "a", "q"), (2, None, "Stop", "p", "b", "r"), (3, None, "UserPromptSubmit", "o", "c", "q2"), (4, None, "Stop", "o", "d", "r2")]
    times = [(c, T(i)) for i, c in enumerate("abcd")]
    got = {(r.conversation, r.session_id, r.identified, r.msg_no, r.text) for r in talk(spark, rows, times).collect()}
    assert got == {("s1", "s1", True, 1, "q"), ("s1", "s1", False, 2, "r"), ("component:3", None, False, 1, "q2"), ("component:3", None, False, 2, "r2")}
    # told to keep to the identifiers, the session lacks its reply
    assert {r.conversation for r in talk(spark, rows, times, attach=False).collect()} == {"component:3"}
    # quoting two sessions, it belongs to neither
    two = [*rows, (5, "s2", "UserPromptSubmit", "z", "e", "q3"), (6, "s2", "Stop", "z", "f", "r3")]
    got = {r.conversation for r in talk(spark, two, [(c, T(i)) for i, c in enumerate("abcdef")], [("b", "references", "e")]).collect()}
    assert got == {"s2", "component:3"}


def test_copies_without_session_are_one_message(spark):
    rows = [(1, None, "UserPromptSubmit", "p", "a", "q"), (2, "", "user_prompt_submit", "P ", "a", "q"), (3, None, "Stop", "p", "b", "r")]
    assert {(r.conversation, r.msg_no, r.text) for r in talk(spark, rows, [("a", T(1)), ("b", T(2))]).collect()} == {("component:1", 1, "q"), ("component:1", 2, "r")}


def test_the_time_is_that_of_a_copy_whose_event_is_there(spark):
    rows = [(1, "s", "UserPromptSubmit", "p", "aa-lost", "q"), (2, "s", "UserPromptSubmit", "p", "b", "q"), (3, "s", "Stop", "p", None, "r"), (4, "s", "Stop", "p", "c", "r")]
    assert [(r.msg_no, r.text) for r in talk(spark, rows, [("b", T(1)), ("c", T(2)), ("c", None)]).orderBy("msg_no").collect()] == [(1, "q"), (2, "r")]


def test_an_event_of_very_many_messages_links_them_without_pairs(spark):
    rows = [(i, None, "Stop", f"p{i}", "hot", "r") for i in range(1, 200)]
    m = conversations.hook_messages(spark.createDataFrame([(i, s, n, p, e, None, t, "", "") for i, s, n, p, e, t in rows], HOOKS), spark.createDataFrame([("hot", T(1), "")], EVENTS))
    assert conversations.message_links(m, spark.createDataFrame([("hot", "references", "hot")] * 50, EDGES)).count() == 198


def test_no_conversations(spark):
    assert talk(spark, [], []).count() == 0


# --- personal items

MEMBERS = [("Skeirune", "Geirbrask"), ("Dreineth", "Zhentarn"), ("Flourilla", "Troungarth"), ("Vaetovi", "Kalovar"), ("Rivik", "Dorgarth"), ("Tamira", "Neintarn"), ("Houdra", "Vormord"), ("Kouska", "Sonstead"), ("Mophel", "Brasbrask"), ("Basira", "Naewick")]


@pytest.fixture(scope="module")
def field():
    random.seed(9)
    plain = ["the cache keeps its policy when the lock was held", "next step is to read the report before the freeze", "nobody owned the budget so the queue stayed warm", "measured ten rows per gateway against the ledger"]
    texts = []
    for i in range(600):
        g, f = random.choice(MEMBERS)
        g2, f2 = random.choice(MEMBERS)
        texts.append(random.choice([f"Ask {g} {f} before merging. {random.choice(plain)}", f"cc {g} {g2} {f}, {g[0]}. {f2} and team@mail.example. Each {random.choice(plain)}", f"Reported by {f}, {g} <{g.lower()}.{f.lower()}@corp.test>, {random.choice(plain)}", f"Nobody {random.choice(plain)}. We {random.choice(plain)}. Ask {g[0]}. {g2[0]}. {f} again", f"Remote is git@code.test:a/b.git. Version {i}.2 of the cache. Job ci-926-15-{1000 + i}-retry was cancelled."]))
    lexicon = pii.lexicon_of(texts, MEMBERS)
    return pii.fit(texts, MEMBERS, lexicon), lexicon


def found(text, field, **how):
    clear, at = pii.readable(text)
    return [(k, text[s if at is None else at[s] : (e if at is None else at[e - 1] + 1)]) for k, s, e in pii.items(clear, *field, **how)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("Ask Skeirune Geirbrask before merging.", [("person_name", "Skeirune Geirbrask")]),
        ("Ask Zhozan Kalovar before merging.", [("person_name", "Zhozan Kalovar")]),
        ("cc K. M. Dorgarth, Vormord, Houdra and VAETOVI SONSTEAD", [("person_name", "K. M. Dorgarth"), ("person_name", "Vormord, Houdra"), ("person_name", "VAETOVI SONSTEAD")]),
        ("Ask Skeirune before merging the cache.", []),
        ("Reach us at a.b+c@mail.example or d_e [at] lab-7 (dot) test, see adapter@1.2.19 and git@code.test:x/y.git", [("email", "a.b+c@mail.example"), ("email", "d_e [at] lab-7 (dot) test")]),
        ("tel=+49 (0)30 23125-959;ref (312) 555-0151 or 01.99.00.21.93, clock 1762506384217, 2021-11-20, 10.1.201.196:3468", [("phone", "+49 (0)30 23125-959"), ("phone", "(312) 555-0151"), ("phone", "01.99.00.21.93")]),
        ("holds SSN 906485700, 912-24-4534, QQ 61 45 70 C, passport no. XZ9478410, ID card X76 3227 3316; Job nightly-922-27-3593-retry, Offset 993154699, Blob XZ-E76937F93A", [("id_number", "906485700"), ("id_number", "912-24-4534"), ("id_number", "QQ 61 45 70 C"), ("id_number", "XZ9478410"), ("id_number", "X76 3227 3316")]),
        ("Moved from Flat 4, 133 Copperkettle Street, Quenby Hill 00259 to Lindenhofstraße 49, 00868 Neu Ostried", [("address", "Flat 4, 133 Copperkettle Street, Quenby Hill 00259"), ("address", "Lindenhofstraße 49, 00868 Neu Ostried")]),
        ("to 29 bis, rue des Vieux Ponts or Calle del Olmo 229, 6º A", [("address", "29 bis, rue des Vieux Ponts"), ("address", "Calle del Olmo 229, 6º A")]),
        ('{"note": "x\\nmail dreineth@corp.test\\u0020now"}', [("email", "dreineth@corp.test")]),
        ("", []), (" \n", []), ("x" * 200_000, []),
    ],
)
def test_items(field, text, want):
    assert found(text, field) == want


def test_chain_marginals_and_best_path_agree_with_enumeration():
    random.seed(8)
    step = {(pii.G1, 0, pii.G1): -0.5, (pii.G1, 0, pii.F2): 0.7, (pii.F1, 1, pii.G2): 0.4, (pii.G2, 0, pii.G2): -0.2}
    for _ in range(20):
        n = random.randrange(1, 5)
        local = [[random.gauss(0, 1) for _ in range(5)] for _ in range(n)]
        gaps = [random.choice([0, 1]) for _ in range(n - 1)]
        scored = {}
        for ys in itertools.product(range(5), repeat=n):
            if ys[0] not in (0, 1, 3) or ys[-1] not in (0, 2, 4):
                continue
            s = sum(local[i][y] for i, y in enumerate(ys))
            for a, g, b in zip(ys, gaps, ys[1:]):
                if (a, g, b) in step:
                    s += step[a, g, b]
                elif not (a in (0, 2, 4) and b in (0, 1, 3)):
                    break
            else:
                scored[ys] = s
        assert tuple(pii._chain(local, gaps, step, True)) == max(scored, key=scored.get)
        z = sum(map(math.exp, scored.values()))
        m = pii._chain(local, gaps, step, False)
        for i in range(n):
            for y in range(5):
                want = sum(math.exp(s) for ys, s in scored.items() if ys[i] == y) / z
                assert math.exp(m[i][y]) == pytest.approx(want, abs=1e-6)


def test_skip_edges_carry_a_name_across_the_text():
    # Qopp is unknown; beside a given name it is plainly a family name, beside an unknown word it isn't
    field = pii.Field()
    field.unary = {"word": {"bias": [0.0, -0.9, -0.9]}}
    field.step = {(pii.G1, 0, pii.F2): 1.0}
    field.same, field.similar = 3.0, 3.0
    words = lambda text: [n for n in pii.nodes_of(text) if n.kind == "word" and n.word not in ("Then",)]
    lexicon = {"skeirune": pii._GIVEN}
    for text, last in (("Skeirune Qopp wrote. Then Xyl Qopp answered.", "Xyl Qopp"), ("Skeirune Qopp wrote. Then Xyl Qopp-Wann answered.", "Xyl Qopp-Wann")):
        out = lambda skip: {text[a:e] for _, a, e in pii._names(text, words(text), {}, field, lexicon, skip)}
        assert out(False) == {"Skeirune Qopp"} and out(True) == {"Skeirune Qopp", last}
    # a mail address that is surely one makes the words of its local part names
    text = "Xyl Qopp answered"
    assert pii._names(text, words(text), {}, field, {}) == [] and len(pii._names(text, words(text), {"qopp": 9.0, "xyl": 9.0}, field, {})) == 1


def test_an_identity_number_said_once_is_found_bare():
    random.seed(3)
    number = lambda: str(random.randrange(900_000_000, 999_999_999))
    texts = [random.choice([f"Row holds SSN {number()} in clear.", f"Offset {number()} in the log.", f"His passport no. XZ{number()[:7]} lapsed.", f"Job ci-{number()[:3]}-15-{number()[:4]}-retry ran."]) for _ in range(400)]
    field = pii.fit(texts, MEMBERS), pii.lexicon_of(texts, MEMBERS)
    text = "It holds SSN 906485700 in clear. Offset 993154699 in the log. Later came 906485700 again"
    assert found(text, field) == [("id_number", "906485700")] * 2
    assert found(text, field, skip=False) == [("id_number", "906485700")]


def test_everyday_words_can_be_names(field):
    # words that the corpus has in lower case and often are candidates like all others
    f, lexicon = field
    common = lexicon | {"lock": pii.lexicon_code(500, 40, 20, 1000), "vormord": pii._FAMILY | pii.lexicon_code(0, 900, 850, 1000)}
    assert [w.word for w in pii.nodes_of("Ask Houdra Lock")] == ["Ask", "Houdra", "Lock"]
    assert found("Ask Houdra Vormord before the lock was held.", (f, common)) == [("person_name", "Houdra Vormord")]


def test_dense_long_texts_take_linear_time(field):
    import time

    one = "Ask Skeirune Geirbrask <skeirune.geirbrask@corp.test>, tel +1 415 555 0164, SSN 912-24-4534 at 133 Copperkettle Street. "
    took = []
    for n in (500, 2000):
        began = time.time()
        assert len(found(one * n, field)) == 5 * n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0]


@pytest.mark.parametrize("most", [0, pii.LEXICON])
def test_words_by_broadcast_and_by_join(spark, field, most):
    texts = ["Ask Skeirune Geirbrask now", "Moved Baker Street. the lock, Zhozan Kalovar wrote", "", "x@corp.test"]
    df = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "text_key binary, text string")
    lexicon = spark.createDataFrame(list(field[1].items()), "word string, code int")
    got = {bytes(r.text_key)[0]: [tuple(x) for x in zip(r.types, r.starts)] for r in pii.text_items(df, field[0], lexicon, most).collect()}
    assert got == {i: [(k, a) for k, a, _ in x] for i, t in enumerate(texts) if (x := pii.items(t, *field))}


def test_the_lexicon_counts_all_texts(spark):
    texts = ["Ask Skeirune Geirbrask. Baker came", "the baker, Baker", "Baker"] * 3 + ["Skeirune Baker"]
    df = spark.createDataFrame([(bytes([i]), t) for i, t in enumerate(texts)], "text_key binary, text string").repartition(3)
    members = spark.createDataFrame([("Skeirune", "Geirbrask"), (None, "Ünal"), ("Late", None)], "given_name string, family_name string")
    got = {r.word: r.code for r in pii.lexicon_table(df, members, [("Skeirune", "Geirbrask")], len(texts)).collect()}
    want = pii.lexicon_of(texts, [("Skeirune", "Geirbrask"), (None, "Ünal"), ("Late", None)])
    assert got == {w: c for w, c in want.items() if c} and got["unal"] & pii._FAMILY and got["late"] & pii._GIVEN and got["baker"] & 3


def test_found_and_redacted(spark, field, monkeypatch):
    monkeypatch.setattr(pii, "fit", lambda *a, **k: field[0])
    rows = [("ledger_events", 1, "body", "Ask Skeirune Geirbrask, \U0001f600 mail x@corp.test now"), ("claude_hooks", 2, "prompt", "\U0001f600 x@corp.test"), ("claude_hooks", 3, "prompt", "\U0001f600 x@corp.test"), ("claude_hooks", 4, "prompt", "nothing here"), ("claude_hooks", None, "prompt", None), ("claude_hooks", 6, "prompt", "")]
    df = spark.createDataFrame(rows, "source_table string, record_id long, field_name string, text string")
    members = spark.createDataFrame([(None, None), ("a", "b"), *MEMBERS], "given_name string, family_name string")
    got = {tuple(r) for r in pii.found_items(df, members).collect()}
    assert got == {("ledger_events", 1, "body", "person_name", 5), ("ledger_events", 1, "body", "email", 32), ("claude_hooks", 2, "prompt", "email", 3), ("claude_hooks", 3, "prompt", "email", 3)}
    out = {r.record_id: r.text for r in pii.redacted(df, members).collect()}
    assert out == {1: "Ask [PERSON_NAME], \U0001f600 mail [EMAIL] now", 2: "\U0001f600 [EMAIL]", 3: "\U0001f600 [EMAIL]", 4: "nothing here", None: None, 6: ""}


def test_no_texts(spark):
    df = spark.createDataFrame([], "source_table string, record_id long, field_name string, text string")
    assert pii.found_items(df, spark.createDataFrame([], "given_name string, family_name string")).count() == 0


# --- tokens and containers


def reference_encoder():
    import tiktoken

    ranks = {b: i for i, b in tokens.token_bytes(tokens.vocabulary_bytes(tokens.vocabulary_path())).items()}
    return tiktoken.Encoding("whole", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


TEXTS = ["", None, " ", "a", "a  b\n\n c", "<|endoftext|>", "naïve 東京 \U0001f469‍\U0001f4bb", "don't we'll 1234", "x" * 5000, "word " * 3000, "\u0000​", "tab\t\tend  "]


def test_encoding_is_that_of_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    random.seed(1)
    texts = TEXTS + ["".join(random.choice("ab 1\n.é東") for _ in range(random.randrange(60))) for _ in range(100)] + TEXTS[:4]
    encode = reference_encoder()
    df = docs(spark, texts).repartition(3)
    got = {r.doc_id: r.ids for r in tokens.encode_corpus(df).collect()}
    assert got == {i: encode(t or "") for i, t in enumerate(texts)}
    sizes = {r.doc_id: r.n_tokens for r in tokens.encode_corpus(df, lengths_only=True).collect()}
    assert sizes == {i: len(x) for i, x in got.items()}
    back = {r.doc_id: r.text for r in tokens.decode_corpus(tokens.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_encoding_of_nothing_and_null_ids(spark):
    assert tokens.encode_corpus(docs(spark, [])).count() == 0
    df = spark.createDataFrame([(None, "a b"), (3, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, len(r.ids)) for r in tokens.encode_corpus(df).collect()), key=str) == [(3, 0), (None, 2)]


@pytest.mark.parametrize("fan_in", [2, 64])
def test_containers(spark, fan_in):
    random.seed(6)
    sizes = [random.choice([None, 0, 1, 5, random.randrange(1, 400), 100, 1000]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(sizes)), "doc_id long, n_tokens long").withColumn("window", F.lit("clash")).repartition(7)
    rows = packing.fill_containers(df, capacity=100, windows=4, fan_in=fan_in).collect()
    by, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.container_id].append(r)
        pieces[r.doc_id].append((r.piece_no, r.n_tokens))
    for c in by.values():
        assert sum(r.n_tokens for r in c) <= 100 and sorted(r.place for r in c) == list(range(1, len(c) + 1))
    for i, n in enumerate(sizes):
        p = sorted(pieces.get(i, []))
        assert sum(x for _, x in p) == (n or 0) and [k for k, _ in p] == list(range(1, len(p) + 1)) and all(x == 100 for _, x in p[:-1]) and (len(p) == -(-(n or 0) // 100))
    used = sum(n or 0 for n in sizes)
    assert used / (100 * len(by)) > 0.9
    again = packing.fill_containers(df, capacity=100, windows=4, fan_in=fan_in).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_little_space_is_left_on_real_sizes(spark):
    import os

    docs_ = spark.read.parquet(os.environ.get("HELDOUT_SF_DIR", "/root/testdata/sf0.01") + "/documents.parquet")
    filled = packing.fill_containers(tokens.encode_corpus(docs_, lengths_only=True))
    r = packing.space(filled).first()
    print("containers", r.containers, "of at least", r.lower_bound, "unused", r.unused)
    assert r.lower_bound <= r.containers <= r.lower_bound * 1.02 + 1 and r.unused < 0.02
    assert packing.space(filled.limit(0)).first().unused == 0.0


def test_no_items(spark):
    assert packing.fill_containers(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


# --- shared spans


def brute_pairs(texts, least):
    at = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t or "") - least + 1):
            at[t[a : a + least]].add(i)
    return {(a, b) for v in at.values() if len(v) > 1 for a in v for b in v if a < b}


def brute_shared(texts, least):
    at = defaultdict(set)
    for i, t in enumerate(texts):
        for a in range(len(t or "") - least + 1):
            at[t[a : a + least]].add(i)
    out = {}
    for i, t in enumerate(texts):
        hit = np.zeros(len(t or ""), bool)
        for a in range(len(t or "") - least + 1):
            if len(at[t[a : a + least]]) > 1:
                hit[a : a + least] = True
        out[i] = int(hit.sum())
    return out


def some_texts(seed):
    random.seed(seed)
    rnd = lambda n, s="abcd ": "".join(random.choice(s) for _ in range(n))
    passages = [rnd(n) for n in (29, 30, 31, 60, 90)] + ["a" * 80, "ab" * 40, "\U0001f600東" * 20]
    texts = [rnd(random.randrange(5, 80)) + random.choice(passages) + rnd(random.randrange(40)) for _ in range(50)]
    for p in passages:
        texts.append(rnd(10) + p[: len(p) // 2] + "#" + p[len(p) // 2 :])
    return texts + ["", None, texts[0], texts[0], "a" * 30, "a" * 29, "b" * 500, rnd(20) + "b" * 40, rnd(3000) + passages[3] + rnd(3000)]


@pytest.mark.parametrize("seed,chunk", [(1, spans.CHUNK), (2, 128), (3, spans.CHUNK)])
def test_shared_spans_against_all_windows(spark, seed, chunk, monkeypatch):
    monkeypatch.setattr(spans, "CHUNK", chunk)
    texts = some_texts(seed)
    df = docs(spark, texts).repartition(3)
    got = [tuple(r) for r in spans.document_pairs(df, 30).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(texts, 30)
    share = {r.doc_id: r for r in spans.shared_share(df, 30).collect()}
    assert {i: share[i].shared_chars for i in share} == brute_shared(texts, 30)
    pairs = {p for a, b in got if texts[a] != texts[b] for p in ((a, b), (b, a))}
    assert all(r.partner_id is None or (i, r.partner_id) in pairs for i, r in share.items())


def test_shards_are_bounded_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(spans, "SHARD", 64)
    monkeypatch.setattr(spans, "SHARE", 3)
    texts = some_texts(5)
    df = docs(spark, texts).repartition(3)
    assert {tuple(r) for r in spans.document_pairs(df, 30).collect()} == brute_pairs(texts, 30)
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, 30).collect()} == brute_shared(texts, 30)


@pytest.mark.parametrize("seed", range(3))
def test_text_that_repeats_itself_in_other_places(spark, seed):
    random.seed(seed)
    rnd = lambda n: "".join(random.choice("xyz") for _ in range(n))
    unit = ["a", "ab", "abcd", "abcdefg", "abcdefghijklm"]
    texts = []
    for _ in range(60):
        u = random.choice(unit)
        run = u * random.randrange(2, 200 // len(u))
        texts.append(rnd(random.randrange(12)) + run[random.randrange(len(u)) :] + random.choice(["#", rnd(9), u[:1] + "#"]) + run[: random.randrange(len(run))] + rnd(random.randrange(9)))
    df = docs(spark, texts).repartition(2)
    assert {tuple(r) for r in spans.document_pairs(df, 30).collect()} == brute_pairs(texts, 30)
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, 30).collect()} == brute_shared(texts, 30)


def test_partners_over_batches():
    rows = [(1, 5), (1, 7), (1, 9), (2, 4), (3, 1), (3, 2), (3, 3), (3, 8), (4, 6), (5, 2), (5, 6)]
    want = {(5, 7), (5, 9), (9, 5), (1, 2), (1, 3), (1, 8), (8, 1), (2, 6), (6, 2)}
    for n in (1, 2, 3, 5, 11):
        batches = [pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows[i : i + n]]), pa.array([d for _, d in rows[i : i + n]])], names=["run", "doc_id"]) for i in range(0, len(rows), n)]
        assert {p for b in spans._partners(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))} == want


def test_one_header_in_very_many_texts_costs_one_stream_each(spark):
    random.seed(8)
    rnd = lambda n: "".join(random.choice("abcdefgh ") for _ in range(n))
    header = rnd(60)
    texts = [rnd(5) + header + rnd(40) for _ in range(300)]
    df = docs(spark, texts)
    classes, _, regions = spans._prepared(df, 30, False)
    runs = regions.select("doc_id", "parts").mapInArrow(spans._runs(30), "run long, doc_id long")
    pairs = runs.repartition("run").sortWithinPartitions("run", "doc_id").mapInArrow(spans._partners, "ref long, doc_id long").distinct()
    # some runs go on for a letter or two in a part of the texts, which has a partner of its own; all pairs would be 44,850
    assert pairs.count() <= 10 * 300
    assert {r.doc_id: r.shared_chars for r in spans.shared_share(df, 30).collect()} == brute_shared(texts, 30)


def test_no_documents(spark):
    assert spans.document_pairs(docs(spark, [])).count() == 0 and spans.shared_share(docs(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, "x" * 400), (None, "x" * 400), (1, "x" * 400)], "doc_id long, text string")
    assert spans.document_pairs(nulls).count() == 0


def test_automaton_knows_all_substrings():
    random.seed(12)
    for _ in range(30):
        text, other = ("".join(random.choice("ab") for _ in range(random.randrange(1, 40))) for _ in range(2))
        for least in (1, 3, 6):
            want = np.zeros(len(other), bool)
            for a in range(len(other) - least + 1):
                if other[a : a + least] in text:
                    want[a : a + least] = True
            got = np.zeros(len(other), bool)
            for a, e in spans.SuffixAutomaton(text).spans(other, least, False):
                got[a:e] = True
            assert (got == want).all()
