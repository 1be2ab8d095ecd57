"""Problem 2: personal items in free text, found by a skip-chain conditional random field.

A document's nodes are the places where an item can be: shapes of mail addresses, numbers and street addresses, and all
capitalised words. Neighbouring words form a chain whose labels follow the grammar of names (given names and initials
before a family name, or a family name, a comma and given names). Skip edges join equal and similar words of a text at
any distance, words and the mail addresses whose local part holds them, and equal mail addresses, numbers and street
addresses; their ends share a potential, so that what is plain in one place is found in another. Inference alternates
exact passes along the chains with messages over the skip edges.

Whether a word is an everyday one is a feature, from how many texts of the whole corpus have it in lower case, with a
capital, and beside a known name. Nothing is left out because of it. The field is fitted piecewise on a bounded sample:
names are labelled by the members' directory, words that stand alone are outside; the other types are fitted by
co-training, spelling and context each learning from what the other has decided, from a few plain signs on.
"""

from __future__ import annotations

import hashlib
import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.runtime import staged

#: Distinct texts that the field is fitted on, at most, and how many characters of each (a passage from anywhere in it).
SAMPLE, PASSAGE = 20_000, 2_000
#: Directory rows used as labels, at most; at inference all of the directory counts.
DIRECTORY = 50_000
#: Labelled rows of a kind that the weights are fitted on, at most.
ROWS = 40_000
#: Words of the lexicon that are broadcast, at most; with more of them each text gets its own words by a join.
LEXICON = 200_000
ROUNDS = 3
#: Least log odds of an item that equals another in its text.
WEAK = -2.0

# fixed values: street words, and words that introduce an identity number
_STREET = "street|st|avenue|ave|road|rd|lane|ln|court|ct|close|drive|dr|way|boulevard|blvd|place|pl|square|sq|terrace|crescent|gardens|mews|parade|walk|grove"
_FRENCH = "rue|avenue|boulevard|place|chemin|allée|impasse|quai|cours"
_SPANISH = r"calle|avenida|avda\.?|plaza|paseo|camino|ronda|travesía"
_NUMBER_WORDS = r"(?:ssn|social security|national insurance|nino|ni|passport|reisepass|pasaporte|passeport|id card|identity card|national id|ausweis|personalausweis|ausweisnr|dni)"
_PARTICLES = "van der|van den|van de|von der|von dem|de la|de los|de las|de|del|della|di|da|dos|von|van|el|al|bin|ibn|ter|ten|le|la"

_CAP = r"(?:\p{Lu}['’]|Mc|Mac)?\p{Lu}[\p{Ll}\p{M}]+(?:-\p{Lu}?[\p{Ll}\p{M}]+)*|\p{Lu}[\p{Lu}\p{M}]+(?:['’-][\p{Lu}\p{M}]+)*|\p{Lu}['’][\p{Lu}\p{M}]+"
_DASH = r"[ .\-\u2010\u2011\u2012\u2013\u00a0]"
_MAIL = re.compile(r"(?<![\w.+%\-])\w[\w.+%\-']*(?: ?@ ?| ?[\[({]at[\])}] ?)(\w[\w\-]*(?:(?:\.| ?[\[({]dot[\])}] ?)\w[\w\-]*)*(?:\.| ?[\[({]dot[\])}] ?)([A-Za-z]{2,}))(?![\w\-])", re.I)
_TOWN = r"(?:,?[ \n](?i:apt|flat|suite|unit|apartment)\.? ?\w{1,4}\b)?(?:, ?\d{1,2}[ºª°]\.? ?\w\b)?(?:,? ?\n?(?:\d{5} [A-ZÀ-Þ][\wÀ-ÿ]+(?: [A-ZÀ-Þ][\wÀ-ÿ]+)?|[A-ZÀ-Þ][\wÀ-ÿ]+(?: [A-ZÀ-Þ][\wÀ-ÿ]+)?,? \d{5}\b))?"
_ADDRESS = re.compile(
    r"(?<![\w./#@\-:+])(?:"
    rf"(?i:(?:(?:flat|apt\.?|unit|apartment) \w{{1,4}}, ?)?\d{{1,4}}[a-z]? (?:[nsew]\. )?((?:[a-zà-ÿ][a-zà-ÿ'’\-]+ ){{1,3}}?)({_STREET})\b\.?)"
    rf"|(?i:\d{{1,4}}(?: (?:bis|ter|quater))?,? (?:{_FRENCH}) (?:de la |de l['’]|des |du |de |d['’])?)[A-ZÀ-Þ][\wÀ-ÿ'\-]+(?: [A-ZÀ-Þ][\wÀ-ÿ\-]+)?"
    r"|(?i:[a-zà-ÿ\-]{2,}(?:stra(?:ß|ss)e|str\.|weg|allee|gasse|platz|ufer) \d{1,4}[a-z]?\b)"
    r"|(?:Am|An der|An den|Auf dem|Auf der|Im|In der|Zum|Zur|Unter den|Hinter dem) [A-ZÄÖÜ][\wäöüß]+(?: [A-ZÄÖÜ][\wäöüß]+)? \d{1,4}[a-z]?\b"
    rf"|(?i:(?:{_SPANISH}) (?:de la |de los |de las |del |de )?[a-zà-ÿñ]+(?: [a-zà-ÿñ]+){{0,2}},? \d{{1,4}}\b)"
    rf"){_TOWN}"
)
_PHONE = re.compile(
    r"(?<![\w.\-/:@#+(])(?:"
    rf"(?:(?:\+|00)?1{_DASH}?)?(?:\(\d{{3}}\){_DASH}?|\d{{3}}{_DASH})\d{{3}}{_DASH}\d{{4}}"
    r"|(?:\+|00)\d{1,3}[ .\-\u2011/]?(?:\(0?\d{0,4}\)[ .\-/]?)?\d(?:[ .\-\u2011/\u00a0]?\d){5,13}"
    r"|0\d{2,4}[/ \-]\d{3,4}[ \-]?\d{3,5}(?:-\d{1,4})?|0\d{2,4}/\d{4,9}(?:-\d{1,4})?"
    r"|0\d(?:[ .]\d\d){4}"
    r")(?![\w]|[.\-:]\d)"
)
_ID = re.compile(
    r"(?<![\w])(?:\d{3}[\- \u2011]\d{2}[\- \u2011]\d{4}|\d{9}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[A-Z]{1,2}\d{6,8}|[A-Z]\d{2} ?\d{4} ?\d{4}|\d{8}-?[A-Z])(?![\w])"
)
_LEAD = re.compile(rf"(?<!\w){_NUMBER_WORDS}(?:[ .\-]*(?:card|number|no|nr|num|n[ºo°]))?[\s.:=#\"'\\]*$", re.I)
_WORD = regex.compile(rf"(?<![\w@/\-+.'’]|\w\.)(?:\p{{Lu}}\.(?![\p{{Ll}}\d])|(?:(?i:{_PARTICLES})[ \u00a0\-])?(?:{_CAP})(?![\w@/(:\[]|[.\-@+]\w))|(?<=(?<!\w)\p{{Lu}}\.)(?:\p{{Lu}}\.(?![\p{{Ll}}\d])|(?:{_CAP})(?![\w@/(:\[]|[.\-@+]\w))")
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}

# labels of a name word
O, G1, F2, F1, G2 = range(5)
_GAPS = {" ": 0, "\u00a0": 0, "": 0, ", ": 1, ",": 1}
_LEGAL = {(G1, 0): (G1, F2), (F1, 1): (G2,), (G2, 0): (G2,)}
_NEVER = -1e9


def readable(text: str) -> tuple[str, list[int] | None]:
    """The text with JSON escapes undone, and the place in the stored text of each of its characters (None: as stored)."""
    at: list[int] | None = None
    for _ in range(4):
        if "\\" not in text:
            break
        out, places, last = [], [], 0
        for m in _ESCAPE.finditer(text):
            out.append(text[last : m.start()])
            places.extend(range(last, m.start()))
            code, plain = m.groups()
            out.append(chr(int(code, 16)) if code else _PLAIN.get(plain, plain))
            places.append(m.start())
            last = m.end()
        out.append(text[last:])
        places.extend(range(last, len(text)))
        text = "".join(out)
        at = places if at is None else [at[p] for p in places]
    return text, at


def plain(word: str) -> str:
    """Lower case without accents and marks, as words stand in mail addresses."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if c.isalnum())


class Node:
    """A place where an item can be. features are those of its spelling, around those of its context."""

    __slots__ = ("kind", "start", "end", "word", "features", "around", "local", "key")

    def __init__(self, kind: str, start: int, end: int, word: str, features: list[str], around: list[str], key: str = "", local: frozenset[str] = frozenset()) -> None:
        self.kind, self.start, self.end, self.word, self.features, self.around, self.key, self.local = kind, start, end, word, features, around, key, local


# what the lexicon says of a word: how much of it is in lower case (2 bits), how frequent (2), how much beside names (2), given name, family name
_GIVEN, _FAMILY = 64, 128


def lexicon_code(low: int, cap: int, beside: int, texts: int) -> int:
    """Classes of a word by the numbers of texts that have it in lower case, with a capital, and with a capital beside a known name."""
    share, often, near = low / max(1, low + cap), cap / max(1, texts), beside / max(1, cap)
    return (0 if low == 0 else 1 if share < 0.05 else 2 if share < 0.3 else 3) | (0 if often < 0.002 else 1 if often < 0.01 else 2) << 2 | (0 if near < 0.1 else 1 if near < 0.5 else 2) << 4


def _word_features(w: str) -> list[str]:
    p = plain(w)
    out = ["bias", "initial" if w[-1] == "." else "caps" if w.isupper() else "title", f"len{min(12, len(p))}"]
    if w[-1] != ".":
        out += [f"s{k}{p[-k:]}" for k in (2, 3, 4, 5) if len(p) >= k] + [f"p{k}{p[:k]}" for k in (1, 2, 3) if len(p) > k]
        if " " in w or "'" in w or "’" in w:
            out.append("particle")
    return out


def _lexical(code: int) -> list[str]:
    often = code >> 2 & 3
    return [f"low{code & 3}", f"often{often}" + (f"beside{code >> 4 & 3}" if often else "")]


_BEFORE, _AFTER = re.compile(r"([\w.]+|[^\w\s])\s*$"), re.compile(r"\s*(\w+|[^\w\s])")
_WORDS = re.compile(r"[^\W\d_]+")


def _around(text: str, a: int, e: int) -> list[str]:
    before, after = _BEFORE.search(text, max(0, a - 24), a), _AFTER.match(text, e)
    return ["<" + (before.group(1).lower() if before else "^"), ">" + (after.group(1).lower() if after else "$")]


def _class(c: str) -> str:
    return "" if not c else "w" if c.isalnum() else " " if c.isspace() else c


def _context(text: str, a: int, e: int) -> list[str]:
    """The words before and after a place."""
    before = _WORDS.findall(text, max(0, a - 40), a)[-3:]
    after = _WORDS.findall(text, e, e + 24)[:1]
    return ["bias", *{"c" + w.lower() for w in before}, *("n" + w.lower() for w in after)]


def _spelling(text: str, a: int, e: int, shape: str) -> list[str]:
    """The shape and the characters at both ends of a place."""
    return ["bias", shape, "l" + _class(text[a - 2 : a - 1] if a > 1 else "") + _class(text[a - 1 : a]), "r" + _class(text[e : e + 1]) + _class(text[e + 1 : e + 2])]


def _pattern(w: str) -> str:
    return re.sub(r"\d+|[^\W\d_]+", lambda m: ("d" if m.group()[0].isdigit() else "a") + str(len(m.group())), w.replace("\u2011", "-").replace("\u00a0", " "))


def _continued(features: list[str]) -> bool:
    """Whether a name in code goes on before or after a place: nightly-922-27-3593-retry."""
    return any(re.fullmatch(r"lw[\-/_.#@+]|r[\-_/@.]w", f) for f in features)


def nodes_of(text: str) -> list[Node]:
    """The nodes of a readable text in order."""
    out: list[Node] = []
    starts: list[int] = []
    ends: list[int] = []

    def free(a: int, e: int) -> bool:
        i = bisect_right(starts, a)
        return (i == 0 or ends[i - 1] <= a) and (i == len(starts) or starts[i] >= e)

    def take(a: int, e: int) -> None:
        i = bisect_right(starts, a)
        starts.insert(i, a)
        ends.insert(i, e)

    if "@" in text or "at" in text:
        for m in _MAIL.finditer(text):
            a, e = m.span()
            take(a, e)
            local = re.split(r" ?@| ?[\[({]at", m.group(), maxsplit=1)[0]
            parts = {plain(x) for x in re.split(r"[\W_\d]+", local)} | {plain(local)}
            form = "@" if "@" in m.group() else "at"
            out.append(Node("email", a, e, m.group(), _spelling(text, a, e, "tld" + m.group(2).lower()) + ["form" + form], _context(text, a, e), plain(m.group()), frozenset(parts | {x[1:] for x in parts})))
    if any(map(str.isdigit, text)):
        for m in _ADDRESS.finditer(text):
            a, e = m.span()
            if not free(a, e):
                continue
            street, middle = (m.group(2) or "").lower(), (m.group(1) or "").split()
            if text[e - 1] == "." and street not in ("st", "ave", "rd", "ln", "ct", "dr", "blvd", "pl", "sq"):
                e -= 1
            take(a, e)
            case = "".join(sorted({"A" if w[0].isupper() else "a" for w in [*middle, m.group(2) or "-"]}))
            town = re.search(r"\d{5}", text[a:e]) is not None
            out.append(Node("address", a, e, text[a:e], _spelling(text, a, e, "street" + street) + ["case" + case] + ["town"] * town, _context(text, a, e), plain(text[a:e])))
        for m in _PHONE.finditer(text):
            a, e = m.span()
            if 9 <= sum(map(str.isdigit, m.group())) <= 15 and free(a, e):
                take(a, e)
                out.append(Node("phone", a, e, m.group(), _spelling(text, a, e, _pattern(m.group())) + ["abroad"] * (m.group()[0] == "+" or m.group()[:2] == "00"), _context(text, a, e), plain(m.group())))
        for m in _ID.finditer(text):
            a, e = m.span()
            if not free(a, e):
                continue
            take(a, e)
            named = _LEAD.search(text, max(0, a - 48), a) is not None
            out.append(Node("id_number", a, e, m.group(), _spelling(text, a, e, _pattern(m.group())), _context(text, a, e) + ["named" if named else "bare"], plain(m.group())))
    for m in _WORD.finditer(text):
        a, e = m.span()
        if e - a > 1 and free(a, e):
            out.append(Node("word", a, e, m.group(), [], [], plain(m.group())))
    out.sort(key=lambda n: n.start)
    return out


class Field:
    """Fitted weights: unary by kind and feature; transitions by gap; skip edges by kind of edge. names are the known ones of the fit."""

    def __init__(self) -> None:
        self.unary: dict[str, dict[str, list[float]]] = {}
        self.context: dict[str, dict[str, list[float]]] = {}
        self.step: dict[tuple[int, int, int], float] = {}
        self.same = self.similar = self.mailed = 1.0
        # the same number or address in one text is the same thing
        self.equal = 6.0
        self._known: dict[str, list[float]] = {}

    def scores(self, n: Node, text: str, code: int) -> list[float]:
        """Log potentials of a word by class: outside, given, family."""
        table = self.unary["word"]
        own = self._known.get(n.word)
        if own is None:
            own = [0.0, 0.0, 0.0]
            for f in _word_features(n.word):
                w = table.get(f)
                if w:
                    own = [a + b for a, b in zip(own, w)]
            if len(self._known) > 100_000:
                self._known.clear()
            self._known[n.word] = own
        s = list(own)
        for f in (*_lexical(code), *_around(text, n.start, n.end)):
            w = table.get(f)
            if w:
                s[0] += w[0]
                s[1] += w[1]
                s[2] += w[2]
        if n.word[-1] == ".":
            s[2] = _NEVER
        if code & _GIVEN:
            s[1] += 2.0
        if code & _FAMILY:
            s[2] += 2.0
        return s

    def odds(self, n: Node) -> float:
        """Log odds that a mail address, number or street address is an item."""
        total = 0.0
        for table, features in ((self.unary[n.kind], n.features), (self.context[n.kind], n.around)):
            for f in features:
                w = table.get(f)
                if w:
                    total += w[1] - w[0]
        return total


def _softmax_fit(rows: list[tuple[list[str], int]], classes: int, rounds: int = 12, rate: float = 0.3, decay: float = 1e-4) -> dict[str, list[float]]:
    """Multinomial logistic weights by adaptive gradient steps in a fixed order."""
    w: dict[str, list[float]] = defaultdict(lambda: [0.0] * classes)
    g: dict[str, list[float]] = defaultdict(lambda: [1e-6] * classes)
    for _ in range(rounds):
        for features, label in rows:
            s = [sum(w[f][k] for f in features) for k in range(classes)]
            top = max(s)
            e = [math.exp(x - top) for x in s]
            z = sum(e)
            d = [e[k] / z - (k == label) for k in range(classes)]
            if abs(d[label]) < 0.01:
                continue
            for f in features:
                wf, gf = w[f], g[f]
                for k in range(classes):
                    x = d[k] + decay * wf[k]
                    gf[k] += x * x
                    wf[k] -= rate * x / math.sqrt(gf[k])
    return {f: [round(x, 4) for x in v] for f, v in w.items()}


def _weights(rows: list[tuple[list[str], int]], classes: int) -> dict[str, list[float]]:
    return _softmax_fit(sorted(rows, key=hash_order)[:ROWS], classes)


# numbers and words with a number that are no items; they show which contexts mean something else
_OTHER = re.compile(r"(?<![\w.\-])\d[\d.:]{3,}\d(?![\w\-])|(?<![\w.\-])\d{1,4} [a-zà-ÿ]{3,}(?: [a-zà-ÿ]{3,})?(?!\w)")
_SHAPES = {"id_number": ("d3-d2-d4", "d3 d2 d4", "a2 d2 d2 d2 a1", "a2d6a1", "a2d7", "a1d2 d4 d4", "d8a1"), "email": ("form@", "format"), "phone": ("abroad",), "address": ("town",)}


def co_trained(kind: str, nodes: list[Node], seeds: list[int | None], others: list[list[str]]) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Weights of spelling and of context. seeds are labels of some nodes by plain signs; others are contexts of what is none.

    Spelling learns from the seeds, context from the seeds and what spelling then decides, spelling once more from the
    seeds and what context decides. Nodes of which a side isn't sure are left out.
    """
    prior = [(["bias"], 1)] + [(["bias", s], 1) for s in _SHAPES[kind]] * 4
    # digits alone say nothing, but may be said to be one
    plain_digits = kind == "id_number"
    prior += [(["bias", "d9"], 0)] * 4 * plain_digits
    spelling: dict[str, list[float]] = {}
    context: dict[str, list[float]] = {}
    said = [(["bias"], 1)] * 2 + ([(["bias", "named"], 1)] * 5 + [(["bias", "bare"], 0)]) * 2 * plain_digits

    def sure(table: dict[str, list[float]], features: list[str]) -> int | None:
        s = sum(w[1] - w[0] for f in features if (w := table.get(f)))
        return 1 if s > 1 else 0 if s < -1 else None

    for turn in range(2):
        known = [y if y is not None or not turn else sure(context, n.around) for n, y in zip(nodes, seeds)]
        spelling = _weights(prior + [(n.features, y) for n, y in zip(nodes, known) if y is not None], 2)
        known = [y if y is not None else sure(spelling, n.features) for n, y in zip(nodes, seeds)]
        context = _weights(said + [(c, 0) for c in others] + [(n.around, y) for n, y in zip(nodes, known) if y is not None], 2)
    return spelling, context


def _seed(n: Node, names: set[str]) -> int | None:
    """The label of a node that plain signs give, or None."""
    if n.kind == "email":
        # a directory name in the local part, or a path after the host
        after = next(f for f in n.features if f[0] == "r" and f != "r")[1:] if any(f[0] == "r" and f != "r" for f in n.features) else ""
        return 0 if after[:1] in (":", "/") and after[1:] not in ("", " ") else 1 if any(len(x) > 3 and x in names for x in n.local) else None
    if n.kind == "id_number":
        # said to be one, part of a longer name, or digits without any word
        return 0 if _continued(n.features) else 1 if "named" in n.around else 0 if n.word.isdigit() else None
    return 1 if ("abroad" if n.kind == "phone" else "town") in n.features else None


def fit(texts: list[str], directory: list[tuple[str | None, str | None]], lexicon: dict[str, int] | None = None) -> Field:
    """The field fitted on sample texts and directory names. Without a lexicon that of the sample is taken."""
    field = Field()
    given, family = {plain(g) for g, _ in directory if g}, {plain(f) for _, f in directory if f}
    names = given | family
    read = [readable(t)[0] for t in texts]
    if lexicon is None:
        lexicon = lexicon_of(texts, directory)
    rows: list[tuple[list[str], int]] = []
    outside: list[tuple[list[str], int]] = []
    steps: Counter[tuple[int, int, int]] = Counter()
    agree, alike, mail, other = [0, 0], [0, 0], [0, 0], [0, 0]
    items_: dict[str, list[Node]] = defaultdict(list)
    others: dict[bool, list[list[str]]] = {True: [], False: []}
    for t in read:
        nodes = nodes_of(t)
        label: dict[int, int] = {}
        for n in nodes:
            if n.kind != "word":
                items_[n.kind].append(n)
        taken = [(n.start, n.end) for n in nodes if n.kind != "word"]
        for m in _OTHER.finditer(t):
            if not any(a < m.end() and m.start() < e for a, e in taken):
                others[" " not in m.group()].append(_context(t, *m.span()) + ["bare"])
        said = [_LEAD.search(t, max(0, n.start - 48), n.start).span() for n in nodes if n.kind == "id_number" and "named" in n.around]
        words = [n for n in nodes if n.kind == "word"]
        gaps = [_GAPS.get(t[a.end : b.start]) for a, b in zip(words, words[1:])]
        for a, b, gap in zip(words, words[1:], gaps):
            if gap == 0 and (a.key in given or a.word[-1] == ".") and b.key in family:
                label[a.start], label[b.start] = G1, F2
            elif gap == 1 and a.key in family and (b.key in given or b.word[-1] == ".") and a.start not in label:
                label[a.start], label[b.start] = F1, G2
        # given names and initials before a given name belong to the name
        for a, b, gap in reversed(list(zip(words, words[1:], gaps))):
            if a.start not in label and gap == 0 and label.get(b.start) == G1 and (a.word[-1] == "." or a.key in given):
                label[a.start] = G1
        for a, b, gap in zip(words, words[1:], gaps):
            if b.start not in label and gap == 0 and label.get(a.start) == G2 and b.word[-1] == ".":
                label[b.start] = G2
        for a, b, gap in zip(words, words[1:], gaps):
            if gap is not None and a.start in label and b.start in label:
                steps[label[a.start], gap, label[b.start]] += 1
        locals_ = frozenset().union(*(n.local for n in nodes if n.kind == "email"))
        by: dict[str, list[Node]] = defaultdict(list)
        chained = {n.start for a, b, gap in zip(words, words[1:], gaps) if gap is not None for n in (a, b)}
        for n in words:
            # a word alone has no label that could agree
            if n.word[-1] != "." and n.start in chained:
                by[n.key].append(n)
        for p, same in by.items():
            hit = [n.start in label for n in same]
            if len(same) > 1 and any(hit):
                agree[all(hit)] += 1
            for q in _variants(same[0]):
                if q != p and q in by and any(hit):
                    alike[any(n.start in label for n in by[q])] += 1
            if locals_ and len(p) > 3:
                (mail if any(hit) else other)[p in locals_] += 1
        for i, n in enumerate(words):
            y = label.get(n.start)
            code = lexicon.get(n.key, 0)
            if y is not None:
                rows.append((_word_features(n.word) + _lexical(code) + _around(t, n.start, n.end), 1 if y in (G1, G2) else 2))
            elif any(a <= n.start < e for a, e in said):
                # of the words that introduce a number
                outside.append((_word_features(n.word) + _lexical(code) + _around(t, n.start, n.end), 0))
            elif n.key not in names and n.word[-1] != "." and (i == 0 or gaps[i - 1] is None) and (i + 1 == len(words) or gaps[i] is None):
                # alone, so no name of a person in full
                outside.append((_word_features(n.word) + _lexical(code) + _around(t, n.start, n.end), 0))
            elif n.key not in names and n.word[-1] != "." and i + 1 < len(words) and gaps[i] == 0 and label.get(words[i + 1].start) == G1 and n.key in lexicon and lexicon[n.key] & 3 | lexicon[n.key] >> 2 & 3:
                # beside a name that is whole without it
                outside.append((_word_features(n.word) + _lexical(code) + _around(t, n.start, n.end), 0))
    # names as types, so that endings count beside places
    rows += [(_word_features(g.title()), 1) for g, _ in directory if g] + [(_word_features(f), 2) for _, f in directory if f]
    base = [(["bias"], k) for k in range(3)] * 2
    keep = ROWS - min(len(rows), ROWS // 2)
    field.unary["word"] = _softmax_fit(base + sorted(sorted(rows, key=hash_order)[: ROWS // 2] + sorted(outside, key=hash_order)[:keep], key=hash_order), 3)
    for kind in _SHAPES:
        nodes = items_[kind]
        # a quarter as many contexts of other numbers as there are candidates
        none = sorted(others[kind != "address"], key=lambda o: hash_order((o, 0)))[: min(len(nodes) // 4, ROWS // 4)] if kind != "email" else []
        field.unary[kind], field.context[kind] = co_trained(kind, nodes, [_seed(n, names) for n in nodes], none)
    total = Counter()
    for (x, gap, _), n in steps.items():
        total[x, gap] += n
    for (x, gap), ys in _LEGAL.items():
        for y in ys:
            field.step[x, gap, y] = 1.0 + math.log((steps[x, gap, y] + 1) / (total[x, gap] + len(ys)))
    # equal words agree unless the sample says otherwise
    bounded = lambda yes, no: min(3.0, max(0.5, math.log((yes + 4) / (no + 1))))
    field.same, field.similar = bounded(agree[1], agree[0]), bounded(alike[1], alike[0])
    field.mailed = min(3.0, max(0.5, math.log((mail[1] + 1) / (sum(mail) + 2) * (sum(other) + 2) / (other[1] + 1))))
    return field


def hash_order(row: tuple[list[str], int]) -> str:
    """A fixed order that mixes classes."""
    return hashlib.blake2b(("\x1f".join(row[0]) + str(row[1])).encode(), digest_size=8).hexdigest()


def _logsum(v: list[float]) -> float:
    top = max(v)
    return top + math.log(sum(math.exp(x - top) for x in v)) if top > _NEVER else _NEVER


def _chain(local: list[list[float]], gaps: list[int | None], step: dict[tuple[int, int, int], float], best: bool) -> list:
    """Log marginals of each word of a chain, or its best labels."""
    n = len(local)

    def trans(x: int, gap: int | None, y: int) -> float:
        if gap is not None and (x, gap, y) in step:
            return step[x, gap, y]
        # a name begins after a name that has ended, or outside
        return 0.0 if x in (O, F2, G2) and y in (O, G1, F1) else _NEVER

    gather = max if best else _logsum
    fwd = [[local[0][y] if y in (O, G1, F1) else _NEVER for y in range(5)]]
    back: list[list[int]] = []
    for i in range(1, n):
        row, from_ = [], []
        for y in range(5):
            v = [fwd[-1][x] + trans(x, gaps[i - 1], y) for x in range(5)]
            row.append(max(_NEVER, gather(v) + local[i][y]))
            from_.append(v.index(max(v)))
        fwd.append(row)
        back.append(from_)
    ends = [0.0 if y in (O, F2, G2) else _NEVER for y in range(5)]
    if best:
        last = [fwd[-1][y] + ends[y] for y in range(5)]
        y = last.index(max(last))
        out = [y]
        for from_ in reversed(back):
            y = from_[y]
            out.append(y)
        return out[::-1]
    bwd = [ends]
    for i in range(n - 2, -1, -1):
        bwd.append([_logsum([trans(x, gaps[i], y) + local[i + 1][y] + bwd[-1][y] for y in range(5)]) for x in range(5)])
    bwd.reverse()
    out = []
    for f, b in zip(fwd, bwd):
        v = [max(_NEVER, a + c) for a, c in zip(f, b)]
        z = _logsum(v)
        out.append([x - z for x in v])
    return out


def _agreeing(odds: list[float], weight: float) -> list[float]:
    """What each end of a skip edge of that weight says to the others, by its own odds."""
    return [math.log((1 + math.exp(o + weight)) / (math.exp(weight) + math.exp(o))) for o in (max(-20.0, min(20.0, o)) for o in odds)]


def _variants(n: Node) -> set[str]:
    """Spellings of a word that count as similar: without a final s, and the parts of a hyphenated one."""
    out = {n.key.removesuffix("s") if len(n.key) > 4 else n.key}
    if "-" in n.word:
        out |= {plain(x) for x in n.word.split("-") if len(x) > 3}
    return out | {n.key}


def items(text: str, field: Field, lexicon: dict[str, int], skip: bool = True, chain: bool = True) -> list[tuple[str, int, int]]:
    """(pii_type, start, end) of a readable text, in order. Without skip no message passes over skip edges, without chain neighbours don't count: for measuring."""
    nodes = nodes_of(text)
    shapes = [n for n in nodes if n.kind != "word"]
    words = [n for n in nodes if n.kind == "word"]
    odds = [field.odds(n) for n in shapes]
    equal: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, n in enumerate(shapes):
        # within a name in code the same digits are something else
        if n.kind != "id_number" or not _continued(n.features):
            equal[n.kind, n.key].append(i)
    total = list(odds)
    for at in equal.values():
        if len(at) > 1 and skip:
            # one clique of equal items; that nothing is said of one in its place is weak evidence against it
            own = [max(WEAK, odds[i]) for i in at]
            says = _agreeing(own, field.equal)
            whole = sum(says)
            for i, o, said in zip(at, own, says):
                total[i] = o + max(-6.0, min(6.0, whole - said))
    out = [(n.kind, n.start, n.end) for n, o in zip(shapes, total) if o > 0]
    if len(words) > 1:
        mails: dict[str, float] = {}
        for n, o in zip(shapes, total):
            if n.kind == "email":
                for x in n.local:
                    if len(x) > 3:
                        mails[x] = max(mails.get(x, -20.0), o)
        out += _names(text, words, mails if skip else {}, field, lexicon, skip, chain)
    out.sort(key=lambda x: x[1])
    return out


def _names(text: str, words: list[Node], mails: dict[str, float], field: Field, lexicon: dict[str, int], skip: bool = True, chained: bool = True) -> list[tuple[str, int, int]]:
    chains: list[list[int]] = [[0]]
    for i in range(1, len(words)):
        if text[words[i - 1].end : words[i].start] in _GAPS:
            chains[-1].append(i)
        else:
            chains.append([i])
    by: dict[str, list[int]] = defaultdict(list)
    near: dict[str, list[int]] = defaultdict(list)
    for i, n in enumerate(words):
        if n.word[-1] != ".":
            by[n.key].append(i)
            for v in _variants(n):
                near[v].append(i)
    # a word alone can't be a name; it stays a node if it has something to say over a skip edge
    linked = {i for at in near.values() if len(at) > 1 for i in at}
    chains = [c for c in chains if len(c) > 1 or skip and c[0] in linked]
    if not any(len(c) > 1 for c in chains):
        return []
    unary: dict[int, list[float]] = {}
    for c in chains:
        for i in c:
            o, g, f = field.scores(words[i], text, lexicon.get(words[i].key, 0))
            unary[i] = [o, g, f, f, g]
    gaps = [[_GAPS.get(text[words[a].end : words[b].start]) for a, b in zip(c, c[1:])] for c in chains]
    fixed: dict[int, float] = {}
    if skip:
        for x, o in mails.items():
            (says,) = _agreeing([o], field.mailed)
            for i in by.get(x, ()):
                fixed[i] = says
    skips = [(at, field.same) for at in by.values() if len(at) > 1]
    # similar words: groups that hold more than one spelling
    skips += [(at, field.similar) for at in near.values() if len({words[i].key for i in at}) > 1]
    skips = [([i for i in at if i in unary], w) for at, w in skips] if skip else []
    skips = [(at, w) for at, w in skips if len(at) > 1]
    came: dict[tuple[int, int], float] = {}
    message = dict(fixed)
    step = field.step if chained else {}
    local = lambda c: [[u + (message.get(i, 0.0) if y else 0.0) for y, u in enumerate(unary[i])] for i in c]
    for _ in range(ROUNDS if skips else 0):
        inside: dict[int, float] = {}
        for c, g in zip(chains, gaps):
            if len(c) > 1:
                marginal = _chain(local(c), g, step, False)
            else:
                (own,) = local(c)
                z = _logsum(own)
                marginal = [[x - z for x in own]]
            for i, m in zip(c, marginal):
                inside[i] = max(-20.0, min(20.0, _logsum(m[1:]) - m[0]))
        new = dict(fixed)
        for k, (at, weight) in enumerate(skips):
            # belief without what came over this edge; its ends agree with the edge's weight
            says = _agreeing([inside[i] - came.get((k, i), 0.0) for i in at], weight)
            total = sum(says)
            for i, own in zip(at, says):
                came[k, i] = max(-4.0, min(4.0, total - own))
                new[i] = new.get(i, 0.0) + came[k, i]
        message = new
    out = []
    for c, g in zip(chains, gaps):
        if len(c) < 2:
            continue
        labels = _chain(local(c), g, step, True)
        start = None
        for k, y in enumerate(labels):
            before = labels[k - 1] if k else O
            if y in (G1, F1) and not (y == G1 and before == G1):
                start = words[c[k]].start
            if start is not None and (y == F2 or y == G2 and (k + 1 == len(labels) or labels[k + 1] != G2)):
                out.append(("person_name", start, words[c[k]].end))
                start = None
    return out


_LOWER = re.compile(r"(?<![\w@.+\-])[a-zà-ÿ]{2,}(?![\w@+]|[.\-_]\w|[ ]?[@\[(])|(?<![\w@.+])(?:[a-z]{3,}(?=/)|(?<=/)[a-z]{3,})(?!\w)")
_UPPER = regex.compile(r"(?<![\w@.+/\-])\p{Lu}\p{Ll}+(?![\w@/\-])")


def counted_words(texts: list[str], given: set[str], family: set[str]) -> dict[str, list[int]]:
    """Of each word the numbers of texts that have it in lower case, with a capital, and with a capital beside a known name."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0, 0])
    key: dict[str, str] = {}

    def of(w: str) -> str:
        k = key.get(w)
        if k is None:
            k = key[w] = plain(w)
        return k

    for text in texts:
        t, _ = readable(text)
        for w in {of(w) for w in _LOWER.findall(t)}:
            counts[w][0] += 1
        words = [(m.start(), m.end(), of(m.group())) for m in _UPPER.finditer(t)]
        near: set[str] = set()
        for (a, b, x), (c, _, y) in zip(words, words[1:]):
            if t[b:c] in _GAPS:
                if x in given:
                    near.add(y)
                if y in family and a and t[a - 1] not in "\n\"" and t[max(0, a - 2) : a] not in (". ", "? ", "! "):
                    near.add(x)
        for w in {w for _, _, w in words}:
            counts[w][1] += 1
        for w in near:
            counts[w][2] += 1
    return counts


def lexicon_of(texts: list[str], directory: list[tuple[str | None, str | None]]) -> dict[str, int]:
    """The lexicon of texts that are here, as `lexicon` makes it of all."""
    given, family = {plain(g) for g, _ in directory if g}, {plain(f) for _, f in directory if f}
    out = {w: code for w, (a, b, c) in counted_words(texts, given, family).items() if b and (code := lexicon_code(a, b, c, len(texts)))}
    for names, flag in ((given, _GIVEN), (family, _FAMILY)):
        for n in names:
            out[n] = out.get(n, 0) | flag
    return out


def free_texts(ledger: DataFrame, hooks: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, text) of the fields of problem 2, without nulls and texts that are too short to hold an item."""
    one = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("text")) for n in ("prompt", "tool_response")])).alias("f")
    a = ledger.select(F.lit("ledger_events").alias("source_table"), F.col("row_id").alias("record_id"), F.lit("body").alias("field_name"), F.col("body").alias("text"))
    b = hooks.select(F.lit("claude_hooks").alias("source_table"), F.col("hook_id").alias("record_id"), one).select("source_table", "record_id", "f.field_name", "f.text")
    return a.union(b).where(F.length("text") > 4)


def sampled(texts: DataFrame, members: DataFrame, sample: int = SAMPLE, directory: int = DIRECTORY) -> tuple[list[str], list[tuple[str | None, str | None]], int]:
    """A passage each of at most `sample` of texts(text_key, text), at most `directory` members, both by smallest hash, and the number of texts."""
    n = texts.count()
    share = F.pmod(F.xxhash64("text_key"), F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * 1.5 * sample / max(1, n)) + 1)
    begin = 1 + F.pmod(F.xxhash64("text_key", F.lit(1)), F.greatest(F.lit(1), F.length("text") - PASSAGE + 1)).cast("int")
    rows = texts.where(share).select(F.xxhash64("text_key").alias("h"), F.substring(F.col("text"), begin, F.lit(PASSAGE)).alias("t")).orderBy("h", "t").limit(sample).collect()
    names = members.select("given_name", "family_name").distinct().orderBy(F.xxhash64("given_name", "family_name"), "given_name", "family_name").limit(directory).collect()
    return [r.t for r in rows], [tuple(r) for r in names], n


def lexicon_table(texts: DataFrame, members: DataFrame, known: list[tuple[str | None, str | None]], n_texts: int) -> DataFrame:
    """(word, code) of all words of texts(text_key, text) that stand with a capital somewhere and of which there is something to say, and of all names of members. Stages."""
    given, family = {plain(g) for g, _ in known if g}, {plain(f) for _, f in known if f}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = counted_words(b.column("text").to_pylist(), given, family)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), *(pa.array([v[i] for v in c.values()], pa.int64()) for i in range(3))], names=["word", "low", "cap", "beside"])

    counts = texts.select("text").mapInArrow(count, "word string, low long, cap long, beside long").groupBy("word").agg(*[F.sum(x).alias(x) for x in ("low", "cap", "beside")]).where("cap > 0")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code = [lexicon_code(*v, n_texts) for v in zip(*(b.column(x).to_pylist() for x in ("low", "cap", "beside")))]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(code, pa.int32())], names=["word", "code"])

    def spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = {(plain(x), flag) for c, flag in (("given_name", _GIVEN), ("family_name", _FAMILY)) for x in b.column(c).to_pylist() if x}
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in pairs], pa.string()), pa.array([f for _, f in pairs], pa.int32())], names=["word", "code"])

    both = counts.mapInArrow(encode, "word string, code int").where("code <> 0").union(members.select("given_name", "family_name").mapInArrow(spelled, "word string, code int"))
    return staged(both.groupBy("word").agg(F.bit_or("code").alias("code")), "lexicon")


def _words_of(texts: DataFrame) -> DataFrame:
    """(text_key, word) of the distinct capitalised words of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, words = [], []
            for key, text in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist()):
                own = {plain(m.group()) for m in _WORD.finditer(readable(text)[0])}
                keys += [key] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(words, pa.string())], names=["text_key", "word"])

    return texts.select("text_key", "text").mapInArrow(run, "text_key binary, word string")


def text_items(texts: DataFrame, field: Field, lexicon: DataFrame, most: int = LEXICON) -> DataFrame:
    """(text_key, starts, ends, types) of texts(text_key, text) that have items; places in code points of the stored text, from 0.

    A lexicon of at most `most` words goes to all tasks; of a larger one each text gets its own words by a join.
    """
    spark = texts.sparkSession
    shared = spark.sparkContext.broadcast(field)
    small = lexicon.limit(most + 1).count() <= most
    words = spark.sparkContext.broadcast({r.word: r.code for r in lexicon.collect()} if small else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, every = shared.value, words.value
        for b in batches:
            keys, starts, ends, types = [], [], [], []
            own = [None] * b.num_rows if small else b.column("words").to_pylist()
            for key, text, mine in zip(b.column("text_key").to_pylist(), b.column("text").to_pylist(), own):
                clear, at = readable(text)
                found = items(clear, f, every if small else {x["word"]: x["code"] for x in mine or ()})
                if found:
                    keys.append(key)
                    starts.append([s if at is None else at[s] for _, s, _ in found])
                    ends.append([e if at is None else at[e - 1] + 1 for _, _, e in found])
                    types.append([t for t, _, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(types, pa.list_(pa.string()))], names=["text_key", "starts", "ends", "types"])

    if small:
        rows = texts.select("text_key", "text")
    else:
        of_text = _words_of(texts).join(lexicon, "word").groupBy("text_key").agg(F.collect_list(F.struct("word", "code")).alias("words"))
        rows = texts.select("text_key", "text").join(of_text, "text_key", "left")
    return rows.mapInArrow(run, "text_key binary, starts array<int>, ends array<int>, types array<string>")


def _keyed(fields: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    keyed = fields.withColumn("text_key", F.unhex(F.md5("text")))
    # written once: sampling, counting and reading all go over the distinct texts
    distinct = staged(keyed.where("text is not null").groupBy("text_key").agg(F.first("text").alias("text")), "texts")
    texts, names, n = sampled(distinct, members)
    lexicon = lexicon_table(distinct, members, names, n)
    # what the fit needs of it are the words of the sample
    seen = {plain(m.group()) for t in texts for m in _WORD.finditer(readable(t)[0])}
    of_sample = distinct.sparkSession.createDataFrame([(w,) for w in sorted(seen)], "word string").join(lexicon, "word").collect()
    return keyed, text_items(distinct, fit(texts, names, {r.word: r.code for r in of_sample}), lexicon)


def found_items(fields: DataFrame, members: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, pii_type, char_start), char_start from 1; each distinct text is read once."""
    keyed, found = _keyed(fields, members)
    one = keyed.drop("text").join(found, "text_key").select("source_table", "record_id", "field_name", F.explode(F.arrays_zip("types", "starts")).alias("i"))
    return one.select("source_table", "record_id", "field_name", F.col("i.types").alias("pii_type"), (F.col("i.starts") + 1).cast("long").alias("char_start"))


def redacted(fields: DataFrame, members: DataFrame) -> DataFrame:
    """(source_table, record_id, field_name, text) with a typed placeholder, as [EMAIL], for each item and all else unchanged."""
    keyed, found = _keyed(fields, members)
    pieces = F.arrays_zip("types", "starts", "ends")
    # from left to right: what lies between the last item and this one, then the placeholder
    step = lambda acc, i: F.struct(
        F.concat(acc["done"], F.substring(F.col("text"), acc["at"] + 1, i["starts"] - acc["at"]), F.lit("["), F.upper(i["types"]), F.lit("]")).alias("done"), i["ends"].alias("at")
    )
    last = F.aggregate(pieces, F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), step, lambda a: F.concat(a["done"], F.substring(F.col("text"), a["at"] + 1, F.length("text"))))
    return keyed.join(found, "text_key", "left").select("source_table", "record_id", "field_name", F.when(F.col("types").isNull(), F.col("text")).otherwise(last).alias("text"))
