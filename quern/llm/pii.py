"""Personal data: candidate spans from high-recall generators, chosen by gradient-boosted trees.

The base rules (e-mail, IP address, card, phone) always stand. Besides them ``candidates`` proposes overlapping spans of
wider forms, some as two kinds at once: numbers in groups, long runs of digits, addresses spelt with "at" and "dot", IP
addresses with guarded or spaced dots and of version 6. Boosted trees score a candidate from its format and its context; a
threshold a kind, the best by F-measure among those of a precision of ``FLOOR``, selects what is added. Overlapping candidates give way to the likeliest.

There are no labelled spans, so the trees learn from silver ones: in a bounded sample of distinct texts (``SAMPLE``, by hash)
the base rules' matches, as they stand and rewritten into wider forms (``REWRITES``), against the other candidates of those
texts and against made-up numbers (``DECOYS``) at places without personal data. The context is learnt as well: log-odds of the
words around, and whether a word that announces the kind (``CUES``) or another kind of number (``OTHERS``) stands near; half of the
made spans get one of their own, so that trees know both. Thresholds come from three rounds in which trees judge texts and forms that they haven't seen: a third of the
texts and a third of the forms are left out of each. ``Model.report`` has precision and recall there by kind.

Edge cases: a null text is an empty one and has no spans; copies have equal spans; null ids stay; an empty table, or a
sample without matches, gives a model that adds nothing; columns other than doc_id and text are passed through by
``redact`` and ignored by ``find``. Offsets are code points. Quantifiers are bounded or possessive and the choice of spans is
one sweep over a map of covered characters, so very long texts cost in proportion to their length.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import encode
from quern.session import prepare, table

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 800
#: Bytes of the sampled texts, about.
SAMPLE_BYTES = 8 << 20
#: Texts that are worth learning from.
LIKELY = r"@|[0-9]{7}|\+[0-9]|[0-9]\.[0-9]{1,3}\.[0-9]"
FOLDS = 3
FLOOR = 0.95
LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGITS = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @ signs."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        m, start = DOMAIN.match(text, at), at
        if m:
            while start > last and text[start - 1] in LOCAL:
                start -= 1
        if m and start < at:
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            at = text.find("@", at + 1)
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base rules' matches, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start() and 12 <= len(d := DIGITS.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(DIGITS.sub("", m[0])) <= 15] if "+" in text else []
    return sorted(out)


#: Generators: expression, and the kinds that its spans are proposed as.
GAP = r"[\x20\xa0./\u2010-\u2013-]"
GROUPED = re.compile(rf"(?<![0-9A-Za-z.+-])\+?\(?[0-9]{{1,5}}\)?(?:{GAP}{{1,3}}\(?[0-9]{{2,5}}\)?){{1,7}}(?![0-9A-Za-z])")
RUN = re.compile(r"(?<![0-9A-Za-z.])\+?[0-9]{9,19}(?![0-9A-Za-z])")
DOT = r"(?:\x20?\(\.\)\x20?|\x20?\[\.\]\x20?|\x20?\(dot\)\x20?|\x20?\[dot\]\x20?|\x20dot\x20|\x20\.\x20|\.)"
GUARDED = re.compile(rf"(?<![0-9A-Za-z.])[0-9]{{1,3}}(?:{DOT}[0-9]{{1,3}}){{3}}(?![0-9A-Za-z]|\.[0-9])")
SIX = re.compile(r"(?<![0-9A-Za-z:])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}|[0-9A-Fa-f]{1,4}:(?=:))(?:(?::[0-9A-Fa-f]{1,4}){1,6}|:|[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
AT = re.compile(r"\(at\)|\[at\]|\x20at\x20")
SPELT = re.compile(r"[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63}){1,8}")
#: Last labels of host names that a spelt address ends in.
TOP = frozenset("com org net edu gov io info biz de fr es uk eu us example".split())
NUMBERED = ((GROUPED, (3, 2)), (RUN, (2, 3)), (GUARDED, (1,)), (SIX, (1,)))
N_GENERATORS = len(NUMBERED) + 1
WORDS = re.compile(r"[^\W\d_]+")
BEFORE, AFTER = 40, 20
#: Words that announce a kind, and words that announce other numbers.
CUES = tuple(tuple(x.split()) for x in (
    "mail email contact write reach ask correo courriel schreib", "ip host server node ping ssh gateway adresse direccion", "card visa mastercard amex credit debit pay karte tarjeta carte",
    "call tel phone telephone mobile cell fax ring dial whatsapp telefon llama appel",
))
OTHERS = tuple("order invoice page isbn until number item version room year since total id code chapter".split())
CUED = tuple(map(frozenset, CUES))
NUMBERS = frozenset(OTHERS)


def candidates(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, generator) of overlapping proposals."""
    out = []
    if DIGIT.search(text):
        for k, (expression, kinds) in enumerate(NUMBERED):
            if expression is SIX and ":" not in text:
                continue
            out += [(m.start(), m.end(), kind, k) for m in expression.finditer(text) for kind in kinds]
    return out + [(*around, 0, N_GENERATORS - 1) for around in spelt(text)]


def spelt(text: str) -> Iterator[tuple[int, int]]:
    """Matches of SPELT, found from their spelt at-signs."""
    last = 0
    for m in AT.finditer(text) if "(at)" in text or "[at]" in text or " at " in text else ():
        end = m.start() - (text[m.start() - 1 : m.start()] == " ")
        start = end
        while start > last and end - start < 64 and text[start - 1] in LOCAL:
            start -= 1
        if start < end and (hit := SPELT.match(text, start)):
            yield hit.span()
            last = hit.end()


def features(text: str, start: int, end: int, kind: int, generator: int, odds: dict[str, float]) -> list[float]:
    """The format of a candidate and its context."""
    span, before, after = text[start:end], text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    groups = [len(g) for g in DIGITS.split(span) if g] or [0]
    digits = DIGITS.sub("", span)
    near = [odds.get(w.lower(), 0.0) for w in WORDS.findall(before)]
    then = [odds.get(w.lower(), 0.0) for w in WORDS.findall(after)]
    last = re.split(r"[^A-Za-z]+", span.lower())[-1]
    said = {w.lower() for w in WORDS.findall(before)[-4:] + WORDS.findall(after)[:1]}
    return [
        bool(said & CUED[kind]), sum(bool(said & c) for k, c in enumerate(CUED) if k != kind), bool(said & NUMBERS), "::" in span, ":" in span and any(c in "abcdefABCDEF" for c in span),
        *(generator == k for k in range(N_GENERATORS)), *(kind == k for k in range(len(KINDS))), len(digits), len(span), len(groups), max(groups), min(groups), groups[0], groups[-1],
        len(set(groups[:-1])), span.count(" "), span.count("-"), span.count("."), span.count("("), span.count("/"), span.count(":"), span.startswith("+"), span.startswith("0"),
        12 <= len(digits) <= 19 and luhn(digits), all(len(g) < 4 and int(g) <= 255 for g in DIGITS.split(span) if g), before[-1:].isalpha(), before[-1:] in "$€£#" and bool(before), after[:1] in "%€$" and bool(after),
        last in TOP, len(last), "(" in span or "[" in span, " dot " in span, ". " in span, "_" in span or "." in span.split(" ")[0], sum(c.isdigit() for c in before), sum(c.isdigit() for c in after),
        sum(near[-2:]), sum(near), max(near, default=0.0), sum(then[:2]),
    ]


N_FEATURES = len(features("", 0, 0, 0, 0, {}))


def _spell(at: str, dot: str):
    def form(span: str, digits: str) -> str:
        name, _, host = span.partition("@")
        return f"{name}{at}{host.replace('.', dot)}"

    return form


def varied(span: str, kind: int, words: list[str]) -> list[str]:
    """A base match, and for addresses the same with names from the text's own words, without digits or with a shorter host."""
    if kind != 0:
        return [span]
    name, _, host = span.partition("@")
    labels = host.split(".")
    short, bare = ".".join(labels[-2:]), re.sub("[0-9._%+-]+", "", name) or "a"
    near = [w for w in words if w.isascii()][:3] or ["a"]
    return [span, f"{bare}@{short}", f"{'.'.join(near[:2])}@{near[-1].lower()}.{labels[-1]}", f"{near[-1]}_{bare}@{labels[0]}.{sorted(TOP)[len(name) % len(TOP)]}"]


def _cut(*sizes: int, by: str = " ", first: str = "", last: str = ""):
    """The last digits in groups of the sizes; ``first`` opens and ``last`` closes the first group."""
    def form(span: str, digits: str) -> str:
        own, at, out = digits[-sum(sizes) :], 0, []
        for k, n in enumerate(sizes):
            out.append(f"{first}{own[at : at + n]}{last}" if k == 0 else own[at : at + n])
            at += n
        return by.join(out)

    return form


def _fours(by: str):
    return lambda span, digits: by.join(digits[k : k + 4] for k in range(0, len(digits), 4))


def _dotted(by: str):
    return lambda span, digits: span.replace(".", by)


def _six(form: str):
    """The octets of an address as groups of version 6."""
    return lambda span, digits: form.format(*(f"{int(x):x}{k}{int(x) % 16:x}" for k, x in enumerate(span.split("."))))


#: Wider forms of a base match, by kind. Three in a row are of one shape with three separators, one for each fold.
REWRITES = {
    0: (
        _spell(" (at) ", "."), _spell(" [at] ", "."), _spell("(at)", "."), _spell(" at ", " dot "), _spell(" (at) ", " (dot) "), _spell(" [at] ", " [dot] "),
        _spell("[at]", "."), _spell(" at ", "."), _spell(" at ", " [dot] "), _spell("(at)", "(dot)"), _spell("[at]", "[dot]"), _spell(" at ", " (dot) "),
    ),
    1: (_dotted("[.]"), _dotted("(.)"), _dotted(" . "), _dotted(" dot "), _dotted("[dot]"), _dotted(" [.] "), _six("2001:db8:{0}:{1}:0:{2}:{3}:1"), _six("fe80::{0}:{1}:{2}:{3}"), _six("2001:db8::{0}:{2}:{3}"), _six("2001:db8::{0}"), _six("fe80::{3}"), _six("fd00:{1}::{2}"),
        lambda span, digits: f"2001:db8::{digits[-1]}", lambda span, digits: f"fe80::{digits[-1]}", lambda span, digits: f"fd12:{digits[:2]}::{digits[-1]}"),
    2: (_fours("-"), _fours("."), _fours("\xa0"), _fours(" - "), _fours("/"), _fours(" . ")),
    3: (
        _cut(3, 3, 4, by="-", first="(", last=")"), _cut(3, 3, 4, by=".", first="(", last=")"), _cut(3, 3, 4, first="(", last=")"), _cut(3, 3, 4, by="-"), _cut(3, 3, 4, by="."), _cut(3, 3, 4),
        _cut(2, 2, 2, 2, 2, by="-"), _cut(2, 2, 2, 2, 2, by="."), _cut(2, 2, 2, 2, 2), _cut(4, 3, 3, by="-"), _cut(4, 3, 3, by="."), _cut(4, 3, 3), _cut(2, 4, 4, by="-"), _cut(2, 4, 4, by="."), _cut(2, 4, 4),
        _cut(3, 3, 4, first="0"), _cut(3, 3, 4, by="-", first="0"), _cut(3, 3, 4, by="/", first="0"),
    ),
}
#: What is no personal data, from given digits; in threes likewise.
DECOYS = (
    lambda d: f"20{d[:2]}-{1 + int(d[2]):02d}-{10 + int(d[3]):02d}", lambda d: f"{10 + int(d[3])}.{1 + int(d[2]):02d}.20{d[:2]}", lambda d: f"{10 + int(d[3])}/{1 + int(d[2]):02d}/20{d[:2]}",
    lambda d: f"19{d[4:6]} - 20{d[:2]}", lambda d: f"19{d[4:6]}-20{d[:2]}", lambda d: f"20{d[4:6]}/20{d[:2]}",
    lambda d: f"{1 + int(d[0])}{d[1:3]}-{d[3:6]}-{d[6:9]}", lambda d: f"{1 + int(d[0])}{d[1:3]}.{d[3:6]}.{d[6:9]}", lambda d: f"{1 + int(d[0])}{d[1:3]} {d[3:6]} {d[6:9]}",
    lambda d: f"{1 + int(d[0])}{d[1:9]}", lambda d: f"{1 + int(d[0])}{d[1:11]}", lambda d: f"{1 + int(d[0])}{d[1:13]}",
    lambda d: f"978-{d[0]}-{d[1:4]}-{d[4:9]}-{d[9]}", lambda d: f"{d[:4]}/{d[4:9]}.{d[9:11]}", lambda d: f"{1 + int(d[0])} {d[1:4]} {d[4:7]}",
    lambda d: f"{1 + int(d[0])}.{d[2]}.{d[4:6]}", lambda d: f"{d[0]} . {d[1]} . {d[2]}", lambda d: f"{1 + int(d[0])}.{d[1]}.{d[2]}.{d[3]}.{d[4]}",
    lambda d: f"{1 + int(d[0])}{d[1:3]}-{1 + int(d[4])}{d[5:7]}", lambda d: f"{1 + int(d[0])}{d[1:3]}/{d[3:6]}", lambda d: f"{1 + int(d[0])}{d[1]}.{d[2:4]}",
    lambda d: f"{1 + int(d[0])}:{d[1]}{d[2]}:{d[3]}{d[4]}", lambda d: f"{d[:2]}:{d[2:4]}", lambda d: f"{d[:2]}:{d[2:4]}:{d[4:6]}:{d[6:8]}",
    lambda d: "look at the dot of it", lambda d: "a at b dot c", lambda d: "one at a dot then", lambda d: "arrived at noon. Then", lambda d: "is at home. There", lambda d: "sold at cost. Info",
    lambda d: "not at all.Then", lambda d: "stay at work. De", lambda d: "sat at the bar. For", lambda d: "back at six. All", lambda d: "late at night.But", lambda d: "kept at it.es",
)


class Silver:
    """Candidates to learn from: (text, start, end, kind, generator), label, and the folds of the text and the form (-1: as it stood)."""

    def __init__(self, texts: list[str]):
        self.rows: list[tuple[str, int, int, int, int]] = []
        self.good: list[bool] = []
        self.folds: list[tuple[int, int]] = []
        for n, text in enumerate(texts):
            self.read(n, text)

    def put(self, text: str, start: int, end: int, kind: int | None, folds: tuple[int, int]) -> None:
        """The candidates that meet [start, end); good if of its kind and about as long."""
        low = max(0, start - 2 * BEFORE)
        excerpt = text[low : end + 2 * BEFORE]
        for s, e, k, generator in candidates(excerpt):
            if s + low < end and start < e + low:
                self.rows.append((excerpt, s, e, k, generator))
                self.good.append(kind == k and s + low <= start + 1 and e + low >= end)
                self.folds.append(folds)

    def read(self, n: int, text: str) -> None:
        found, fold = base(text), n % FOLDS
        for start, kind, end in found:
            span = text[start:end]
            digits = DIGITS.sub("", span)
            self.put(text, start, end, kind, (fold, -1))
            left, right = text[max(0, start - 2 * BEFORE) : start], text[end : end + 2 * BEFORE]
            near = WORDS.findall(f"{left} {right}")
            for k, form in enumerate(REWRITES[kind]):
                if kind != 3 or len(digits) > 9:
                    own = varied(span, kind, near[k:])
                    made = form(own[(n + k) % len(own)], digits)
                    # half of them are announced
                    cue = f"{CUES[kind][(n + k // 2) % len(CUES[kind])]} " if (n + k) % 2 and (not left or left[-1].isspace()) else ""
                    self.put(left + cue + made + right, len(left + cue), len(left + cue) + len(made), kind, (fold, k % FOLDS))
        # numbers at places between words, and the text's other candidates
        digits = (DIGITS.sub("", text) + "1234567890" * 2)[:24]
        blanks = [m.start() for m in re.finditer(r"(?<=[a-z]) (?=[a-z])", text)] or [0]
        for k, form in enumerate(DECOYS):
            at = blanks[(n * 7 + k * 13) % len(blanks)]
            if not any(a < at + BEFORE and at < b + BEFORE for a, _, b in found):
                made, left = form(digits[k % 8 :] + digits), text[max(0, at - 2 * BEFORE) : at] + " "
                if (n + k) % 3 == 0 and made[0].isdigit():
                    left += OTHERS[(n + k) % len(OTHERS)] + " "
                self.put(f"{left}{made} {text[at + 1 : at + 2 * BEFORE]}", len(left), len(left) + len(made), None, (fold, k % FOLDS))
        covered = cover(len(text), [(a, b) for a, _, b in found])
        for s, e, kind, generator in candidates(text):
            if 1 not in covered[s:e]:
                left = text[max(0, s - BEFORE) : s]
                self.rows.append((left + text[s : e + AFTER], len(left), len(left) + e - s, kind, generator))
                self.good.append(False)
                self.folds.append((fold, -1))

    def odds(self, use: np.ndarray) -> dict[str, float]:
        """Smoothed log-odds of the words around the good and the other candidates among the rows to use."""
        counts: dict[str, list[int]] = {}
        for k in np.flatnonzero(use).tolist():
            text, s, e, _, _ = self.rows[k]
            for w in {w.lower() for w in WORDS.findall(text[max(0, s - BEFORE) : s]) + WORDS.findall(text[e : e + AFTER])}:
                counts.setdefault(w, [0, 0])[self.good[k]] += 1
        bad, fine = (1 + sum(c[k] for c in counts.values()) for k in (0, 1))
        return {w: round(float(np.log((c[1] + 1) / fine) - np.log((c[0] + 1) / bad)), 3) for w, c in counts.items() if sum(c) >= 20}

    def matrix(self, use: np.ndarray, odds: dict[str, float]) -> np.ndarray:
        return np.array([features(*self.rows[k], odds) for k in np.flatnonzero(use).tolist()], np.float32).reshape(-1, N_FEATURES)


def cover(n: int, spans: list[tuple[int, int]]) -> bytearray:
    """A map of n characters with those of the spans set."""
    out = bytearray(n)
    for a, b in spans:
        out[a:b] = b"\x01" * (b - a)
    return out


TREES, DEPTH, RATE, BINS = 80, 4, 0.2, 32


def boost(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Gradient-boosted trees on the logistic loss: features and cuts of the inner nodes, values of the leaves, start."""
    inner, n, wide = (1 << DEPTH) - 1, *x.shape
    feature, cut, leaf = np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, 1 << DEPTH))
    start = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(wide)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)
    usable = np.arange(BINS + 1)[None, :] < np.array([len(e) for e in edges])[:, None]
    slot = (binned + np.arange(wide) * (BINS + 1)).astype(np.int64)
    z = np.full(n, start)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, many = (1 << level) - 1, 1 << level
            key = (slot + ((node - first) * wide * (BINS + 1))[:, None]).ravel()
            gs, hs = (np.cumsum(np.bincount(key, np.repeat(v, wide), minlength=many * wide * (BINS + 1)).reshape(many, wide, BINS + 1), axis=2) for v in (g, h))
            gain = gs**2 / (hs + 1) + (gs[..., -1:] - gs) ** 2 / (hs[..., -1:] - hs + 1) - gs[..., -1:] ** 2 / (hs[..., -1:] + 1)
            best = np.where(usable, gain, 0).reshape(many, -1)
            at = best.argmax(1)
            for k in np.flatnonzero(best[np.arange(many), at] > 1e-6).tolist():
                f, b = divmod(int(at[k]), BINS + 1)
                feature[t, first + k], cut[t, first + k] = f, edges[f][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > cut[t, node])
        at = node - inner
        leaf[t] = -RATE * np.bincount(at, g, minlength=1 << DEPTH) / (np.bincount(at, h, minlength=1 << DEPTH) + 1)
        z = z + leaf[t][at]
    return feature, cut, leaf, start


def probability(trees, x: np.ndarray) -> np.ndarray:
    feature, cut, leaf, start = trees
    z, rows = np.full(len(x), start), np.arange(len(x))
    for t in range(TREES):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, feature[t][node]] > cut[t][node])
        z += leaf[t][node - len(feature[t])]
    return 1 / (1 + np.exp(-z))


class Model:
    """Trees with the words' odds and, for each kind, the least probability that is redacted."""

    def __init__(self, texts: list[str]):
        made = Silver(texts)
        y, kinds = np.array(made.good, float), np.array([r[3] for r in made.rows], int)
        text, form = np.array(made.folds, int).reshape(-1, 2).T
        self.trees, self.odds, self.report = None, {}, {}
        self.least = np.full(len(KINDS), 2.0)  # nothing is added
        judged = []
        for k in range(FOLDS):
            seen, fresh = (text != k) & (form != k), (text == k) & ((form == k) | (form < 0))
            if 0 < y[seen].sum() < seen.sum():
                odds = made.odds(seen)
                p = probability(boost(made.matrix(seen, odds), y[seen]), made.matrix(fresh, odds))
                judged.append(np.stack([p, y[fresh], kinds[fresh]]))
        if not judged:
            return
        every = np.ones(len(y), bool)
        self.odds = made.odds(every)
        self.trees = boost(made.matrix(every, self.odds), y)
        p, good, kinds = np.concatenate(judged, 1)
        for kind, name in enumerate(KINDS):
            order = np.flatnonzero(kinds == kind)[np.argsort(-p[kinds == kind], kind="stable")]
            hits, many = np.cumsum(good[order]), np.arange(1, len(order) + 1)
            ok = np.flatnonzero((hits / many >= FLOOR) & (p[order] >= 0.1))
            if len(ok):
                best = ok[(2 * hits / (many + max(1.0, good[order].sum())))[ok].argmax()]
                self.least[kind] = p[order][best]
                self.report[name] = (float(hits[best] / many[best]), float(hits[best] / max(1, good[order].sum())))

    def added(self, text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans that the trees add to the base ones: likeliest first, none over another."""
        if not self.trees or not (some := candidates(text)):
            return []
        covered = cover(len(text), [(a, b) for a, _, b in found])
        some = [c for c in some if 1 not in covered[c[0] : c[1]]]
        if not some:
            return []
        p = probability(self.trees, np.array([features(text, *c, self.odds) for c in some], np.float32))
        out = []
        for k in np.argsort(-p, kind="stable").tolist():
            s, e, kind, _ = some[k]
            if p[k] >= self.least[kind] and 1 not in covered[s:e]:
                out.append((s, kind, e))
                covered[s:e] = b"\x01" * (e - s)
        return out


def train(docs: DataFrame, rows: int = SAMPLE) -> Model:
    """A model from about ``rows`` distinct texts that are LIKELY to hold personal data, ``SAMPLE_BYTES`` at most, chosen by hash."""
    import pickle

    spark = prepare(docs.sparkSession)
    hashed, likely = docs.select(F.xxhash64("text").alias("h"), "text"), F.col("text").rlike(LIKELY)
    # bounded by ``rows`` and bytes: the threshold on the hash is the share that is wanted of all, copies count once
    n, size = hashed.where(likely).select("h", F.octet_length("text").cast("long").alias("n")).groupBy("h").agg(F.min("n").alias("n")).agg(F.count("*"), F.sum("n")).first()
    limit = int(-(2**63) + 2**64 * min(1.0, rows / max(1, n), SAMPLE_BYTES / max(1, size or 0))) - 1
    # the hash first, so that the expression is tried on few texts
    chosen = hashed.where((F.col("h") <= F.lit(max(limit, -(2**63)))) & likely).groupBy("h").agg(F.min("text").alias("text")).repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        texts = [t for _, t in sorted(r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))]
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Model(texts))], pa.binary())], names=["model"])

    found = chosen.mapInArrow(run, "model binary").first()
    return pickle.loads(found[0]) if found else Model([])


def name(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (text) and spans (text) of each row."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    columns = [*(f"n_{k}" for k in KINDS), "base", "spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in encode.slices(batches, 2000):
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                found = base(text)
                both = sorted([*found, *shared.value.added(text, found)])
                rows.append((*(sum(k == kind for _, k, _ in found) for kind in range(4)), name(found), name(both)))
            out = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:])], names=["doc_id", *columns])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base string, spans string")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of spans replaced by the name of its first kind."""
    out, last = [], 0
    for s, kind, e in sorted(spans):
        if s >= last:
            out += [text[last:s], f"[{KINDS[kind].upper()}]"]
        last = max(last, e)
    return "".join(out) + text[last:]


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with redacted texts, and n_chars (if there) as their lengths; null texts stay null."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode.forget()
        for batch in encode.slices(batches, 2000):
            out = []
            for text in batch.column(at):
                text = text.as_py()
                if text:
                    found = base(text)
                    spans = [*found, *shared.value.added(text, found)]
                    text = mask(text, spans) if spans else text
                out.append(text)
            columns = list(batch.columns)
            columns[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    done = docs.mapInArrow(run, docs.schema)
    return done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


def op7_pii(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find(docs, train(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
