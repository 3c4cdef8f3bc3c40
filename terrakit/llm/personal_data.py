"""Personal data by rules and by a semi-Markov conditional random field.

The rules find four kinds by form. The field scores whole candidate spans: their digit
groups, separators, check digit, context. A dynamic programme over candidates of bounded
size chooses boundaries and kinds jointly; what lies outside any span scores nothing, so
stretches of text without candidates need no work. What the rules found stays; the field
adds spans beside it, as where two numbers stand so close that a rule takes them for one.

The field is fitted on stretches of the corpus where the rules leave no doubt, counted
over all documents, and on generated examples of usual forms.
"""

from __future__ import annotations

import bisect
import json
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrakit.llm.common import raw_texts

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

#: Stretches of the corpus that the field is fitted on: the most frequent ones by form.
FIT_FORMS = 2000
#: Generated examples beside them, and steps of the fit.
GENERATED = 1200
FIT_STEPS = 150
PENALTY = 0.02

#: Bounds of a candidate: digits, digit groups, and words on either side of an at sign.
MOST_DIGITS = 19
MOST_GROUPS = 10
MOST_LABELS = 6

#: Bytes of text after which a task hands on what it has.
BATCH_BYTES = 8 << 20

# The forms of the four kinds. A digit before cannot start an address that
# the digits after it do not, so the rule for addresses looks at whole digit runs only. It
# tests that behind the first digit: a pattern that starts with one skips all other text.
_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_BACK = re.compile(r"[A-Za-z0-9._%+-]*")
_IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_STRETCH = re.compile(r"[+(0-9](?:[\x20().+-]{0,3}[0-9])*+")
_GROUPS = re.compile(r"[0-9]+")
_WORD_BACK = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]{0,4}$")
_SPOKEN_AT = re.compile(r"\x20?[\[({]\x20?[aA][tT]\x20?[\])}]\x20?|\x20[aA][tT]\x20(?=[A-Za-z0-9-]+\x20[dD][oO][tT]\x20)")
_IN_BRACKETS = re.compile(r"[\[({]\x20?[aA][tT]\x20?[\])}]")
_DOT = r"(?:\.|\x20?[\[({]\x20?[dD][oO][tT]\x20?[\])}]\x20?|\x20[dD][oO][tT]\x20)"
_LABELS_BEHIND = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{0,{MOST_LABELS}}}")
_LABELS_AHEAD = re.compile(rf"(?:[A-Za-z0-9_%+-]+{_DOT}){{0,{MOST_LABELS}}}[A-Za-z0-9_%+-]+$")
_LABEL = re.compile(r"[A-Za-z0-9_%+-]+")
_ONE_DOT = re.compile(_DOT)
_DOT_END = re.compile(_DOT + "$")

# Words before a number that say what it is.
CUES = {
    "tel": "phone", "telephone": "phone", "phone": "phone", "call": "phone", "mobile": "phone", "cell": "phone",
    "fax": "phone", "whatsapp": "phone", "card": "card", "visa": "card", "mastercard": "card", "amex": "card",
    "credit": "card", "debit": "card", "ip": "ip", "host": "ip", "server": "ip", "mail": "email", "email": "email",
    "contact": "email", "order": "number", "invoice": "number", "isbn": "number", "version": "number", "no": "number",
    "section": "number", "id": "number", "item": "number", "serial": "number",
}

Span = tuple[int, int, int]  # start, kind, end
Segment = tuple[int, int, int, tuple[str, ...]]  # start, end, kind, features


_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    """Whether the check digit at the end fits."""
    return sum((digits[-1::-2] + digits[-2::-2].translate(_DOUBLED)).encode()) % 10 == 48 * len(digits) % 10


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or (len(part) == 3 and part <= "255")


def base_spans(text: str) -> list[Span]:
    """What the rules find, by start and kind.

    Time is linear: an at sign looks back no further than to the one before it.
    """
    found: list[Span] = []
    free = 0
    at = text.find("@")
    while at >= 0:
        back = _LOCAL_BACK.match(text[free:at][::-1])
        match = _AT_DOMAIN.match(text, at) if back.end() else None
        if match:
            found.append((at - back.end(), EMAIL, match.end()))
        free = match.end() if match else at + 1
        at = text.find("@", free)
    if not _GROUPS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(map(_small, m.group().split("."))):
            found.append((m.start(), IP, m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), CARD, m.end()))
    for m in _PHONE.finditer(text):
        digits = sum(c.isdigit() for c in m.group())
        if 10 <= digits <= 15:
            found.append((m.start(), PHONE, m.end()))
    return sorted(found)


def _side(text: str, place: int, step: int) -> str:
    """What stands next to a span: its continuation counts for more than the sign itself."""
    near = text[place : place + 2] if step > 0 else text[max(0, place - 2) : place][::-1]
    if not near:
        return "end"
    if near[0].isdigit():
        return "digit"
    if len(near) > 1 and near[0] in " .-/:,+(" and near[1].isdigit():
        return "digit after " + near[0]
    return "letter" if near[0].isalpha() else "blank" if near[0].isspace() else "sign"


def _cue(text: str, start: int) -> str:
    word = _WORD_BACK.search(text[max(0, start - 20) : start])
    return CUES.get(word.group(1).lower(), "other") if word else "none"


@dataclass
class Stretch:
    """A run of digit groups that no number crosses."""

    text: str
    groups: list[tuple[int, int]]
    start: int

    def candidates(self) -> Iterator[tuple[int, int, int, int, int, list[str]]]:
        """Start, end, kind, first and last group, and gaps of runs of whole groups that
        could be a number of some kind."""
        text, groups = self.text, self.groups
        for i, (first, _) in enumerate(groups):
            opened = first
            while opened > self.start and text[opened - 1] in "+(" and opened > first - 2:
                opened -= 1
            digits, gaps = 0, []
            for j in range(i, min(len(groups), i + MOST_GROUPS)):
                a, b = groups[j]
                digits += b - a
                if digits > MOST_DIGITS:
                    break
                if j > i:
                    gaps.append(text[groups[j - 1][1] : a])
                if digits <= 12 and gaps == [".", ".", "."]:
                    yield first, b, IP, i, j, gaps
                if digits >= 14 and all(g in (" ", "-") for g in gaps):
                    yield first, b, CARD, i, j, gaps
                if 10 <= digits <= 15:
                    yield opened, b, PHONE, i, j, gaps

    def structure(self, at: int, i: int, j: int, gaps: list[str]) -> tuple[str, ...]:
        """Features of the groups and what separates them."""
        sizes = [y - x for x, y in self.groups[i : j + 1]]
        return (
            f"sizes {'-'.join(map(str, sizes))}", f"gaps {'|'.join(sorted(set(gaps)))}", f"digits {sum(sizes)}",
            f"opens {self.text[at:self.groups[i][0]]}", f"groups {len(sizes)}",
        )

    def digits(self, i: int, j: int) -> tuple[str, ...]:
        """Features of the digits themselves."""
        parts = [self.text[x:y] for x, y in self.groups[i : j + 1]]
        whole = "".join(parts)
        return f"check {luhn(whole)} {len(whole) >= 14}", f"octets {all(map(_small, parts))}"

    def sides(self, at: int, end: int) -> tuple[str, ...]:
        """Features of what stands beside the span."""
        return f"left {_side(self.text, at, -1)}", f"right {_side(self.text, end, 1)}", f"cue {_cue(self.text, at)}"

    def segments(self) -> Iterator[Segment]:
        for at, end, kind, i, j, gaps in self.candidates():
            yield at, end, kind, self.structure(at, i, j, gaps) + self.digits(i, j) + self.sides(at, end)


def stretches(text: str) -> Iterator[Stretch]:
    """Runs of digits with a few signs between them, ten digits or more."""
    for m in _STRETCH.finditer(text):
        if m.end() - m.start() >= 10:
            groups = [g.span() for g in _GROUPS.finditer(text, m.start(), m.end())]
            if sum(b - a for a, b in groups[:MOST_GROUPS]) >= 4:
                yield Stretch(text, groups, m.start())


def spoken_segments(text: str) -> Iterator[list[Segment]]:
    """Addresses with a written-out at sign, with every cut at a label on both sides."""
    # Few texts hold what each of the sign's two forms needs, and that is found far sooner.
    if " dot " not in text.lower() and not _IN_BRACKETS.search(text):
        return
    for at in _SPOKEN_AT.finditer(text):
        ahead = _LABELS_AHEAD.search(text[max(0, at.start() - 160) : at.start()])
        behind = _LABELS_BEHIND.match(text, at.end())
        if not ahead or not behind:
            continue
        shift = at.start() - len(ahead.group())
        starts = [shift + m.start() for m in _LABEL.finditer(ahead.group()) if m.group().lower() != "dot"]
        ends = [at.end() + m.end() for m in _LABEL.finditer(behind.group()) if m.group().lower() != "dot"]
        some = []
        for start in starts:
            for end in ends:
                domain = text[at.end() : end]
                top = domain[max(map(domain.rfind, ". ])}")) + 1 :]
                before = text[max(0, start - 7) : start]
                some.append((start, end, EMAIL, (
                    f"at {at.group().strip().lower()}", f"dots {len(_ONE_DOT.findall(domain))}",
                    f"top {top.isalpha() and 2 <= len(top) <= 6}", f"more before {bool(_DOT_END.search(before))}",
                    f"more after {bool(_ONE_DOT.match(text, end))}", f"spoken {'dot' in domain.lower()}",
                    f"cue {_cue(text, start)}",
                )))
        if some:
            yield some


#: Feature groups that are summed only for spans that the features before leave a chance.
LATER = (("check", "octets", "left", "right", "cue"), ("left", "right", "cue"))


class Model:
    """Weights by kind and feature, and the choice of spans by them."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.known: dict[tuple, float] = {}
        self.most = []
        for kind in range(len(KINDS)):
            best: dict[str, float] = {}
            for name, w in weights.items():
                k, group = name.split(" ")[:2]
                if k == str(kind):
                    best[group] = max(best.get(group, 0.0), w)
            self.most.append([sum(best.get(g, 0.0) for g in groups) for groups in LATER])

    def score(self, kind: int, features: Iterable[str]) -> float:
        return sum(self.weights.get(f"{kind} {f}", 0.0) for f in features)

    def scored(self, text: str, free: Callable[[int, int], bool]) -> Iterator[tuple[int, int, int, float]]:
        """Start, end, kind and score of the free candidates that score above nothing."""
        for stretch in stretches(text):
            groups = stretch.groups
            for at, end, kind, i, j, gaps in stretch.candidates():
                if not free(at, end):
                    continue
                key = (kind, groups[i][0] - at, text[at], *(b - a for a, b in groups[i : j + 1]), *gaps)
                score = self.known.get(key)
                if score is None:
                    if len(self.known) > 50_000:
                        self.known.clear()
                    score = self.score(kind, ("", *stretch.structure(at, i, j, gaps)))
                    self.known[key] = score
                if score + self.most[kind][0] > 0:
                    score += self.score(kind, stretch.digits(i, j))
                    if score + self.most[kind][1] > 0:
                        score += self.score(kind, stretch.sides(at, end))
                        if score > 0:
                            yield at, end, kind, score
        for some in spoken_segments(text):
            for at, end, kind, features in some:
                score = self.score(kind, ("", *features))
                if score > 0 and free(at, end):
                    yield at, end, kind, score

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """What the rules find, and that together with what the field adds beside it: the
        candidates of the largest total score that overlap neither those nor one another."""
        base = base_spans(text)
        starts, ends = _covered(base)

        def clear(at: int, end: int) -> bool:
            k = bisect.bisect_right(ends, at)
            return k == len(ends) or starts[k] >= end

        free = [(end, at, kind, score) for at, end, kind, score in self.scored(text, clear)]
        if not free:
            return base, base
        free.sort()
        total, came, stops = [0.0], [0], [f[0] for f in free]
        for n, (_, at, _, score) in enumerate(free):
            before = bisect.bisect_right(stops, at, 0, n)
            take = total[before] + score > total[-1]
            came.append(before if take else -1)
            total.append(total[before] + score if take else total[-1])
        added, n = [], len(free)
        while n:
            if came[n] >= 0:
                added.append((free[n - 1][1], free[n - 1][2], free[n - 1][0]))
                n = came[n]
            else:
                n -= 1
        return base, sorted(base + added)


def _covered(base: list[Span]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover together."""
    starts: list[int] = []
    ends: list[int] = []
    for start, _, end in base:
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)
    return starts, ends


def _form(some: list[Segment], gold: Iterable[Span]) -> str | None:
    """A stretch as the field sees it: edges by rank, features, which candidates are right."""
    edges = {e: k for k, e in enumerate(sorted({e for s in some for e in s[:2]}))}
    right = {(a, b, kind) for a, kind, b in gold}
    if not right <= {s[:3] for s in some}:
        return None
    return json.dumps([len(edges), [[edges[s[0]], edges[s[1]], s[2], s[3], s[:3] in right] for s in some]])


def sure_forms(text: str) -> Iterator[str]:
    """Forms of the stretches where the rules leave no doubt: a match of a rule covers all
    candidates, or there is a single digit group that no rule takes. Lists of numbers are
    left out."""
    found = [stretch for stretch in stretches(text) if len(stretch.groups) <= MOST_GROUPS]
    base = base_spans(text) if found else []
    for stretch in found:
        some = list(stretch.segments())
        if not some:
            continue
        low, high = min(s[0] for s in some), max(s[1] for s in some)
        k = bisect.bisect_left(base, (low, -1, -1))
        if k < len(base) and (base[k][0], base[k][2]) == (low, high):
            right = [base[k]]
        elif len(stretch.groups) == 1 and not any(b[0] < high and low < b[2] for b in base[max(0, k - 4) : k + 1]):
            right = []
        else:
            continue
        form = _form(some, right)
        if form:
            yield form


def example(rng: random.Random) -> tuple[str, list[Span]]:
    """A made-up text with its spans."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    words = lambda n: " ".join("".join(rng.choice("aeilnorst") for _ in range(rng.randint(2, 8))) for _ in range(n))

    def card(good: bool = True) -> str:
        while True:
            size = rng.choice([16, 16, 16, 15, 14, 19])
            number = rng.choice("3456") + digits(size - 1)
            if luhn(number) == good:
                break
        if size == 16 and rng.random() < 0.5:
            sep = rng.choice(" -")
            return sep.join(number[k : k + 4] for k in range(0, 16, 4))
        if size == 15 and rng.random() < 0.5:
            return f"{number[:4]} {number[4:10]} {number[10:]}"
        return number

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return rng.choice([
            f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"+1-{a}-{b}-{c}", f"+1{a}{b}{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}",
            f"+44 20 {digits(4)} {c}", f"+49 {digits(2)} {digits(7)}0", f"+33 {digits(1)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}",
            f"+41 {digits(2)} {b} {digits(2)} {digits(2)}", f"+1 {a}.{b}.{c}",
        ])

    def ip() -> str:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))

    def email() -> str:
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", "."), (" at ", " dot "), ("[at]", "[dot]"), (" [at] ", ".")])
        local = words(1) + (rng.choice([".", dot]) + words(1) if rng.random() < 0.3 else "")
        host = words(1) + (dot + words(1) if rng.random() < 0.3 else "")
        return f"{local}{at}{host}{dot}{rng.choice(['com', 'org', 'net', 'de', 'io'])}"

    def other() -> str:
        sep = rng.choice(" -.")
        return rng.choice([
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
            lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}",
            lambda: f"{rng.randint(1900, 2030)}-{rng.randint(1900, 2030)}",
            lambda: f"{rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)} - {rng.randint(10, 28)}.{rng.randint(10, 12)}.{rng.randint(1900, 2030)}",
            lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
            lambda: card(False), lambda: rng.choice("123456789") + digits(rng.randint(9, 18)),
            lambda: sep.join(digits(rng.randint(1, 3)) for _ in range(rng.randint(5, 9))),
            lambda: " ".join(str(rng.randint(1, 999)) for _ in range(rng.randint(4, 9))),
            lambda: " ".join(str(rng.randint(1900, 2030)) for _ in range(rng.randint(3, 5))),
            lambda: f"{rng.randint(1, 99)} {digits(3)} {digits(3)} {digits(3)}",
            lambda: f"{rng.randint(300, 999)}.{digits(3)}.{digits(3)}.{digits(3)}",
            lambda: f"meet {words(1)} at {words(1)} dot",
        ])()

    text, spans = words(rng.randint(0, 3)), []
    if rng.random() < 0.15:
        text += " " + rng.choice(list(CUES)) + rng.choice(["", ":"])
    pieces = rng.choice([1, 1, 1, 2, 2, 3]) if rng.random() < 0.65 else 0
    for _ in range(max(1, pieces)):
        text += " " if text else ""
        if pieces:
            kind = rng.choice([EMAIL, IP, CARD, CARD, PHONE, PHONE])
            made = (email, ip, card, phone)[kind]()
            spans.append((len(text), kind, len(text) + len(made)))
            text += made
        else:
            text += other()
    return text + rng.choice(["", ".", ",", "!!"]) + rng.choice(["", " " + words(2)]), spans


def fit(corpus_forms: list[tuple[str, int]], seed: int = 7, generated: int = GENERATED) -> Model:
    """Weights of the largest penalised likelihood, by gradient steps with step sizes of
    their own for each weight. Forms that repeat count by the logarithm of their number."""
    rng = random.Random(seed)
    counts: dict[str, float] = {}
    for _ in range(generated):
        text, gold = example(rng)
        for some in [*(list(s.segments()) for s in stretches(text)), *spoken_segments(text)]:
            low, high = min((s[0] for s in some), default=0), max((s[1] for s in some), default=0)
            form = some and _form(some, [g for g in gold if g[0] < high and low < g[2]])
            if form:
                counts[form] = counts.get(form, 0.0) + 1.0
    for form, n in corpus_forms:
        counts[form] = counts.get(form, 0.0) + 1.0 + float(np.log2(n))
    names: dict[str, int] = {}
    chains = []
    for form, weight in counts.items():
        edges, some = json.loads(form)
        ids = [[names.setdefault(f"{kind} {f}", len(names)) for f in (*features, "")] for _, _, kind, features, _ in some]
        ends = [[k for k, s in enumerate(some) if s[1] == e] for e in range(edges)]
        starts = [[k for k, s in enumerate(some) if s[0] == e] for e in range(edges)]
        chains.append((weight, some, ids, ends, starts, np.array([s[4] for s in some], float)))
    flat = np.array([f for chain in chains for own in chain[2] for f in own])
    owner = np.repeat(np.arange(sum(len(c[1]) for c in chains)), [len(own) for c in chains for own in c[2]])
    w, scale = np.zeros(len(names)), np.full(len(names), 1e-8)
    for _ in range(FIT_STEPS if chains else 0):
        scores = np.bincount(owner, w[flat])
        pull, at = np.zeros(len(scores)), 0
        for weight, some, _, ends, starts, right in chains:
            own = scores[at : at + len(some)].tolist()
            pull[at : at + len(some)] = weight * (right - _marginals(some, own, ends, starts))
            at += len(some)
        slope = np.bincount(flat, pull[owner], len(names)) - PENALTY * w
        scale += slope**2
        w += 0.5 * slope / np.sqrt(scale)
    return Model({name: float(w[k]) for name, k in names.items()})


def _marginals(some: list, scores: list[float], ends: list[list[int]], starts: list[list[int]]) -> np.ndarray:
    """Probability of each candidate, by sums over all ways to choose, forward and back."""
    n = len(ends)
    ahead, behind = [0.0] * n, [0.0] * n
    for e in range(1, n):
        ahead[e] = _log_sum([ahead[e - 1]] + [ahead[some[k][0]] + scores[k] for k in ends[e]])
    for e in range(n - 2, -1, -1):
        behind[e] = _log_sum([behind[e + 1]] + [behind[some[k][1]] + scores[k] for k in starts[e]])
    logs = np.array([ahead[s[0]] + x + behind[s[1]] for s, x in zip(some, scores)])
    return np.exp(logs - ahead[-1])


def _log_sum(values: list[float]) -> float:
    if len(values) == 1:
        return values[0]
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def corpus_forms(docs: DataFrame, forms: int = FIT_FORMS) -> list[tuple[str, int]]:
    """The most frequent sure forms with their numbers over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, int] = {}
            for text in raw_texts(batch.column(0)):
                for form in sure_forms(text.decode("utf-8", "replace")):
                    counts[form] = counts.get(form, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["form", "n"]
            )

    counted = docs.select("text").mapInArrow(run, "form string, n long").groupBy("form").agg(F.sum("n").alias("n"))
    return [(r["form"], r["n"]) for r in counted.orderBy(F.desc("n"), "form").limit(forms).collect()]


def find_personal_data(docs: DataFrame, model: Model | None = None, masked: bool = True) -> DataFrame:
    """``doc_id, base, spans, masked``: what the rules find, all spans, and the text with
    each stretch of spans replaced by its first kind in angle brackets. Without ``masked``
    that column is left out, and no text comes back from Python.

    Spans are ``kind, start, end`` in code points, by start and then kind; rules of
    several kinds may overlap, added spans overlap nothing. A null text counts as empty
    and has none. Repeated rows give equal rows; null ids are kept; other columns,
    whatever their names, do not matter. Empty table: empty result. Without a ``model``
    one is fitted first, which reads all texts once more and brings at most ``FIT_FORMS``
    forms to the driver. A row is worked on alone, whatever its length.
    """
    model = model or fit(corpus_forms(docs))
    span = "array<struct<kind:string,start:long,end:long>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names, kinds = ["base", "spans", "masked"], [kind, kind, pa.string()]
    if not masked:
        names, kinds = names[:2], kinds[:2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans]
        for batch in batches:
            ids, start, size = batch.column(0), 0, 0
            out: tuple[list, ...] = tuple([] for _ in kinds)
            for i, raw in enumerate(raw_texts(batch.column(1))):
                text = raw.decode("utf-8", "replace")
                base, spans = model.spans(text)
                out[0].append(named(base))
                out[1].append(named(spans))
                if masked:
                    out[2].append(_masked(text, spans))
                size += len(raw)
                if size >= BATCH_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [ids.slice(start, i + 1 - start), *map(pa.array, out, kinds)], ["doc_id", *names]
                    )
                    start, size, out = i + 1, 0, tuple([] for _ in kinds)

    own = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {own}, base {span}, spans {span}" + ", masked string" * masked
    )


def _masked(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            parts += [text[at:start], f"<{KINDS[kind]}>"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def written_spans(spans: Column) -> Column:
    """``kind:start:end`` of each span, with commas between."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
