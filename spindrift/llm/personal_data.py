"""Personal data by a semi-Markov conditional random field over whole spans.

A text is split into atoms (runs of digits, runs of letters, single signs).  A segmentation
labels stretches of atoms as email, ip, card or phone and every other atom as nothing; its
score is the sum of weights of whole-span features (digit counts, group lengths, checksum,
signs used, what stands on both sides) and of the labels of neighbouring segments.  The best
segmentation is found by dynamic programming over entities of at most ``MAX_ATOMS`` atoms, so
boundaries and types are chosen together: of two card numbers beside each other, or a phone
number and an address that a pattern runs together, each comes out by itself.

Only atoms of a region (digits with the signs that join them, what surrounds an at sign) can
be part of an entity.  All other atoms are labelled as nothing whatever the weights, so the
best segmentation of a text is made of the best ones of its regions; regions are found in
linear time, whole texts at any length.

The weights are learned by stochastic gradient ascent on the conditional likelihood, from
regions of at most ``SAMPLE_DOCUMENTS`` documents, labelled by the plain patterns, and from as
many examples that a generator writes, among them forms that the patterns miss (cards and
phones side by side, phone numbers without a country, written-out at signs).
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import tidied

KINDS = ("email", "ip", "card", "phone")
#: An entity has at most so many atoms; a region's DP costs atoms times this.
MAX_ATOMS = 40
#: Documents that the sample is drawn from, and regions kept of it; generated examples.
SAMPLE_DOCUMENTS, SAMPLE_REGIONS, GENERATED = 4000, 600, 600
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_NUMBERS = re.compile(r"[0-9][0-9+().\x20-]*")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_AT = re.compile(r"@|\[at\]|\(at\)")
_RIGHT = re.compile(r"\x20?[A-Za-z0-9._%+@-]*(?:\x20?(?:\[dot\]|\(dot\))\x20?[A-Za-z0-9._%+@-]+)*")
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|\[at\]|\(at\)|\[dot\]|\(dot\)|.", re.S)
_ATS, _DOTS = frozenset(("@", "[at]", "(at)")), frozenset((".", "[dot]", "(dot)"))


# ---- regions and the plain patterns, each in one pass


def number_regions(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _NUMBERS.finditer(text):
        s = m.start()
        while s and m.start() - s < 2 and text[s - 1] in "+(":
            s -= 1
        out.append((s, m.end()))
    return out


def at_regions(text: str) -> list[tuple[int, int]]:
    """What surrounds at signs: the longest run of an address's characters on both sides."""
    out, floor = [], 0
    for m in _AT.finditer(text):
        if m.start() < floor:
            continue
        s = m.start()
        if len(m.group()) > 1 and s > floor and text[s - 1] == " ":
            s -= 1
        while s > floor and text[s - 1] in _LOCAL:
            s -= 1
        e = _RIGHT.match(text, m.end()).end()
        # a written-out at sign within the run begins another one: it stays outside
        out.append((s, e))
        floor = e
    return out


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches that hold every candidate, in order; those that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(number_regions(text) + at_regions(text)):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def octet(digits: str) -> bool:
    d = digits.lstrip("0")
    return len(d) < 3 or len(d) == 3 and d <= "255"


def plain_spans(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the plain patterns, leftmost and non-overlapping for each kind;
    matches that fail their check are dropped. Every match lies in one of the regions."""
    out = []
    for s, e in found:
        floor = s
        at = text.find("@", s, e)
        while at >= 0:
            a = at
            while a > floor and text[a - 1] in _LOCAL:
                a -= 1
            m = _DOMAIN.match(text, at + 1)
            if m and a < at:
                out.append((a, 0, m.end()))
            floor = m.end() if m and a < at else at + 1
            at = text.find("@", max(floor, at + 1), e)
        for m in _CHAIN.finditer(text, s, e):
            if m.group().count(".") < 3:
                continue
            groups = list(re.finditer(r"[0-9]+", m.group()))
            for i in range(0, len(groups) - 3, 4):
                if all(octet(g.group()) for g in groups[i : i + 4]):
                    out.append((m.start() + groups[i].start(), 1, m.start() + groups[i + 3].end()))
        for m in _CARD.finditer(text, s, e):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text, s, e):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(set(out))


# ---- candidates and whole-span features


def _side(text: str, at: int, step: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    kind = "space" if c.isspace() else "digit" if c.isdigit() else "letter" if c.isalpha() else c if c in ".-+@(/:" else "sign"
    beyond = at + step
    if kind in ".-+@(/:" and 0 <= beyond < len(text) and text[beyond].isalnum():
        kind += "x"
    return kind


def candidates(text: str, s: int, e: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[str]]]]:
    """The atoms of a region and its possible entities (first atom, end atom, kind, features).

    An email has one at sign and a dot after it; an ip four groups; a card 13 to 19 digits
    joined by blanks or hyphens; a phone 7 to 15 digits in at most six groups.
    """
    part = text[s:e]
    if not _AT.search(part) and sum(map(str.isdigit, part)) < 7 and part.count(".") < 3:
        return [], []
    bounds = [(s + m.start(), s + m.end()) for m in _ATOM.finditer(part)]
    word = [text[a:b] for a, b in bounds]
    is_digit = [w[0] in "0123456789" for w in word]
    is_name = [d or w.isalpha() for d, w in zip(is_digit, word, strict=True)]
    out: list[tuple[int, int, int, list[str]]] = []

    def sides(i: int, j: int) -> list[str]:
        return ["left=" + _side(text, bounds[i][0] - 1, -1), "right=" + _side(text, bounds[j - 1][1], 1)]

    def number(i: int, j: int, groups: list[str], signs: str) -> None:
        digits = "".join(groups)
        n, plus = len(digits), word[i] == "+"
        common = [f"signs={''.join(sorted(set(signs)))}", f"plus={plus}", *sides(i, j)]
        if len(groups) == 4 and signs == "..." and is_digit[i]:
            out.append((i, j, 1, [f"octets={all(map(octet, groups))}", f"longest={max(map(len, groups))}", *common]))
        if 13 <= n <= 19 and is_digit[i] and all(c in " -" for c in signs) and len(signs) == len(groups) - 1:
            shape = "one" if len(groups) == 1 else "fours" if {len(g) for g in groups[:-1]} == {4} else "other"
            checked = luhn(digits)
            out.append((i, j, 2, [f"luhn={checked}", f"digits={n}", f"shape={shape}", f"luhn,shape={checked},{shape}", f"luhn,right={checked},{common[3]}", f"luhn,left={checked},{common[2]}", *common]))
        if 7 <= n <= 15 and len(groups) <= 6:
            lengths = "-".join(str(len(g)) for g in groups)
            bare = not plus and not signs
            out.append((i, j, 3, [f"digits={n}", f"groups={len(groups)}", f"lengths={lengths}", f"plus,digits={plus},{n}", f"bare={bare}", f"open={signs.count('(') == signs.count(')')}", f"plus,lengths={plus},{lengths}", *common]))

    for i in range(len(word)):
        if is_digit[i] or (word[i] in "+(" and i + 1 < len(word) and (is_digit[i + 1] or word[i] == "+" and word[i + 1] == "(")):
            groups, signs, n = [], "", 0
            for j in range(i, min(len(word), i + MAX_ATOMS)):
                if is_digit[j]:
                    n += len(word[j])
                    if n > 19:
                        break
                    groups.append(word[j])
                    if n >= 7 or len(groups) == 4:
                        number(i, j + 1, groups, signs)
                elif word[j] in " ().-" and (len(word[j]) == 1) and not signs.endswith("   "):
                    signs += word[j]
                elif not (j == i and word[j] == "+"):
                    break
        if is_name[i]:
            at = after = 0
            for j in range(i, min(len(word), i + MAX_ATOMS)):
                w = word[j]
                if w in _ATS:
                    if at:
                        break
                    at, after = j, 0
                elif at and w in _DOTS:
                    after += 1
                elif w == " ":
                    near = word[j - 1], word[j + 1] if j + 1 < len(word) else ""
                    if not any(len(x) > 1 and (x in _ATS or x in _DOTS) for x in near):
                        break
                elif not (is_name[j] or len(w) == 1 and w in _LOCAL or w in _DOTS):
                    break
                if at and after and is_name[j] and j > at:
                    last = w if word[j - 1] in _DOTS or word[j - 1] == " " else "-"
                    out.append((i, j + 1, 0, [f"written={len(word[at]) > 1}", f"top={min(len(last), 7) if last.isalpha() else 'odd'}", f"dots={min(after, 5)}", *sides(i, j + 1)]))
    return bounds, out


# ---- the model

_N = len(KINDS) + 1


@dataclass
class Model:
    """Weights of features (kind:feature) and of a label after another; label 0 is nothing."""

    weights: dict[str, float] = field(default_factory=dict)
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((_N, _N)))

    def score(self, kind: int, features: list[str]) -> float:
        get = self.weights.get
        return sum(get(f"{kind}:{f}", 0.0) for f in features) + get(f"{kind}:bias", 0.0)

    def spans(self, text: str, found: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the best segmentation of each region."""
        out = []
        for s, e in found:
            bounds, near = candidates(text, s, e)
            if near:
                out += [(bounds[i][0], k, bounds[j - 1][1]) for i, j, k in best_segments(len(bounds), [(i, j, k, self.score(k, f)) for i, j, k, f in near], self.transitions)]
        return out


def best_segments(n: int, scored: list[tuple[int, int, int, float]], transitions: np.ndarray) -> list[tuple[int, int, int]]:
    """The entities (first atom, end atom, kind) of the highest-scoring segmentation of n atoms."""
    t = transitions.tolist()
    at: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
    for i, j, k, score in scored:
        at[j].append((i, k + 1, score))
    best = [[-math.inf] * _N for _ in range(n + 1)]
    back: list[list] = [[None] * _N for _ in range(n + 1)]
    best[0][0] = 0.0
    for j in range(1, n + 1):
        for i, label, score in ((j - 1, 0, 0.0), *at[j]):
            row = best[i]
            for before in range(_N):
                value = row[before] + t[before][label] + score
                if value > best[j][label]:
                    best[j][label], back[j][label] = value, (i, before)
    j, label, out = n, max(range(_N), key=best[n].__getitem__), []
    while j:
        i, before = back[j][label]
        if label:
            out.append((i, j, label - 1))
        j, label = i, before
    return out[::-1]


def _expectations(n: int, spans: list[tuple[int, int, int]], scores: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The probability of each candidate, and expected counts of transitions, over all segmentations."""
    ends: list[list[int]] = [[] for _ in range(n + 1)]
    starts: list[list[int]] = [[] for _ in range(n + 1)]
    for c, (i, j, _) in enumerate(spans):
        ends[j].append(c)
        starts[i].append(c)
    raw = np.exp(t)

    def carried(a: np.ndarray, m: np.ndarray) -> np.ndarray:
        top = a.max()
        with np.errstate(divide="ignore"):
            return np.log(np.exp(a - top) @ m) + top

    alpha, into = np.full((n + 1, _N), -np.inf), np.full((n + 1, _N), -np.inf)
    alpha[0, 0] = 0.0
    into[0] = carried(alpha[0], raw)
    for j in range(1, n + 1):
        alpha[j, 0] = into[j - 1, 0]
        for c in ends[j]:
            i, _, k = spans[c]
            alpha[j, k + 1] = np.logaddexp(alpha[j, k + 1], into[i, k + 1] + scores[c])
        into[j] = carried(alpha[j], raw)
    total = np.logaddexp.reduce(alpha[n])
    beta, onward = np.zeros((n + 1, _N)), np.full((n + 1, _N), -np.inf)
    for i in range(n - 1, -1, -1):
        onward[i, 0] = beta[i + 1, 0]
        for c in starts[i]:
            _, j, k = spans[c]
            onward[i, k + 1] = np.logaddexp(onward[i, k + 1], scores[c] + beta[j, k + 1])
        beta[i] = carried(onward[i], raw.T)
    p = np.array([np.exp(into[i, k + 1] + scores[c] + beta[j, k + 1] - total) for c, (i, j, k) in enumerate(spans)])
    pairs = np.exp(alpha[:n, :, None] + t[None] + onward[:n, None, :] - total).sum(0)
    return p, pairs


def train(examples: list[tuple[str, list[tuple[int, int, int]]]], *, epochs: int = 6, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Model:
    """A model from texts with their true spans (start, kind, end). Regions whose true spans
    aren't among their candidates are left out."""
    index: dict[str, int] = {}
    ready = []
    for text, truth in examples:
        for s, e in regions(text):
            bounds, near = candidates(text, s, e)
            spans = [(i, j, k) for i, j, k, _ in near]
            first, end = ({b[x]: i + x for i, b in enumerate(bounds)} for x in (0, 1))
            gold = [(first.get(a), end.get(b), k) for a, k, b in truth if s <= a and b <= e]
            if not near or not set(gold) <= set(spans):
                continue
            rows = [[index.setdefault(f"{k}:{f}", len(index)) for f in (*features, "bias")] for _, _, k, features in near]
            width = max(map(len, rows))
            ready.append((len(bounds), spans, np.array([r + [-1] * (width - len(r)) for r in rows]), np.array([x in gold for x in spans], float), sorted(gold)))
    w, t = np.zeros(len(index) + 1), np.zeros((_N, _N))
    seen, seen_t = np.full(len(w), 1e-8), np.full(t.shape, 1e-8)
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(ready)
        for n, spans, rows, truth, gold in ready:
            p, pairs = _expectations(n, spans, w[rows].sum(1), t)
            up = np.zeros_like(t)
            at = before = 0
            for i, j, k in [*gold, (n, n, None)]:
                for _ in range(i - at):
                    up[before, 0] += 1
                    before = 0
                if k is not None:
                    up[before, k + 1] += 1
                    at, before = j, k + 1
            g = np.zeros_like(w)
            np.add.at(g, rows.ravel(), np.repeat(truth - p, rows.shape[1]))
            g -= decay * w
            seen += g * g
            w += rate * g / np.sqrt(seen)
            w[-1] = 0.0
            g = up - pairs - decay * t
            seen_t += g * g
            t += rate * g / np.sqrt(seen_t)
    return Model({f: float(w[i]) for f, i in index.items()}, t)


# ---- examples


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def _card(rng: random.Random, right: bool) -> str:
    body = rng.choice("3456") + _digits(rng, rng.choice([12, 13, 14, 14, 14, 14, 15, 18]) - 1)
    end = next(d for d in "0123456789" if luhn(body + d))
    whole = body + (end if right else str((int(end) + rng.randrange(1, 10)) % 10))
    joint = rng.choice(["", "", "", " ", "-"])
    return joint.join(whole[i : i + 4] for i in range(0, len(whole), 4))


def _email(rng: random.Random) -> str:
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9)))
    at, dot = rng.choice([("@", ".")] * 5 + [("[at]", "."), (" [at] ", " [dot] "), ("(at)", "(dot)")])
    local = name() + rng.choice(["", "." + name(), "." + _digits(rng, 2), "_" + name(), _digits(rng, 2), "+" + name()])
    return local + at + name() + rng.choice(["", _digits(rng, 1)]) + dot + rng.choice(["", name() + dot]) + rng.choice(["com", "org", "de", "info", "net"])


def _phone(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice([
        lambda: f"+1 ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{rng.randrange(1, 99)} {d(3)} {d(3)} {d(4)}", lambda: f"+{rng.randrange(20, 99)}{d(9)}", lambda: f"+{rng.randrange(20, 99)} {d(2)} {d(4)} {d(4)}",
        lambda: f"+1-{d(3)}-{d(3)}-{d(4)}", lambda: f"+{rng.randrange(20, 99)} ({d(2)}) {d(4)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}",
    ])()


def _other(rng: random.Random) -> str:
    d = lambda n: _digits(rng, n)
    return rng.choice([
        lambda: f"20{d(2)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02}", lambda: f"{rng.randrange(1, 29):02}.{rng.randrange(1, 13):02}.20{d(2)}", lambda: f"19{d(2)}-20{d(2)}", lambda: d(rng.randrange(7, 13)),
        lambda: ".".join(d(rng.randrange(1, 3)) for _ in range(rng.choice([3, 5, 6]))), lambda: f"{rng.randrange(300, 999)}.{d(3)}.{d(2)}.{d(2)}", lambda: f"{d(1)} {d(3)} {d(3)}", lambda: f"{rng.getrandbits(160):040x}",
        lambda: f"{d(4)}.{d(2)} - {d(4)}.{d(2)}", lambda: f"({d(4)}) {d(2)}", lambda: f"{rng.randrange(1, 9)}.{d(1)}.", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(8)}-{d(4)}", lambda: f"x{d(14)}", lambda: _card(rng, False), lambda: _card(rng, False),
    ])()


def generated(n: int, seed: int = 7) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made-up lines of one to three pieces, some side by side, with their spans."""
    rng = random.Random(seed)
    makers = [(0, _email), (1, lambda r: ".".join(str(r.randrange(256)) for _ in range(4))), (2, lambda r: _card(r, True)), (3, _phone)]
    out = []
    for _ in range(n):
        text, spans = rng.choice(["", "und ", "to (", "the. "]), []
        for _ in range(rng.choice([1, 1, 2, 3])):
            kind, make = rng.choice(makers) if rng.random() < 0.65 else (None, _other)
            piece = make(rng)
            if kind is not None:
                spans.append((len(text), kind, len(text) + len(piece)))
            text += piece + rng.choice([" ", " ", ", ", "; ", " and ", "! "])
        out.append((text + rng.choice(["", "end", "."]), spans))
    return out


# ---- on tables

_FOUND = "spans array<struct<start:int,kind:int,end:int,base:boolean>>"


def _sample(documents: DataFrame, text: Column) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Regions of a bounded number of documents, drawn by hash over all, with the plain patterns' spans."""
    n = documents.count()
    share = min(1.0, SAMPLE_DOCUMENTS / max(n, 1))
    drawn = documents.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = set()
            for x in batch.column(0):
                whole = x.as_py() or ""
                lines |= {whole[max(0, s - 3) : e + 3] for s, e in regions(whole) if e - s <= 100}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(lines), pa.string())], ["line"])

    lines = [r.line for r in drawn.mapInArrow(run, "line string").distinct().orderBy(F.xxhash64("line"), "line").limit(SAMPLE_REGIONS).collect()]
    out = []
    for line in lines:
        spans = plain_spans(line, regions(line))
        # patterns that run two things together are no examples
        clear = all(a[2] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and sum(map(str.isdigit, line)) <= 19
        if clear:
            out.append((line, spans))
    return out


def fit(documents: DataFrame, *, text_col: str = "text") -> Model:
    """A model from a bounded sample of ``documents`` and generated examples. Only texts are read."""
    return train(_sample(documents, F.col(f"`{text_col}`")) + generated(GENERATED))


def joined(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int, bool]]:
    """All plain spans, and those of the model that overlap none of their own kind."""
    taken: dict[int, list[tuple[int, int]]] = {}
    for s, k, e in base:
        taken.setdefault(k, []).append((s, e))
    out = [(s, k, e, True) for s, k, e in base]
    at = dict.fromkeys(taken, 0)
    for s, k, e in more:  # both in order of start, and spans of a kind don't overlap each other
        mine = taken.get(k, [])
        while mine and at[k] < len(mine) and mine[at[k]][1] <= s:
            at[k] += 1
        if not mine or at[k] == len(mine) or mine[at[k]][0] >= e:
            out.append((s, k, e, False))
    return sorted(out)


def find_personal_data(documents: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, spans: (start, kind as a place in KINDS, end, base) of each document, in order.

    ``base`` marks the plain patterns' spans; the model adds those that it finds elsewhere.
    Positions are code points, ends exclusive. Null and empty texts have none; every row is
    kept, repeated ones too; other columns are ignored. Time grows linearly with the text,
    also for endless runs of digits or signs.
    """

    @tidied
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(1):
                text = x.as_py() or ""
                found = regions(text)
                rows.append([dict(zip(("start", "kind", "end", "base"), s, strict=True)) for s in joined(plain_spans(text, found), model.spans(text, found))])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, {_FOUND}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the number of plain spans of each kind, base_sha256, and all spans as text."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    listed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["base"])
    of_kind = lambda k: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == k)))
    counts = [of_kind(k).cast("long").alias(f"n_{n}") for k, n in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def masked(documents: DataFrame, found: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text with each span replaced by its kind in angle brackets; ``found`` has one row an id."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = F.coalesce(F.col("text"), F.lit(""))
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    # a span within one that was replaced already adds nothing
    step = lambda a, x: F.when(x["start"] < a["at"], a).otherwise(F.struct(x["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, x["start"] - a["at"]), F.lit("<"), name(x["kind"]), F.lit(">")).alias("out")))
    end = F.aggregate("spans", state, step)
    source = documents.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.join(found, "doc_id").withColumn("end", end).select("doc_id", F.concat("end.out", F.substring(text, F.col("end.at") + 1, F.length(text))).alias("text"))
