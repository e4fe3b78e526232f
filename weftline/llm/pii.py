"""Personal data: four exact patterns, and a semi-Markov conditional random field that adds spans to them.

The patterns (email, ip, card, phone) are found first and always stay. The model then reads every stretch of
words that hold a digit or an @. It scores whole candidate segments - their shape, number of digits, check
digit, address parts, the words before them - and a dynamic programme over segments of at most MAX_ATOMS
atoms chooses boundaries and types together. What it chooses is added where it overlaps no pattern's span:
numbers without a country code, masked addresses, and keys or tokens (kind secret).
Bounds of what is added: a segment has at most MAX_ATOMS atoms (runs of letters and digits, of any length, or single
other characters), and stretches without a digit or an @ are not read, so all-letter secrets get no added span.

The model is trained by stochastic gradient on the log-likelihood, from generated examples and from patterns
in at most TRAIN_ROWS documents (those whose hash falls under a threshold); finding reads all rows. One pass,
no shuffle; the weights (a few thousand) travel with the task.

Defined results: null text counts as empty and has no spans; rows are treated alone, so ties, repeated and
null doc_ids give a row each; an empty table gives no rows; other columns are ignored. Texts of any length
are read whole, in time proportional to their length; candidate segments and their features are held for one atom
at a time, and of the rest only a few numbers an atom.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, text_or_empty
from .quality_rules import sampled

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_ATOMS = 20
TRAIN_ROWS = 1500
EPOCHS = 6

# ---------------------------------------------------------------------------------------------- patterns

#: The characters and patterns of the four kinds. The look-behinds only keep the search linear:
#: where a match can't begin at the start of a run of digits, it can't begin inside it either.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_LETTER = re.compile(r"[^A-Za-z]+")
_NOT_HEX = re.compile(r"[^0-9a-fA-F]")
_ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        v = int(d) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def octets(text: str) -> bool:
    return all(len(x) <= 3 and int(x) <= 255 for x in (p.lstrip("0") or "0" for p in text.split(".")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start, end (code points, end exclusive) by kind, then start."""
    out: list[tuple[str, int, int]] = []
    end, last, at = 0, 0, text.find("@")
    while at >= 0:
        left = text[max(end, last) : at]
        start = at - (len(left) - len(left.rstrip(_LOCAL)))
        last = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            end = m.end()
            out.append(("email", start, end))
        at = text.find("@", last)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if octets(m[0])]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ------------------------------------------------------------------------------------------------- model

_ATOM = re.compile(r"[A-Za-z0-9]+|\s|[^A-Za-z0-9\s]")
_SHAPE = [(re.compile(r"[0-9]+"), lambda m: f"9{min(len(m[0]), 20)}"), (re.compile(r"[A-Za-z]+"), "a")]
_NUMERIC = frozenset("0123456789 ().-+")


def clusters(text: str):
    """Stretches of words with a digit or @, one space apart: start, end, the two words before."""
    words, run, before = ("", ""), None, ("", "")
    for m in WORD.finditer(text):
        if _ANCHOR.search(m[0]):
            if run and m.start() == run[1] + 1 and text[run[1]] == " ":
                run = (run[0], m.end())
            else:
                if run:
                    yield (*run, before)
                run, before = m.span(), words
        words = (words[1], m[0].lower()[:24])
    if run:
        yield (*run, before)


def kinds_of(segment: str) -> list[str]:
    """Types that a segment can have at all."""
    digits = len(_NOT_DIGIT.sub("", segment))
    if segment.count("@") == 1 and " " not in segment:
        return ["email"]
    if "@" in segment or not digits:
        return []
    found = []
    if set(segment) <= _NUMERIC:
        if segment.count(".") == 3 and digits + 3 == len(segment):
            found.append("ip")
        if 12 <= digits <= 19 and segment[0].isdigit() and "." not in segment:
            found.append("card")
        if 7 <= digits <= 15:
            found.append("phone")
    elif len(segment) >= 16 and " " not in segment and segment[0].isalnum():
        found.append("secret")
    return found


def features(segment: str, kind: str, before: tuple[str, str], left: str, right: str) -> list[str]:
    """Of the whole span: its shape, its digits, checks, and what stands beside it."""
    digits = _NOT_DIGIT.sub("", segment)
    out = ["bias", f"digits{min(len(digits), 20)}", f"left{left}", f"right{right}", f"word{before[1][:12]}", f"first{segment[0] if not segment[0].isalnum() else 'x'}"]
    if kind in ("email", "secret"):
        out += [f"length{min(len(segment) // 8, 8)}", f"mix{min(9, 10 * len(digits) // len(segment))}", f"hex{not _NOT_HEX.search(segment)}", f"word2{before[0][:12]}", f"dots{min(segment.count('.'), 4)}"]
        out.append(f"tld{'.' in segment.partition('@')[2] and segment[-1].isalpha()}" if kind == "email" else f"letters{min(len(_NOT_LETTER.sub('', segment)) // 4, 6)}")
    else:
        shape = segment
        for pattern, to in _SHAPE:
            shape = pattern.sub(to, shape)
        out += [f"shape{shape}", f"separators{len(set(segment) - set('0123456789'))}"]
        if kind == "card":
            out.append(f"luhn{luhn(digits)}|{len(digits) >= 16}")
        if kind == "ip":
            out.append(f"octets{octets(segment)}")
        if kind == "phone":
            out.append(f"plus{segment[0] == '+'}|{len(digits) >= 10}")
    return [f"{kind}:{x}" for x in out]


def atoms_of(text: str, start: int, end: int) -> tuple[array, array]:
    """Starts and ends of a cluster's atoms."""
    starts, ends = array("q"), array("q")
    for m in _ATOM.finditer(text, start, end):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def segments_at(text: str, starts: array, ends: array, i: int, before: tuple[str, str]) -> list[tuple[int, str, list[str]]]:
    """Candidate segments that begin at atom i: (end atom, kind, features)."""
    a, own = starts[i], []
    if not (text[a].isalnum() or text[a] in "+("):
        return own
    left = text[a - 1] if a else "^"
    if left.isalnum():
        left = "x"
    previous = before if i == 0 or text[a - 1] in "\"'" and i == 1 else ("", "")
    for j in range(i, min(i + MAX_ATOMS, len(starts))):
        b = ends[j]
        if not text[b - 1].isalnum():
            continue
        segment = text[a:b]
        right = text[b] if b < len(text) else "$"
        for kind in kinds_of(segment):
            own.append((j + 1, kind, features(segment, kind, previous, left, "x" if right.isalnum() else right)))
    return own


def lattice(text: str, start: int, end: int, before: tuple[str, str]):
    """Atoms of a (short) cluster, and by atom the candidate segments that begin there."""
    starts, ends = atoms_of(text, start, end)
    return list(zip(starts, ends, strict=True)), [segments_at(text, starts, ends, i, before) for i in range(len(starts))]


def _scores(edges, weights):
    return [[(j, kind, f, sum(weights.get(x, 0.0) for x in f)) for j, kind, f in own] for own in edges]


def decode(text: str, cluster, weights: dict[str, float]) -> list[tuple[str, int, int]]:
    """The segmentation of highest score; an atom outside any entity scores 0."""
    start, end, before = cluster
    starts, ends = atoms_of(text, start, end)
    n = len(starts)
    best, back, kinds = array("d", [0.0]) + array("d", [-math.inf]) * n, array("q", [0]) * (n + 1), array("b", [-1]) * (n + 1)
    for i in range(n):
        if best[i] > best[i + 1]:
            best[i + 1], back[i + 1], kinds[i + 1] = best[i], i, -1
        for j, kind, f in segments_at(text, starts, ends, i, before):
            s = best[i] + sum(weights.get(x, 0.0) for x in f)
            if s > best[j]:
                best[j], back[j], kinds[j] = s, i, KINDS.index(kind)
    out, at = [], n
    while at:
        i = back[at]
        if kinds[at] >= 0:
            out.append((KINDS[kinds[at]], starts[i], ends[at - 1]))
        at = i
    return out[::-1]


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def step(text: str, cluster, gold: list[tuple[str, int, int]], weights: dict[str, float], rate: float) -> None:
    """One gradient step: features of the true segments minus their expectation over all segmentations."""
    atoms, edges = lattice(text, *cluster)
    if not any(edges):
        return
    n, scored = len(atoms), _scores(edges, weights)
    fore, aft = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
    for i, own in enumerate(scored):
        fore[i + 1] = _log_add(fore[i + 1], fore[i])
        for j, _, _, s in own:
            fore[j] = _log_add(fore[j], fore[i] + s)
    for i in range(n - 1, -1, -1):
        aft[i] = aft[i + 1]
        for j, _, _, s in scored[i]:
            aft[i] = _log_add(aft[i], aft[j] + s)
    truth = set(gold)
    for i, own in enumerate(scored):
        for j, kind, f, s in own:
            delta = ((kind, atoms[i][0], atoms[j - 1][1]) in truth) - math.exp(fore[i] + s + aft[j] - fore[n])
            if abs(delta) > 1e-4:
                for x in f:
                    weights[x] = weights.get(x, 0.0) * (1 - 1e-3 * rate) + rate * delta


#: Fixed value: assignments of keys, whose right sides teach the kind secret.
_KEY = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|key)\b['\"]?\s*[:=]\s*['\"]?([A-Za-z0-9_-]{16,})")


def silver(text: str) -> list[tuple[str, int, int]]:
    return base_spans(text) + [("secret", *m.span(1)) for m in _KEY.finditer(text)]


def generated(n: int = 500, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Sentences with one entity or one thing that only looks like one."""
    rnd, out = random.Random(seed), []
    number = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    word = lambda k=5: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))

    def card() -> str:
        d = number(15)
        return next(d + c for c in "0123456789" if luhn(d + c))

    for k in range(n):
        c, p = card(), number(10)
        kind, text = [
            ("email", f"{word()}.{word(3)}{number(2)}@{word(6)}.{word(3)}"),
            ("email", f"{word()}@{word(4)}.{word(2)}"),
            ("ip", ".".join(str(rnd.randrange(256)) for _ in range(4))),
            ("card", c),
            ("card", rnd.choice(" -").join(c[i : i + 4] for i in range(0, 16, 4))),
            ("phone", f"+{number(1)} ({p[:3]}) {p[3:6]}-{p[6:]}"),
            ("phone", f"+{number(2)} {p[:3]} {p[3:6]} {p[6:]}"),
            ("phone", f"({p[:3]}) {p[3:6]}-{p[6:]}"),
            ("phone", f"{p[:3]}-{p[3:6]}-{p[6:]}"),
            ("secret", "".join(rnd.choice("0123456789abcdef") for _ in range(rnd.choice((32, 40, 64))))),
            ("", number(rnd.randrange(1, 16))),
            ("", f"20{number(2)}-0{rnd.randrange(1, 10)}-1{number(1)}"),
            ("", f"{number(2)}.{number(1)}.{number(2)}.{rnd.randrange(300, 999)}"),
            ("", f"{number(2)},{number(3)}.{number(2)}"),
            ("", f"{word(4)}{number(3)}"),
            ("", f"{number(3)} {number(4)} {number(3)} {number(2)}"),
            ("", f"@{word(8)}"),
            ("", f"{word(12)}-{word(9)}-{number(4)}"),
        ][k % 18]
        before = rnd.choice(["token = ", 'secret: "', "key = "]) if kind == "secret" else rnd.choice(["", "at ", "call ", "see "])
        full = f"{word()} {before}{text}{rnd.choice(['', '.', ',', '###', '***'])} {word()}"
        at = full.index(text, len(before))
        out.append((full, [(kind, at, at + len(text))] if kind else []))
    return out


def train(texts: list[str], epochs: int = EPOCHS, seed: int = 7) -> dict[str, float]:
    examples = [*generated(), *((t, silver(t)) for t in texts)]
    steps = [(t, c, [g for g in gold if c[0] <= g[1] and g[2] <= c[1]]) for t, gold in examples for c in clusters(t)]
    weights: dict[str, float] = {}
    for epoch in range(epochs):
        random.Random(seed + epoch).shuffle(steps)
        for text, cluster, gold in steps:
            step(text, cluster, gold, weights, 0.3 / (1 + epoch))
    return weights


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> dict[str, float]:
    """Weights from generated examples and the stretches around digits in at most about `rows` documents."""

    def near(batches):
        for batch in batches:
            found = [t[max(0, a - 60) : b + 20] for t in batch.column(1).to_pylist() for a, b, _ in clusters(t) if b - a < 200]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["text"])

    found = sampled(text_or_empty(docs), rows).mapInArrow(near, "text string").orderBy(F.xxhash64("text"), "text").limit(rows).collect()
    return train(sorted(r.text for r in found))


# ---------------------------------------------------------------------------------------------- operator


def spans_of(text: str, weights: dict[str, float]) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, by kind and then start."""
    if not _ANCHOR.search(text):
        return [], []
    base = base_spans(text)
    taken, added = sorted((a, b) for _, a, b in base), []
    firsts, lasts = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))  # furthest end so far
    for cluster in clusters(text):
        for kind, a, b in decode(text, cluster, weights):
            at = bisect_left(firsts, b)
            if not at or lasts[at - 1] <= a:
                added.append((kind, a, b))
    rank = {k: i for i, k in enumerate(KINDS)}
    return base, sorted([*base, *added], key=lambda s: (rank[s[0]], s[1]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
            at = b
        elif b > at:
            at = b
    return "".join([*out, text[at:]])


def find_pii(docs: DataFrame, weights: dict[str, float] | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, counts of base spans, their digest, all spans, and the text with spans replaced by kinds if asked for."""
    weights = fit(docs) if weights is None else weights

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for text in batch.column(1).to_pylist():
                base, spans = spans_of(text, weights)
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE]
                digest = hashlib.sha256(written(base).encode()).hexdigest()
                for column, value in zip(out, [*counts, digest, written(spans), redacted(text, spans) if with_text else None], strict=True):
                    column.append(value)
            types = [*[pa.int64()] * 4, *[pa.string()] * 3]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "redacted"])

    found = text_or_empty(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string")
    return found if with_text else found.drop("redacted")
