"""Personal data: fixed patterns, and boosted trees over the spans that high-recall generators propose.

``base_spans`` finds what the fixed patterns define (emails, IPs, card and phone numbers); those spans always stay. The
generators propose overlapping candidates of five kinds (the four and ``secret``: keys, tokens, passwords). A boosted-tree
model for each kind scores format and context features of a candidate; candidates at or above the kind's calibrated
threshold are added, best first, where they overlap neither a base span nor a better candidate.

There are no labelled spans, so the models are trained on generated examples (``EXAMPLES`` of each kind, fixed seed):
well-formed data in several spellings against look-alikes, some of which only the words around them tell apart: version,
order, part and reference numbers in the shape of phones and IPs, digits that fail the checks, dates, sums, hashes of
files, unique ids, long words. A threshold is the lowest score above which ``PRECISION`` of held-out candidates are right.
The work is one pass over the texts; nothing is shuffled or collected.

Defined results: a null text is empty and has no spans; very long texts are read whole, in time in proportion to their
length; ties in likelihood go to the span that begins first, then the longer one, then the kind named first; positions are code points, ends exclusive; repeated rows each
give a row; a null doc_id stays null; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foliolens.llm.boosting import BoostedTrees
from foliolens.llm.common import sliced, texts

KINDS = ("email", "ip", "card", "phone", "secret")
EXAMPLES = 1200
PRECISION = 0.995
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
Span = tuple[str, int, int]

#: The base patterns, written so that no text makes them slow.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            yield "email", start, done
            at = text.find("@", done)
        else:
            done, at = at + 1, text.find("@", at + 1)


def base_spans(text: str) -> list[Span]:
    """The spans of the fixed patterns, by start and then kind."""
    out = list(_emails(text)) if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split("."))]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_by_start)


def _by_start(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


# ---- candidates

#: No length is limited: every part is taken whole, and none can start within another, so a text is read once.
_MAIL = re.compile(r"""(?<![^\s<>()\[\],;:"'@])(?=([^\s<>()\[\],;:"'@]++@[^\s<>()\[\],;:"'@]++))""")
_SPELLED_MAIL = re.compile(r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++[ ]?[\[({][ ]?at[ ]?[\])}][ ]?[A-Za-z0-9.-]++(?:[ ]?[\[({][ ]?dot[ ]?[\])}][ ]?[A-Za-z]{2,}+)?")
_STRETCH = re.compile(r"[+(]{0,2}[0-9][0-9 ().-]*+")
_GROUP = re.compile(r"[0-9]++")
#: Digits of a candidate number, by kind; an IP has four groups and up to twelve digits instead.
DIGITS = {"card": (12, 19), "phone": (7, 15)}
MOST_DIGITS = max(most for _, most in DIGITS.values())
#: Candidates scored at a time; bounds memory on texts full of numbers.
SCORED = 1 << 15
_NAMED = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth)[\"']?[ ]{0,2}[=:][ ]{0,2}[\"']?[^\s\"',;]{6,}+[\"']?")
_RANDOM = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}(?![A-Za-z0-9_+/-])")
_HINTS = {
    "email": re.compile(r"(?i)mail|contact|@"), "ip": re.compile(r"(?i)\bip\b|host|server|addr"), "card": re.compile(r"(?i)card|visa|credit|carte|tarjeta"),
    "phone": re.compile(r"(?i)phone|tel|call|mobile|fax"), "secret": re.compile(r"(?i)pass|pwd|secret|token|key|auth|AKIA"),
}
_OTHER = re.compile(r"(?i)version|release|\bv ?$|isbn|order|invoice|page|ref|part|item|commit|digest|sha|md5|uuid|file|build|section|no\.|#|\$|€|£|http|www|/")


def numbers(text: str) -> Iterator[Span]:
    """Every run of consecutive digit groups of a kind's size, with the brackets and the plus sign before it. Groups are
    consecutive if only blanks, dots, brackets and hyphens, any number of them, lie between; letters may not touch a run."""
    for m in _STRETCH.finditer(text):
        groups = [g.span() for g in _GROUP.finditer(text, *m.span())]
        for i, (start, _) in enumerate(groups):
            a = start
            while a and start - a < 2 and text[a - 1] in "+(":
                a -= 1
            if a and (text[a - 1].isalpha() or text[a - 1] == "_"):
                continue
            n, j = 0, i
            while j < len(groups) and n + (b := groups[j][1]) - groups[j][0] <= MOST_DIGITS:
                n += b - groups[j][0]
                j += 1
                if b == len(text) or not (text[b].isalpha() or text[b] == "_"):
                    if j - i == 4 and n <= 12:
                        yield "ip", a, b
                    yield from ((k, a, b) for k, (least, most) in DIGITS.items() if least <= n <= most)


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans; one stretch of text may be proposed for several kinds."""
    out: list[tuple[str, int, int]] = []
    if "@" in text:
        for m in _MAIL.finditer(text):
            whole = m[1].rstrip(".-!?")
            if whole[-1] != "@":
                out.append(("email", m.start(), m.start() + len(whole)))
    if "at" in text and re.search(r"[\[({]", text):
        out += [("email", *m.span()) for m in _SPELLED_MAIL.finditer(text)]
    if _DIGIT.search(text):
        out += numbers(text)
        out += [("secret", *m.span()) for m in _RANDOM.finditer(text) if _DIGIT.search(m[0])]
    if "=" in text or ":" in text:
        out += [("secret", *m.span()) for m in _NAMED.finditer(text)]
    return out


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    s, before, after = text[start:end], text[max(0, start - 24) : start], text[end : end + 12]
    digits, parts = _digits(s), [p for p in re.split(r"[^0-9]+", s) if p]
    n = len(s)
    counts: dict[str, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    domain = s.rpartition("@")[2]
    return [
        n, len(digits), sum(c.isalpha() for c in s), sum(c.isupper() for c in s), s.count("."), s.count("-"), s.count(" "), s.count("("), s.count("@"),
        -sum(v / n * math.log2(v / n) for v in counts.values()), switches, len(parts), max(map(len, parts), default=0), min(map(len, parts), default=0),
        float(luhn(digits)) if digits else 0.0, float(len(parts) == 4 and s.count(".") == 3 and all(len(p) <= 3 and int(p) <= 255 for p in parts)),
        float(s[0] == "+"), float(s[0] in "(0"), float("." in domain and domain.rpartition(".")[2].isalpha()), float("=" in s or ":" in s),
        float(bool(re.search(r"(?i)[\[({] ?at", s))), float(bool(_HINTS[kind].search(before + s[:12]))), float(bool(_OTHER.search(before))),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(any(c.islower() for c in s)), len(digits) / n,
        *_beside(before[::-1]), *_beside(after), s.count(")"), len(parts[-1]) if parts else 0, len(parts[0]) if parts else 0,
    ]


_NEAR = re.compile(r"[ ().-]{0,3}([0-9]+)")


def _beside(text: str) -> tuple[float, float, float]:
    """The digits of the group that text begins with, the characters before it, and whether a bracket or plus sign is near."""
    m = _NEAR.match(text)
    return float(len(m[1])) if m else 0.0, float(m.start(1)) if m else 9.0, float(text[:1] in ("(", "+", ")", ".", "-"))


# ---- training examples

def _luhn_number(r: random.Random, n: int) -> str:
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(body + d for d in "0123456789" if luhn(body + d))


def _word(r: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(r.choice("etaoinshrdlucmfwypvbgk") for _ in range(r.randint(least, most)))


def _number(r: random.Random, *sizes: int, sep: str = "") -> str:
    return sep.join("".join(r.choice("0123456789") for _ in range(n)) for n in sizes)


def _positive(r: random.Random, kind: str) -> str:
    if kind == "email":
        name, host = f"{_word(r)}{r.choice(['', '.', '_'])}{_word(r, 1)}{r.choice(['', str(r.randint(1, 99))])}", f"{_word(r)}{r.choice(['', str(r.randint(0, 9))])}"
        return r.choice([f"{name}@{host}.{r.choice(['com', 'org', 'de', 'example.com'])}", f"{name} [at] {host} [dot] com", f"{name}(at){host}.org"])
    if kind == "ip":
        return ".".join(str(r.randint(1, 255)) for _ in range(4))
    if kind == "card":
        d = _luhn_number(r, r.choice([15, 16, 16]))
        return r.choice([d, " ".join(d[i : i + 4] for i in range(0, len(d), 4)), "-".join(d[i : i + 4] for i in range(0, len(d), 4))])
    if kind == "phone":
        a, b, c = _number(r, 3), _number(r, 3), _number(r, 4)
        return r.choice([f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(20, 99)} {_number(r, 2, 4, 4, sep=' ')}", f"{a}.{b}.{c}"])
    hexes = "".join(r.choice("0123456789abcdef") for _ in range(r.choice([18, 32, 40])))
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    mixed = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(r.randint(20, 44)))
    return r.choice([f"password={hexes[:18]}", f'token = "{hexes}"', f"AKIA{key}", f"api_key: {mixed}", f"secret={mixed[:16]}", hexes, mixed])


def _hexes(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789abcdef") for _ in range(n))


def _look_alike(r: random.Random) -> str:
    """The shape of personal data, which the word before it denies."""
    name = r.choice(["order", "ref", "ref no.", "part", "invoice", "item #", "page", "build"])
    return r.choice([
        lambda: f"{name} {_number(r, 3, 3, 4, sep=r.choice('-. '))}", lambda: f"{name} {_number(r, 4, 4, 4, 4, sep=r.choice('- '))}", lambda: f"{name} {_number(r, r.randint(10, 16))}",
        lambda: f"version {r.randint(0, 30)}.{r.randint(0, 30)}.{r.randint(0, 99)}.{r.randint(0, 255)}", lambda: f"section {r.randint(1, 20)}.{r.randint(1, 20)}.{r.randint(1, 9)}.{r.randint(1, 9)}",
        lambda: f"commit {_hexes(r, 40)}", lambda: f"sha256 digest {_hexes(r, 64)}", lambda: f"md5 {_hexes(r, 32)}", lambda: f"file {_word(r)}_{_number(r, 8, 9, sep='_')}",
        lambda: f"uuid {_hexes(r, 8)}-{_hexes(r, 4)}-{_hexes(r, 4)}-{_hexes(r, 4)}-{_hexes(r, 12)}", lambda: f"isbn 978-{_number(r, 1, 3, 5, 1, sep='-')}",
    ])()


def _negative(r: random.Random) -> str:
    if r.random() < 0.4:
        return _look_alike(r)
    return r.choice([
        lambda: f"version {_number(r, 1, 1, 1, 2, sep='.')}", lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2030)}",
        lambda: f"order {_number(r, r.randint(7, 12))}", lambda: f"isbn 978-{_number(r, 1, 4, 4, 1, sep='-')}", lambda: f"${_number(r, 3)}.{_number(r, 2)}", lambda: _number(r, r.randint(7, 9)),
        lambda: f"{_number(r, 4)} {_number(r, 4)} {_number(r, 4)}", lambda: f"{_word(r)}-{_word(r)}-{_word(r)}-{_word(r)}", lambda: f"@{_word(r)}", lambda: f"{_word(r)} @ {_word(r)}", lambda: _word(r, 16, 24) + r.choice(["", "7"]),
        lambda: f"http://{_word(r)}.org/{_word(r)}/{_number(r, 6)}/{_word(r)}", lambda: f"{r.randint(256, 999)}.{_number(r, 3, 3, 3, sep='.')}", lambda: f"token: {_word(r)}", lambda: f"{_number(r, 3, 3, 3, sep=' ')}",
        lambda: f"password: {_word(r, 6, 9)} {_word(r)}", lambda: f"{_number(r, 20)}", lambda: f"{_word(r)}@{_word(r)}", lambda: f"({_word(r)}) {_number(r, 4)}-{_number(r, 4)}", lambda: f"{_number(r, 1, 3, 3, 3, sep='.')}.00",
        lambda: next(d for _ in range(99) if not luhn(d := _number(r, 16))), lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02} {r.randint(0, 23):02}:{r.randint(0, 59):02}:{r.randint(0, 59):02}",
        lambda: f"{_word(r)}/{_word(r)}/{_word(r)}{r.randint(1, 99)}/{_word(r)}", lambda: f"{_word(r, 8, 12)}_{_word(r, 6, 10)}_{r.randint(1, 9)}",
    ])()


def _neighbour(r: random.Random) -> str:
    """A number beside an example, with a blank between them."""
    return r.choice([
        lambda: _positive(r, "phone"), lambda: _positive(r, "card"), lambda: _positive(r, "ip"), lambda: str(r.randint(1, 99)), lambda: _number(r, 4),
        lambda: f"{r.randint(1990, 2030)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: f"{r.randint(1, 28):02}.{r.randint(1, 12):02}.{r.randint(1990, 2030)}",
    ])()


_LEADS = {"email": "mail to", "ip": "host", "card": "card", "phone": "call", "secret": "key"}


@lru_cache(maxsize=1)
def models(examples: int = EXAMPLES, precision: float = PRECISION) -> dict[str, BoostedTrees]:
    """A calibrated model for each kind; a third of the examples is held out for the calibration."""
    r = random.Random(11)
    rows: dict[str, list[tuple[list[float], float]]] = {k: [] for k in KINDS}
    for i in range(examples * len(KINDS) * 2):
        kind = KINDS[i % len(KINDS)] if i % 2 else None
        s = _positive(r, kind) if kind else _negative(r)
        lead = _LEADS[kind] + " " if kind and r.random() < 0.3 else ""
        before, after = (_neighbour(r) if r.random() < 0.25 else "" for _ in range(2))
        text = f"{_word(r)} {_word(r)}{r.choice([' ', ', ', '. '])}{lead}{before}{' ' * bool(before)}"
        start = len(text)
        text += f"{s}{' ' * bool(after)}{after}{r.choice([' ', '. ', ', '])}{_word(r)}"
        for k, a, b in candidates(text):
            if b > start and a < start + len(s):
                whole = kind == k and start <= a <= start + 1 and start + len(s) - 1 <= b <= start + len(s) + (k == "secret")
                rows[k].append((features(text, k, a, b), float(whole)))
    out = {}
    for k, own in rows.items():
        x, y = np.array([f for f, _ in own]), np.array([t for _, t in own])
        held = np.arange(len(y)) % 3 == 0
        out[k] = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held], precision)
    return out


def find(rows: list[str], trained: dict[str, BoostedTrees]) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans of each text."""
    base = [base_spans(t) for t in rows]
    proposed = [(i, *c) for i, t in enumerate(rows) for c in dict.fromkeys(candidates(t))]
    accepted: dict[int, list[tuple[float, Span]]] = {}
    for kind in KINDS:
        own = [(i, a, b) for i, k, a, b in proposed if k == kind]
        if own:
            p = [trained[kind].probability(np.array([features(rows[i], kind, a, b) for i, a, b in part])) for part in sliced(own, SCORED)]
            for (i, a, b), score in zip(own, np.concatenate(p).tolist(), strict=True):
                if score >= trained[kind].threshold:
                    accepted.setdefault(i, []).append((score, (kind, a, b)))
    out = []
    for i, spans in enumerate(base):
        taken = list(spans)
        for _, s in sorted(accepted.get(i, ()), key=lambda x: (-x[0], x[1][1], x[1][1] - x[1][2], KINDS.index(x[1][0]))):
            if all(s[2] <= a or s[1] >= b for _, a, b in taken):
                taken.append(s)
        out.append((spans, sorted(taken, key=_by_start)))
    return out


def redact(text: str, spans: list[Span]) -> str:
    """text with each stretch that spans cover replaced by the upper-case kind of its first span, in angle brackets."""
    out, done, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        k += 1
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[done:a], f"<{kind.upper()}>"]
        done = b
    return "".join([*out, text[done:]])


def find_pii(docs: DataFrame) -> DataFrame:
    """One row for every row of docs(doc_id, text): base counts, the digest of the base spans, and all spans."""
    trained = docs.sparkSession.sparkContext.broadcast(models())

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = find(texts(b.column("text")), trained.value)
            counts = [pa.array([sum(k == kind for k, _, _ in base) for base, _ in spans], pa.int64()) for kind in KINDS[:4]]
            digests = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in spans], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *counts, digests, pa.array([joined(x) for _, x in spans], pa.string())], names=["doc_id", *(f"n_{k}" for k in KINDS[:4]), "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(found, SCHEMA)


def redacted(docs: DataFrame) -> DataFrame:
    """docs with the found spans of text redacted; null texts stay null; all columns and rows are kept."""
    trained = docs.sparkSession.sparkContext.broadcast(models())
    kind = docs.schema

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("text").to_pylist()
            spans = find([t or "" for t in own], trained.value)
            new = pa.array([t if t is None else redact(t, x) for t, (_, x) in zip(own, spans, strict=True)], b.column("text").type)
            yield b.set_column(b.schema.get_field_index("text"), "text", new)

    return docs.mapInArrow(replace, kind)
