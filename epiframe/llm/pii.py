"""Personal data: generators of high recall propose spans, boosted trees on format and context select them.

Base spans are exact patterns of e-mail, IP, card and phone numbers, and always stay. Further generators
propose overlapping candidates (spelled-out e-mails, local phone numbers, numbers after identifying words,
keyed secrets, long random strings, account numbers); gradient-boosted trees score each by its format and the
words before it, Platt scaling calibrates the scores on held-out examples, and a threshold per kind, set for
precision, selects. Selected candidates that overlap a base span or a better candidate go; of a secret around
whole base spans, such as a long key with a run of digits that makes a card number, what lies beside them stays.

The trees are trained on the driver from ``EXAMPLES`` examples that a seeded generator writes; no corpus row is
needed. Matching is linear in the text: every scan starts at a run's first character and never goes back.

Edge cases: null text counts as empty for the query, and stays null when redacted; texts of any length are read
whole; repeated rows give repeated results; extra columns pass through ``redact``; empty tables give empty ones.
"""

from __future__ import annotations

import functools
import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.boosting import BoostedTrees, platt
from epiframe.llm.common import table

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans of one start are listed.
KINDS = (*BASE_KINDS, "account", "secret")
EXAMPLES, SEED, PRECISION = 6000, 11, 0.98

Span = tuple[int, int, str]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_card = re.compile(r"[0-9](?:[ -]?[0-9])++")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        k = ord(d) - 48
        total += k if i % 2 == 0 else k * 2 - 9 * (k > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The exact patterns, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:  # the local part of a match is the run before its @, back to the match before
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _domain.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append((start, end, "email"))
        at = text.find("@", max(at + 1, end))
    for m in _ip.finditer(text):
        if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in _card.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    for m in _phone.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((*m.span(), "phone"))
    return out


#: Generators of candidates: name, kind, pattern; group 1 is the span. A character class before each keeps a
#: scan from starting within a run.
_GENERATORS = tuple((name, kind, re.compile(p, re.A)) for name, kind, p in (
    ("spelled_email", "email", r"(?i)(?<![\w.+-])([\w.+-]++ ?[(\[{]? ?at ?[)\]}]? ?[a-z0-9-]++(?: ?[(\[{] ?dot ?[)\]}] ?[a-z0-9-]++| dot [a-z0-9-]++)+)(?![\w])"),
    ("local_phone", "phone", r"(?<![\w+.-])(\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![\w-])"),
    ("named_number", "phone", r"(?i)\b(?:phone|tel|mobile|call|fax)\b[.:# ]{0,3}([0-9(][0-9 ().-]{5,20}[0-9])(?![\w-])"),
    ("dashed_number", "account", r"(?<![\w-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"),
    ("iban", "account", r"(?<!\w)([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?!\w)"),
    ("keyed", "secret", r"(?i)\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>,;]{6,}+)"),
    ("random", "secret", r"(?<![\w/+=-])([A-Za-z0-9_+=-]{24,}+)(?![\w/+=-])"),
))
_NEEDS = {"spelled_email": re.compile(r"(?i)\bdot\b"), "keyed": re.compile(r"[=:]")}
_CONTEXT = tuple(frozenset(w.split()) for w in ("mail email contact write e-mail", "phone tel mobile call fax telephone", "ssn social security iban account konto passport", "token key secret password passwd pwd api apikey credential", "version isbn order invoice item page figure table part serial model build commit revision"))
_word = re.compile(r"[A-Za-z-]+")


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, generator) of every proposal; they may overlap."""
    out = []
    for name, kind, pattern in _GENERATORS:
        if name in _NEEDS and not _NEEDS[name].search(text):
            continue
        out += [(*m.span(1), kind, name) for m in pattern.finditer(text)]
    return out


def features(text: str, start: int, end: int, name: str) -> list[float]:
    s, before = text[start:end], text[max(0, start - 40) : start]
    n = len(s)
    digits, upper, lower = sum("0" <= c <= "9" for c in s), sum("A" <= c <= "Z" for c in s), sum("a" <= c <= "z" for c in s)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(s).values())
    groups = [len(g) for g in re.findall("[0-9]+", s)] or [0]
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))
    words = {w.lower() for w in _word.findall(before)[-4:]}
    out = [n, digits, digits / n, upper / n, lower / n, (n - digits - upper - lower) / n, entropy, len(groups), max(groups), groups[0], groups[-1], switches / n, float(len(set(s))), float(set(s.lower()) <= set("0123456789abcdef")), float("@" in s), float(before[-2:].strip()[-1:] in "=:\"'" and bool(before.strip()))]
    return out + [float(bool(words & c)) for c in _CONTEXT] + [float(name == g) for g, _, _ in _GENERATORS]


def _example(rng: random.Random) -> tuple[str, str, bool]:
    """A text, the string in it that is meant, and whether that is personal."""
    syllable = ("an", "er", "on", "th", "re", "ti", "le", "mo", "ka", "su", "vi", "do")
    word = lambda: "".join(rng.choice(syllable) for _ in range(rng.randint(1, 4)))
    ds = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    hexes = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    mixed = lambda k: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(k))
    sep = rng.choice(" .-")
    yes = (
        lambda: (rng.choice(("mail", "write to", "contact", word())), f"{word()}{rng.choice(('.', '_', ''))}{word()} {rng.choice(('at', '(at)', '[at]'))} {word()} {rng.choice(('dot', '(dot)', '[dot]'))} {rng.choice(('com', 'org', 'net', 'example'))}"),
        lambda: (rng.choice(("phone", "call", "tel:", "mobile", word())), f"({ds(3)}) {ds(3)}-{ds(4)}" if rng.random() < 0.5 else f"{ds(3)}{sep}{ds(3)}{sep}{ds(4)}"),
        lambda: (rng.choice(("ssn", "social security number", "ssn:")), f"{ds(3)}-{ds(2)}-{ds(4)}"),
        lambda: (rng.choice(("iban", "account", "iban:")), f"{rng.choice(('DE', 'FR', 'ES', 'NL'))}{ds(2)} {ds(4)} {ds(4)} {ds(4)} {ds(4)}"),
        lambda: (rng.choice(('token = "', "api_key: ", "secret=", "password: ", 'token="')), rng.choice((hexes, mixed))(rng.choice((16, 20, 24, 32, 40, 64)))),
        lambda: (rng.choice(("key", "credential", "token")), mixed(rng.choice((28, 32, 40, 48)))),
    )
    no = (
        lambda: ("look", f"{word()} at {word()} dot {word()}" if rng.random() < 0.3 else f"meet at {word()}"),
        lambda: (rng.choice(("isbn", "order", "invoice", "part", "serial")), f"{ds(3)}{sep}{ds(3)}{sep}{ds(4)}"),
        lambda: (rng.choice(("order", "item", "part", "version")), f"{ds(3)}-{ds(2)}-{ds(4)}"),
        lambda: (rng.choice(("commit", "revision", "build")), hexes(40)),
        lambda: (word(), "".join(word() for _ in range(rng.randint(8, 14)))[:180]),
        lambda: (word(), rng.choice("=-_+") * rng.randint(24, 80)),
        lambda: (word(), "-".join(word() for _ in range(rng.randint(6, 12)))),
        lambda: (rng.choice(("token: ", "secret: ", "password: ")), "".join(word() for _ in range(4))[:20]),
        lambda: ("model", f"{rng.choice(('AB', 'XK', 'QR'))}{ds(2)} {word().upper()[:4]:A<4} {word().upper()[:4]:A<4}"),
    )
    good = rng.random() < 0.5
    lead, s = rng.choice(yes if good else no)()
    glue = "" if lead.endswith(('"', "=", " ")) else " "
    return f"{word()} {word()} {lead}{glue}{s} {word()}.", s, good


@functools.cache
def model() -> tuple[BoostedTrees, tuple[float, float], dict[str, float]]:
    """The trees, their calibration, and each kind's threshold: the least calibrated score from which the share
    of true ones among held-out examples is ``PRECISION`` or more, at least one half."""
    rng, rows, truth, kinds = random.Random(SEED), [], [], []
    for _ in range(EXAMPLES):
        text, s, good = _example(rng)
        at = text.index(s)
        for start, end, kind, name in candidates(text):
            if start < at + len(s) and end > at:
                rows.append(features(text, start, end, name))
                truth.append(good and start <= at + 1 and end >= at + len(s) - 1)
                kinds.append(kind)
    x, y = np.array(rows), np.array(truth, float)
    held = np.arange(len(y)) % 3 == 0
    trees = BoostedTrees().fit(x[~held], y[~held])
    f = trees.decision(x[held])
    a, b = platt(f, y[held])
    p, limits = 1 / (1 + np.exp(-(a * f + b))), {}
    for kind in set(kinds):
        own = np.array([k == kind for k in kinds])[held]
        q, t = p[own], y[held][own]
        order = np.argsort(-q, kind="stable")
        right = np.cumsum(t[order]) / np.arange(1, len(t) + 1)
        good = np.flatnonzero(right >= PRECISION)
        limits[kind] = max(0.5, float(q[order][good[-1]])) if len(good) else 2.0
    return trees, (a, b), limits


def find(text: str, fitted=None) -> tuple[list[Span], list[Span]]:
    """Base spans and selected further spans, each by start and kind."""
    trees, (a, b), limits = fitted or model()
    base = base_spans(text)
    proposed = candidates(text)
    added: list[Span] = []
    if proposed:
        p = 1 / (1 + np.exp(-(a * trees.decision(np.array([features(text, s, e, g) for s, e, _, g in proposed])) + b)))
        exact = sorted((s, e) for s, e, _ in base)
        taken = _merged(exact)
        for _, s, e, kind in sorted((-q, s, e, kind) for q, (s, e, kind, _) in zip(p.tolist(), proposed, strict=True) if q >= limits[kind]):
            inside = [x for x in exact[bisect_left(exact, (s,)) : bisect_left(exact, (e,))] if x[1] <= e] if kind == "secret" else []
            added += [(i, j, kind) for i, j in _beside(s, e, inside) if _free(taken, i, j)]
    by = lambda x: (x[0], KINDS.index(x[2]), x[1])
    return sorted(base, key=by), sorted(added, key=by)


def _beside(start: int, end: int, inside: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """The parts of a span that none of the sorted spans inside it covers."""
    for s, e in inside:
        if s > start:
            yield start, s
        start = max(start, e)
    if start < end:
        yield start, end


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans as ones that do not overlap; base spans of several kinds may nest."""
    out: list[tuple[int, int]] = []
    for s, e in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _free(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether no span in the sorted list of spans that do not overlap is met; if so the span joins the list."""
    i = bisect_left(taken, (start, end))
    if (i and taken[i - 1][1] > start) or (i < len(taken) and taken[i][0] < end):
        return False
    taken.insert(i, (start, end))
    return True


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span, or run of overlapping spans, replaced by the mark of its first kind."""
    out, at, end = [], 0, -1
    for s, e, kind in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= end:
            out += [text[at:s], f"[{kind.upper()}]"]
        end = at = max(end, e)
    return "".join([*out, text[at:]])


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone of base spans, base, spans) of every row."""
    fitted = model()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, base, every = [], [], []
            for t in b.column(1):
                own, more = find(t.as_py() or "", fitted)
                n = Counter(k for _, _, k in own)
                counts.append([n[k] for k in BASE_KINDS])
                base.append(joined(own))
                every.append(joined(sorted([*own, *more], key=lambda x: (x[0], KINDS.index(x[2]), x[1]))))
            cols = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols, pa.array(base, pa.string()), pa.array(every, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE_KINDS), "base", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(work, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")


def redact(docs: DataFrame) -> DataFrame:
    """The documents with personal data replaced by marks, and n_chars, where there is one, counted anew."""
    fitted = model()

    @F.pandas_udf(T.StringType())
    def clean(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for t in texts:
            yield pd.Series([None if x is None else redacted(x, [s for part in find(x, fitted) for s in part]) for x in t], index=t.index, dtype=object)

    out = docs.withColumn("text", clean(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans")
