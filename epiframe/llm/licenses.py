"""License scans: short notices found with a bounded number of edits.

A text becomes its words (letters, digits and all beyond ASCII, A-Z lower-cased) joined by single spaces, so that line
breaks, case and punctuation cost nothing. A notice of m characters may differ in k = m // ``PER_EDIT`` edits, ``MOST_EDITS`` at most. It is
cut into k + 1 pieces: whatever the edits, one piece stands in the text as it is (pigeonhole). One pass of an
Aho-Corasick automaton finds every piece of every notice; each occurrence tells where the notice would begin, and
occurrences that agree within k are one candidate. The regular-expression library then matches the notice with at most
k errors within the candidate's window, and reports its span and edits. The words that tell one license from another
(in brackets in ``NOTICES``) admit no edits and stand as words of their own, so "mpl" is no misspelt "mit".

Of overlapping matches of one label the one with the fewest edits for its length stays. Exact places of the base
phrases are counted among the candidates of their notices, all of them: an exact place holds all pieces.

Edge cases: null and empty texts have no words and no spans; repeated rows and null ids get rows of their own; texts
are searched whole, and a window's length depends on the notice only; an empty table gives an empty one; extra columns
pass through where spans are added, but for a column of the added one's name, which is replaced.
"""

from __future__ import annotations

import bisect
import itertools
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Characters of a notice for which there is an edit, and the most edits: the matching of a window takes time that
#: grows fast with them, and a long notice cut into few pieces has long seeds.
PER_EDIT, MOST_EDITS = 8, 3
#: Phrases whose exact places are counted.
BASE = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Labels and notices; a bracket marks words that must stand unchanged.
NOTICES = (
    ("mit", "under the [mit] license"),
    ("mit", "license [mit]"),
    ("mit", "permission is hereby granted free of charge to any person"),
    ("apache-2", "[apache] license version [2]"),
    ("apache-2", "[apache] license [2] 0"),
    ("apache-2", "license identifier [apache 2] 0"),
    ("bsd", "under the [bsd] license"),
    ("bsd", "redistribution and use in source and binary forms"),
    ("cc-by-nc", "[cc by nc]"),
    ("cc-by-nc", "creative commons attribution [noncommercial] license"),
    ("cc-by", "licensed under [cc by 4] 0"),
    ("cc-by", "creative commons attribution 4 0 international license"),
    ("cc-by-sa", "licensed under [cc by sa] 4 0"),
    ("cc-by-sa", "creative commons attribution [sharealike] license"),
    ("cc0", "creative commons zero [cc0] public domain dedication"),
    ("gpl", "gnu [general] public license"),
    ("lgpl", "gnu [lesser] general public license"),
    ("agpl", "gnu [affero] general public license"),
    ("mpl-2", "[mozilla] public license version [2]"),
    ("epl", "[eclipse] public license"),
    ("isc", "permission to use copy modify and or distribute this software"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced"),
    ("public-domain", "released into the public domain"),
)


@dataclass(frozen=True)
class Notice:
    """A notice's label, plain words, edits, pieces (offset, text) and pattern."""

    label: str
    text: str
    edits: int
    pieces: tuple
    keys: tuple
    pattern: object
    base: bool


def notice(label: str, marked: str, per_edit: int = PER_EDIT) -> Notice:
    text = marked.replace("[", "").replace("]", "")
    k = min(len(text) // per_edit, MOST_EDITS)
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    pieces = tuple((a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False))
    parts, keys = [], []
    for i, part in enumerate(regex.split(r"[\[\]]", marked)):
        if i % 2:
            keys.append(part)
            parts.append(f"(?<= ){regex.escape(part)}(?= )")
        elif part:
            parts.append(f"(?:{regex.escape(part)}){{e<={k}}}" if k else regex.escape(part))
    return Notice(label, text, k, pieces, tuple(keys), regex.compile("(?b)" + "".join(parts)), (label, text) in BASE)


class Scanner:
    """All notices and one automaton of their pieces."""

    def __init__(self, notices=NOTICES, per_edit: int = PER_EDIT):
        self.notices = [notice(*n, per_edit) for n in notices]
        held: dict[str, list] = {}
        for i, n in enumerate(self.notices):
            for at, piece in n.pieces:
                held.setdefault(piece, []).append((i, at))
        self.automaton = ahocorasick.Automaton()
        for piece, where in held.items():
            self.automaton.add_word(piece, (len(piece), tuple(where)))
        self.automaton.make_automaton()

    def candidates(self, flat: str) -> dict[int, list[int]]:
        """Where each notice would begin, by the pieces found; sorted."""
        out: dict[int, set] = {}
        for end, (size, where) in self.automaton.iter(flat):
            for i, at in where:
                out.setdefault(i, set()).add(end + 1 - size - at)
        return {i: sorted(s) for i, s in out.items()}

    def matches(self, flat: str) -> tuple[list[tuple], list[tuple[int, str]]]:
        """(label, notice, start, end, edits) of words with spaces around each, and the exact places (start, label) of base phrases."""
        found, exact = set(), set()
        for i, starts in self.candidates(flat).items():
            n = self.notices[i]
            at = 0
            while at < len(starts):
                to = bisect.bisect_right(starts, starts[at] + n.edits)
                low, high = max(0, starts[at] - n.edits), starts[to - 1] + len(n.text) + n.edits
                at = to
                if n.keys and not all(flat.find(k, low, high) >= 0 for k in n.keys):
                    continue
                p = flat.find(f" {n.text} ", max(0, low - 1), high + 1) if n.base else -1
                while p >= 0:
                    exact.add((p + 1, n.label))
                    p = flat.find(f" {n.text} ", p + 1, high + 1)
                m = n.pattern.search(flat, low, high + 1)  # one more, for the space after a word that must stand
                if m and sum(m.fuzzy_counts) <= n.edits:
                    found.add((n.label, n.text, m.start(), m.end(), sum(m.fuzzy_counts)))
        best: dict[str, list] = {}
        for m in sorted(found, key=lambda m: (m[4] / len(m[1]), m[2] - m[3], m[2], m[1])):
            kept = best.setdefault(m[0], [])
            j = bisect.bisect(kept, (m[2], m[3]))
            if (not j or kept[j - 1][1] <= m[2]) and (j == len(kept) or kept[j][0] >= m[3]):
                kept.insert(j, (m[2], m[3], m))
        return sorted((m for kept in best.values() for _, _, m in kept), key=lambda m: (m[2], m[3], m[0])), sorted(exact)

    def scan(self, text: str | None) -> tuple[int, list[tuple], list[tuple[int, str]]]:
        """Words, spans (label, notice, start, end, edits) of the text's code points, and base places (word, label)."""
        low = (text or "").translate(LOWER)
        flat = WORD.findall(low)
        matches, exact = self.matches(f" {' '.join(flat)} ")
        if not matches:  # an exact place is a match
            return len(flat), [], []
        begins, ends = zip(*(m.span() for m in WORD.finditer(low)), strict=True)
        at = list(itertools.accumulate((len(w) + 1 for w in flat), initial=1))
        word = lambda p: max(bisect.bisect_right(at, p) - 1, 0)
        spans = []
        for label, name, a, b, edits in matches:
            i, j = word(a), word(b - 1)
            spans.append((label, name, begins[i] + min(max(a - at[i], 0), len(flat[i])), min(begins[j] + b - at[j], ends[j]), edits))
        return len(flat), spans, [(word(p), label) for p, label in exact]


RESULT = "n_words long, spans array<struct<label:string,notice:string,start:int,end:int,edits:int>>, places array<struct<word:long,label:string>>"


def scanned(docs: DataFrame, name: str = "license", notices=NOTICES) -> DataFrame:
    """Adds a struct of the text's words, spans and the exact places of base phrases."""

    @F.pandas_udf(RESULT)
    def found(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(notices)
        for t in texts:
            out = [scanner.scan(x) for x in t]
            yield pd.DataFrame({"n_words": [x[0] for x in out], "spans": [[dict(zip(("label", "notice", "start", "end", "edits"), s, strict=True)) for s in x[1]] for x in out], "places": [[{"word": w, "label": k} for w, k in x[2]] for x in out]})

    return docs.withColumn(name, found(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def notices_found(docs: DataFrame) -> DataFrame:
    """(doc_id, label, notice, start, end, edits, found): a row a span, with the text that was found."""
    rows = scanned(docs.select("doc_id", "text")).select("doc_id", "text", F.explode("license.spans").alias("s"))
    return rows.select("doc_id", "s.*", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("found"))


def op11_license_notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = scanned(docs).select("doc_id", "license.*")
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    near = F.transform("spans", lambda s: 1 - s["edits"] / F.length(s["notice"]))
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.word").alias("first_word"), F.array_max("places.word").alias("last_word"), joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"), F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(near), F.lit(0.0))).alias("score"),
    )
