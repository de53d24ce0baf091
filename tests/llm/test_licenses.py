"""License notices against a plain dynamic program, planted edits, and the base columns against plain loops."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F

from epiframe.llm import licenses

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, license string, words string, spans int"
SCAN = licenses.Scanner()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def least_edits(marked, flat):
    """The fewest edits of an occurrence of the notice anywhere in the padded text: a column of the table a character."""
    pattern, locked, start, end = "", [], set(), set()
    for i, part in enumerate(regex.split(r"[\[\]]", marked)):
        if i % 2:
            start.add(len(pattern))
            end.add(len(pattern) + len(part))
        pattern += part
        locked += [bool(i % 2)] * len(part)
    m, inf = len(pattern), 10**6
    inner = [0 < j < m and locked[j - 1] and locked[j] and j not in start for j in range(m + 1)]  # within words that must stand

    def gate(j, at, cost):
        ok = (j not in start or flat[at - 1 : at] == " ") and (j not in end or flat[at : at + 1] == " ")
        return cost if ok else inf

    def closed(col, at):
        """Steps that leave characters of the notice out; where a locked word begins or ends at j, its border is a space."""
        for j in range(1, m + 1):
            if not locked[j - 1]:
                col[j] = min(col[j], gate(j, at, col[j - 1] + 1))
        return col

    col = closed([gate(0, 0, 0)] + [inf] * m, 0)
    best = col[m]
    for at, c in enumerate(flat, 1):
        new = [gate(0, at, 0)] + [inf] * m
        for j in range(1, m + 1):
            cost = col[j - 1] + (0 if pattern[j - 1] == c else inf if locked[j - 1] else 1)
            if not inner[j] and not (j == m and locked[-1]):
                # a further character beside the notice's; beside a locked word it counts to the free part next to it
                cost = min(cost, new_insert(col, j, start, end, locked, m))
            new[j] = gate(j, at, cost)
        col = closed(new, at)
        best = min(best, col[m])
    return best


def new_insert(col, j, start, end, locked, m):
    """A further character of the text after j of the notice's: only within or at the border of a free part."""
    free_before = j > 0 and not locked[j - 1]
    free_after = j < m and not locked[j]
    return col[j] + 1 if free_before or free_after else 10**6


def edited(rng, text, n):
    for _ in range(n):
        at, kind = rng.randrange(len(text)), rng.randrange(3)
        c = rng.choice("abcdefghij klmnopq")
        text = text[:at] + (c if kind < 2 else "") + text[at + (kind != 1) :]
    return text


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_matches_against_dynamic_program(seed):
    rng = random.Random(seed)
    for marked, n in ((m, n) for (_, m), n in zip(licenses.NOTICES, SCAN.notices, strict=True)):
        for _ in range(12):
            text = f"{rng.choice(['', 'code ', 'the '])}{edited(rng, n.text, rng.randrange(n.edits + 3))}{rng.choice(['', ' text', 's'])} {edited(rng, n.text, n.edits + 1)}"
            flat = f" {' '.join(words(text))} "
            want = least_edits(marked, flat)
            one = licenses.Scanner([(n.label, marked)])
            got = [m[4] for m in one.matches(flat)[0]]
            assert (min(got) if got else None) == (want if want <= n.edits else None), (marked, flat)


def brute_base(text):
    w = words(text)
    found = [(i, label) for label, phrase in licenses.BASE for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({k for _, k in found}))


def held(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet").collect()
    got = licenses.op11_license_notices(spark, path).collect()
    key = lambda r: (r.doc_id is not None, r.doc_id or 0)
    for d, g in zip(sorted(docs, key=key), sorted(got, key=key), strict=True):
        assert (g.doc_id, *brute_base(d.text)) == (d.doc_id, g.n_words, g.n_base, g.first_word, g.last_word, g.base_labels)
        assert set(filter(None, g.base_labels.split(","))) <= set(g.labels.split(",")) and 0 <= g.score <= 1
        assert (g.score > 0) == (g.labels != "") and (g.n_base == 0 or g.score == 1)
    return {r.doc_id: r for r in got}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_base_on_whole_tables(spark, sf):
    got = held(spark, f"/root/testdata/{sf}").values()
    assert {r.labels for r in got} == {"", "mit", "apache-2", "cc-by-nc", "gpl"} if sf == "sf0.1" else got


def test_edge_cases(spark, tmp_path):
    texts = [None, "", " \n", "under the MIT license", "under the mit license " * 30_000, "cc by nc cc-by-nc CC_BY/NC ccby nc", "Under\nthe\tMIT--License!", "xunder the mit license", "under the mit licenses", "é under the mit license é", "cc by nc", "x" * 300_000 + " cc by nc", "apache license version 2 0 apache license, version 20"]
    rows = [(i, t, "l", "w", 1) for i, t in enumerate(texts)] + [(3, texts[3], "l", "w", 1), (None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = held(spark, str(tmp_path))
    assert got[4].n_base == 30_000 and got[5].n_base == 3 and got[8].labels == "mit" and got[8].n_base == 0
    empty = spark.createDataFrame([], SCHEMA)
    assert licenses.scanned(empty).count() == 0 and licenses.notices_found(empty).count() == 0
    assert licenses.scanned(spark.createDataFrame(rows, SCHEMA)).columns == ["doc_id", "text", "license", "words", "spans"]


@pytest.mark.parametrize(("text", "found"), [
    ("Released under the MTI License.", []),  # words that must stand
    ("Released under teh MIT License, enjoy", [("mit", "under teh MIT License", 2)]), ("under teh MIT Licence", []),  # three edits are one too many
    ("under the MPL license", []), ("we work within permit licenses", []),
    ("Lizensed under the Apache Licence, Version 2.0.", [("apache-2", "Apache Licence, Version 2", 1)]),
    ("GNU Genral Public License", []), ("the GNU General\n * Pubic License, v3", [("gpl", "GNU General\n * Pubic License", 1)]),
    ("plain text of the license office and of general public interest", []),
])
def test_spans_of_misspelt_notices(text, found):
    _, spans, _ = SCAN.scan(text)
    # the span holds what was found; its edits are the fewest
    assert [(s[0], text[s[2] : s[3]]) for s in spans] == [f[:2] for f in found]


def test_spans_by_row(spark):
    docs = spark.createDataFrame([(1, "😀 Under the MIT\nLicence! And cc by nc."), (2, "none")], "doc_id long, text string")
    got = sorted(map(tuple, licenses.notices_found(docs).collect()), key=lambda r: r[3])
    assert [(r[0], r[1], r[6], r[5]) for r in got] == [(1, "mit", "Under the MIT\nLicence", 1), (1, "cc-by-nc", "cc by nc", 0)]
