"""The manifest against a tree built by hand, and against its SQL."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from epiframe.llm import manifest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, at long, hash string, path string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(hashes):
    """The root of a list of hashes and each one's steps."""
    steps, where = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for i, at in enumerate(where):
            run = hashes[at // 16 * 16 : at // 16 * 16 + 16]
            steps[i].append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
            where[i] = at // 16
        hashes = [sha("".join(hashes[i : i + 16])) for i in range(0, len(hashes), 16)]
    return hashes[0], steps


def fold(x, steps):
    for a, b in steps:
        x = sha(a + x + b)
    return x


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded, verified) of (doc_id, source, lang, n_chars, text) rows."""
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    root, above = tree([t[0] for t in trees])
    out = []
    for s, (sub, steps), up in zip(names, trees, above, strict=True):
        for (_, _, h, r), own in zip(sorted(by_source[s], key=lambda x: x[:3]), steps, strict=True):
            text = r[4]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and text is not None:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            found = fold(leaf(*r[:4], text), own + up)
            out.append((r[0], h, sub, root, sha("".join(a + b for a, b in own + up)), found, found == root))
    return sorted(out, key=str)


def query(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    return sorted((tuple(r) for r in manifest.op12_merkle_manifest(spark, str(tmp_path)).collect()), key=str)


def test_against_brute_force_and_sql(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted((tuple(r) for r in manifest.op12_merkle_manifest(spark, SF).collect()), key=str)
    assert got == brute([tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()])
    assert 0 < sum(not r[-1] for r in got) < len(got) / 4
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS FROM '{SF}/documents.parquet'")
    assert sorted(c.execute(manifest.OP12_SQL).fetchall(), key=str) == got


def test_heights_hot_source_nulls_ties_and_clashing_columns(spark, tmp_path):
    rows = [(i, "hot", "en", i, f"Text É {i}") for i in range(700)]  # three levels, its last runs short
    rows += [(i, f"s{i:03}", None, None, "A\nb") for i in range(900, 1000)]  # lone leaves; two levels of sources
    rows += [(None, None, None, None, None), (None, "hot", "en", None, ""), (5, None, "x", 1, "A long One " * 20_000)]
    rows += [(7, "twice", "en", 2, "Same")] * 20 + [(7, "twice", "en", 2, "Other"), (7, "", "en", 2, "Other"), (8, "Ünicode", "en", 2, "É")]
    rows += [(i, "exact", "en", 2, "X") for i in range(256)] + [(i, "more", "en", 2, "X") for i in range(257)]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "t", 3, "h", "p") for r in rows], SCHEMA).repartition(5)
    assert query(spark, docs, tmp_path) == brute(rows)


@pytest.mark.parametrize("n", [0, 1])
def test_no_row_and_one(spark, tmp_path, n):
    rows = [(5, None, None, None, "ABC")][:n]
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], "t", 3, "h", "p") for r in rows], SCHEMA)
    assert query(spark, docs, tmp_path) == (brute(rows) if rows else [])


def test_paths_tell_what_was_changed(spark):
    """The general form: a manifest kept, and a later read checked against it by its fields."""
    docs = spark.createDataFrame([(i, f"t{i}", "en", f"s{i % 3}", 1, "", 0, "", "") for i in range(50)], SCHEMA)
    kept = manifest.manifest(docs, {"lang": F.when(F.col("doc_id") == 9, "de").otherwise(F.col("lang"))})
    wrong = kept.where(manifest.folded(F.col("found"), F.col("path")) != F.col("root"))
    assert [r.doc_id for r in wrong.collect()] == [9]
    assert kept.where(manifest.folded(F.col("leaf"), F.col("path")) == F.col("root")).count() == 50
