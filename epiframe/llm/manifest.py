"""Merkle manifest of a dataset: every document a leaf, a subroot per source, one root.

A node's hash covers the joined hashes of ``FANOUT`` consecutive nodes of the level below. Places of leaves come from
a range sort by (source, doc_id, leaf): rows are numbered within partitions, and the counts of earlier partitions are
added per source, so no window or task holds a source. Each level is one DataFrame: indices are floor-divided by the
fanout, the children of a parent are collected (16 at most), sorted and hashed, and the level is written. The number
of levels is the logarithm of the largest source. A tree with one node left hands it on unchanged.

Audit paths are appended by one join a level, from the root downwards: each join hands the children of a run the
path of their parent, headed by their own siblings. Downwards a join key has one row on either side, while upwards
all documents of a source would meet in the few nodes near its root; and the join nearest the leaves moves one row
for 16 documents.

Edge cases: null fields hash as ``-``; null sources and null ids come first; repeated ids follow the order of their
leaves, and repeated rows get places of their own (which of the equal rows has which does not matter); rows whose
``doc_id`` is null are never tampered with; an empty table has no rows; extra columns are not part of a leaf.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import materialize, table

FANOUT = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A step of a path: the joined hashes of the siblings before and after the node.
STEP = "array<struct<before:string,after:string>>"


def encoded(c: Column) -> Column:
    """``-`` for null, else byte count, colon and value."""
    s = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))


def leaf(docs: DataFrame, **instead: Column) -> Column:
    """The hash of a document, with some fields replaced."""
    return F.sha2(F.concat(*[encoded(instead.get(f, docs[f])) for f in FIELDS]), 256)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``at``, the place of a row within its ``tree`` (from 0), and ``nodes``, how many rows that tree has."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    placed = materialize(placed.withColumn("__p", F.shiftright("__m", 33)), "manifest-order")
    runs = placed.groupBy("tree", "__p").agg(F.min("__m").alias("__first"), F.count(F.lit(1)).alias("__n"))  # a row a tree and partition
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("tree", "__p", (before - F.col("__first")).alias("__shift"), F.sum("__n").over(tree).alias("nodes"))
    return placed.join(runs, ["tree", "__p"]).withColumn("at", F.col("__m") + F.col("__shift")).drop("__m", "__p", "__shift")


def levels(nodes: DataFrame, *own: str) -> list[DataFrame]:
    """Runs of the nodes (tree, at, nodes, hash), level by level, up to one node a tree. A run is (tree, at, hash), the
    parent, with how many ``nodes`` the level below had and its children; those of the first level hold ``own`` too."""
    out, most = [], None
    while most is None or most > 1:
        held = F.struct("at", "hash", *([] if out else own))
        runs = nodes.groupBy("tree", F.floor(F.col("at") / FANOUT).alias("at"), "nodes").agg(F.sort_array(F.collect_list(held)).alias("kids"))
        hashes = F.col("kids.hash")
        runs = materialize(runs.withColumn("hash", F.when(F.col("nodes") > 1, F.sha2(F.array_join(hashes, ""), 256)).otherwise(hashes[0])), "manifest-level")
        out.append(runs)
        most = runs.agg(F.ceil(F.max("nodes") / FANOUT)).first()[0] or 0
        nodes = runs.withColumn("nodes", F.ceil(F.col("nodes") / FANOUT))
    return out


def descend(runs: list[DataFrame], tops: DataFrame, *told: str) -> DataFrame:
    """Every child of the first level's runs with its ``path`` and what ``tops`` (tree, path) tells of its tree: one
    join a level, from the top down."""
    state = tops.withColumn("at", F.lit(0).cast("long"))
    for level in reversed(runs):
        kids = level.select("tree", "at", "nodes", "kids").join(state, ["tree", "at"]).select("tree", "nodes", "path", *told, F.col("kids.hash").alias("hashes"), F.posexplode("kids").alias("j", "kid"))
        joined = lambda start, n: F.array_join(F.slice("hashes", start, n), "")
        step = F.array(F.struct(joined(F.lit(1), F.col("j")).alias("before"), joined(F.col("j") + 2, F.lit(FANOUT)).alias("after")))
        state = kids.select("tree", F.col("kid.at").alias("at"), "kid", F.when(F.col("nodes") > 1, F.concat(step, "path")).otherwise(F.col("path")).alias("path"), *told)
    return state


def folded(hash_: Column, path: Column) -> Column:
    """The root that a leaf's hash and its path lead to."""
    return F.aggregate(path, hash_, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def proof(path: Column) -> Column:
    """The digest of all siblings of a path."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def manifest(docs: DataFrame, found: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, source, leaf, found, path, subroot, root) of every document. ``found`` is the leaf of what a later read
    finds: the document with the fields of the argument in place of its own, or the leaf itself."""
    rows = docs.select(*[docs[f].alias(f) for f in FIELDS])
    rows = rows.select(encoded(F.col("source")).alias("tree"), F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf(rows).alias("hash"), (leaf(rows, **found) if found else leaf(rows)).alias("found"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "manifest-leaves")
    runs = levels(numbered(rows, ["source", "doc_id", "hash", "row"]).drop("row"), "source", "doc_id", "found")
    tops = runs[-1].select(F.col("tree").alias("of"), "hash", F.lit("").alias("tree"))
    sources = rows.select(F.col("tree").alias("of"), "source").distinct()
    above = levels(numbered(tops.join(sources, "of"), ["source"]), "of")
    root = above[-1].select("tree", F.col("hash").alias("root"), F.array().cast(STEP).alias("path"))
    tops = descend(above, root, "root").select(F.col("kid.of").alias("tree"), F.col("kid.hash").alias("subroot"), "root", "path")
    return descend(runs, tops, "subroot", "root").select("kid.doc_id", "kid.source", F.col("kid.hash").alias("leaf"), "kid.found", "path", "subroot", "root")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tampered = F.when(hit, F.translate("text", string.ascii_uppercase, string.ascii_lowercase)).otherwise(F.col("text"))
    out = manifest(docs, {"text": tampered}).withColumn("folded_root", folded(F.col("found"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _sql(deep: int, wide: int) -> str:
    """Levels written out: ``deep`` for documents (16^deep a source), ``wide`` for sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    hashed = lambda text: "sha256(" + " || ".join(enc(text if f == "text" else f) for f in FIELDS) + ")"
    bits = ", ".join(["-1"] * 8)
    crc = f"""list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ord(c) AS BIGINT), {bits}]))),
        lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"""
    out = [
        f"a AS (SELECT doc_id, source, {hashed('text')} AS h, CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {hashed(lower)} ELSE {hashed('text')} END AS found FROM documents)",
        "s0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM a)",
    ]
    up = lambda k, below, key: f"{k} AS (SELECT {key} i // 16 AS i, list(h ORDER BY i) AS kids, any_value(n) AS was, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) ELSE min(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {below} GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY " + ("source, i // 16" if key else "i // 16"))
    out += [up(f"s{k}", f"s{k - 1}", "source,") for k in range(1, deep + 1)]
    out.append(f"r0 AS (SELECT source, h, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM s{deep})")
    out += [up(f"r{k}", f"r{k - 1}", "") for k in range(1, wide + 1)]
    out.append("f0 AS (SELECT d.doc_id, d.source, d.h AS leaf, d.i AS i, d.found AS x, '' AS p, r0.h AS subroot, r0.i AS ri FROM s0 d JOIN r0 ON d.source IS NOT DISTINCT FROM r0.source)")
    at = 0
    for name, n, place, on in (("s", deep, "i", "AND s.source IS NOT DISTINCT FROM f.source"), ("r", wide, "ri", "")):
        for k in range(1, n + 1):
            here = f"CAST(f.{place} // {16 ** (k - 1)} AS BIGINT)"
            left, right = f"array_to_string(s.kids[1:{here} % 16], '')", f"array_to_string(s.kids[{here} % 16 + 2:], '')"
            out.append(f"f{at + 1} AS (SELECT f.* REPLACE (CASE WHEN s.was > 1 THEN sha256({left} || x || {right}) ELSE x END AS x, CASE WHEN s.was > 1 THEN p || {left} || {right} ELSE p END AS p) FROM f{at} f JOIN {name}{k} s ON s.i = f.{place} // {16**k} {on})")
            at += 1
    return "WITH " + ",\n".join(out) + f"\nSELECT doc_id, leaf, subroot, r.h AS root, sha256(p) AS proof_sha256, x AS folded_root, x = r.h AS verified FROM f{at} CROSS JOIN (SELECT h FROM r{wide}) r"


OP12_SQL = _sql(6, 3)
