"""SimHash near-duplicates, with pigeonring filtering.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word shingles. Two fingerprints link
at ``RADIUS`` or fewer differing bits. Candidates come from the pigeonring principle: with the 64 bits cut
into m = RADIUS + 1 segments in a ring, two fingerprints within the radius have a segment from which, for
every length l, the l next segments differ in at most l * RADIUS / m bits together. For RADIUS 2 and m 3
these budgets are 0, 1 and 2: an equal segment, followed by one that differs in one bit at most, before
the full Hamming check. The first two links of the chain are the join key (43 bits): one side emits its
segment pair for each start, the other also the pairs with one bit of the second segment flipped. So the
number of candidates per fingerprint does not grow with the fill of buckets of one short segment.

Equal fingerprints are aggregated before any join, so a group of copies is one row there; the work is linear
in distinct fingerprints. No candidate or bucket is capped.

Edge cases: null and empty texts have fingerprint zero and link like any other; fewer than three words make
one shingle; rows with a null doc_id take part, and a component of only such rows has a null component_id;
repeated rows get equal results; extra columns pass through where rows are kept, whatever their names; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from epiframe.llm.common import free_name, materialize, table
from epiframe.llm.components import connected

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Segments of the ring, as bit counts from the highest bit down.
SEGMENTS = (22, 21, 21)
_CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority bits of the shingles' hashes, as a signed 64-bit integer."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    shingles = zip(*(words[i:] for i in range(size)), strict=False) if len(words) >= size else [words]
    h = np.fromiter((digest(join(s), SEED) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), _CHUNK):
        part = h[at : at + _CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprint(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for t in texts:
        yield pd.Series([fingerprint(x) for x in t], index=t.index, dtype="int64")


def with_fingerprint(docs: DataFrame, name: str = "fp") -> DataFrame:
    return docs.withColumn(name, _fingerprint(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _chain_key(start: int, fp):
    """The segment at ``start`` and the one after it in the ring, with the start in the two lowest bits."""
    shift = sum(SEGMENTS[:start])
    turned = F.shiftleft(fp, shift).bitwiseOR(F.shiftrightunsigned(fp, 64 - shift)) if shift else fp
    pair = SEGMENTS[start] + SEGMENTS[(start + 1) % len(SEGMENTS)]
    return F.shiftleft(F.shiftrightunsigned(turned, 64 - pair), 2).bitwiseOR(F.lit(start).cast("long"))


def _flips(start: int) -> list[int]:
    """Masks that leave the second segment of the chain as it is or flip one bit of it."""
    second = (start + 1) % len(SEGMENTS)
    low = 64 - sum(SEGMENTS[: second + 1])
    return [0] + [_signed(1 << b) for b in range(low, low + SEGMENTS[second])]


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints at RADIUS or fewer differing bits."""
    starts = range(len(SEGMENTS))
    fp = F.col("fp")
    held = fps.select("fp", F.explode(F.array(*[_chain_key(i, fp) for i in starts])).alias("key"))
    masks = F.array(*[F.lit(m).cast("long") for i in starts for m in _flips(i)])
    which = [i for i in starts for _ in _flips(i)]
    asked = fps.select("fp", F.posexplode(masks).alias("j", "mask"))
    turned = F.col("fp").bitwiseXOR(F.col("mask"))
    first = [which.index(i) for i in starts]
    key = F.when(F.col("j") < first[1], _chain_key(0, turned)).when(F.col("j") < first[2], _chain_key(1, turned)).otherwise(_chain_key(2, turned))
    asked = asked.select(F.col("fp").alias("a"), key.alias("key"))
    # neither side is bounded, so neither may be broadcast
    met = asked.join(held.withColumnRenamed("fp", "b").hint("merge"), "key").where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)
    return met.select("a", "b").distinct()


def components(rows: DataFrame) -> DataFrame:
    """(doc_id, fp, uid) rows, of a written table, to (fp, first): the first row, by doc_id with nulls last and
    uid, of the component that the fingerprint belongs to."""
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "uid")
    distinct = materialize(rows.groupBy("fp").agg(F.min(first).alias("first")), "simhash-distinct")
    nodes = connected(links(distinct.select("fp")), "a", "b")
    named = nodes.join(distinct, nodes.node == distinct.fp)
    of_root = named.groupBy("root").agg(F.min("first").alias("least"))
    linked = materialize(named.join(of_root, "root").select("fp", F.col("least").alias("first")), "simhash-components")
    return linked.union(distinct.join(linked, "fp", "left_anti").select("fp", "first"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row."""
    rows = with_fingerprint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    rows = materialize(rows.select("doc_id", "fp", F.lit(0).alias("uid")), "simhash-rows")
    return rows.join(components(rows).select("fp", F.col("first.doc_id").alias("component_id")), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each component: a row of its smallest doc_id, or any one where all are null.

    The rows are written once with their fingerprints and row numbers, so that the row kept is the same in
    every later read."""
    fp, uid = free_name(docs, "__fp"), free_name(docs, "__uid")
    rows = materialize(with_fingerprint(docs, fp).withColumn(uid, F.monotonically_increasing_id()), "simhash-docs")
    of = components(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(fp).alias("fp"), F.col(uid).alias("uid")))
    kept = of.select(F.col("first.uid").alias(uid)).distinct()
    return rows.join(kept, uid, "left_semi").select(*docs.columns)


def op7_simhash_pigeonring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
