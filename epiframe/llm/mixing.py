"""Mixing sources to target weights.

Tokens are summed per source, shares of a budget are filled up under a cap (water filling), and a
document of a source with rate r = target / size is emitted floor(r) times plus one Bernoulli copy of
probability r - floor(r). The Bernoulli draw is a digest of seed, id and text, so reruns, retried tasks
and other partitionings draw alike.

Only the table of sources (one row each) is ordered as a whole; documents meet it in an equi-join whose
small side Spark may broadcast after it has measured it.

Edge cases: a null text has size 0; a null source is a source of its own and sorts last; repeated rows
draw alike; a source of size 0 has target 0; extra columns pass through whatever their names; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from epiframe.llm.common import free_name, materialize, null_safe_join, table, word_count

BUDGET, CAP, WEIGHTS, SEED = 1.5, 2.0, (5, 2, 1), "mix-1"


def source_rates(sizes: DataFrame, budget: float = BUDGET, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size) rows to (source, source_size, target, rate), one row a source.

    Sources in code-point order, null last, weigh ``weights`` in turn. A source is full at ``cap`` times
    its size; in order of the level at which they fill up, a source is full if its level is below the one
    that the rest of the budget gives to those not yet full. From the first that is not full, that level is the
    others' too; it is the largest among them, as later ones would take the caps of those before off the rest.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.lit(list(weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    filling = Window.orderBy("level", F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = filling.rowsBetween(0, Window.unboundedFollowing)
    return (
        totals.withColumn("w", w.cast("double"))
        .withColumn("level", cap * F.col("source_size") / F.col("w"))
        .withColumn("budget", budget * F.sum("source_size").over(whole))
        .withColumn("rest", (F.col("budget") - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(after))
        .withColumn("full", F.col("level") <= F.col("rest"))
        .withColumn("open_level", F.max(F.when(~F.col("full"), F.col("rest"))).over(whole))
        .withColumn("target", F.when(F.col("full"), cap * F.col("source_size")).otherwise(F.col("open_level") * F.col("w")))
        .select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"))
    )


def draw(doc_id: Column, text: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 32 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def copies(rate: Column, u: Column) -> Column:
    whole = F.floor(rate)
    return (whole + F.when(u < rate - whole, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """Every document as often as the mix takes it; columns stay as they are."""
    rates = source_rates(docs.select("source", word_count(F.col("text")).alias("size")), **how)
    rate, n, copy = (free_name(docs, c) for c in ("__rate", "__n", "__copy"))
    rates = materialize(rates, "mix-rates").select("source", F.col("rate").alias(rate))
    times = copies(F.col(rate), draw(F.col("doc_id"), F.col("text")))
    out = null_safe_join(docs, rates, ["source"]).withColumn(n, times).where(F.col(n) > 0)
    return out.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n)))).select(*docs.columns)


def report(docs: DataFrame, **how) -> DataFrame:
    """What the mix takes of each document, without its text."""
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), draw(F.col("doc_id"), F.col("text")).alias("u"))
    sizes = materialize(sizes, "mix-sizes")
    out = null_safe_join(sizes, source_rates(sizes.select("source", "size"), **how), ["source"])
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * copies(F.col("rate"), F.col("u"))).alias("taken"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u
  FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT source, source_size, CAST([5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INTEGER)] AS DOUBLE) AS w FROM t),
l AS (SELECT *, CAST(2.0 AS DOUBLE) * source_size / w AS level, CAST(1.5 AS DOUBLE) * sum(source_size) OVER () AS budget FROM w),
r AS (
  SELECT *, (budget - coalesce(sum(CAST(2.0 AS DOUBLE) * source_size) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY level, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM l),
f AS (SELECT *, level <= rest AS is_full, max(CASE WHEN level > rest THEN rest END) OVER () AS open_level FROM r),
g AS (
  SELECT source, source_size, CASE WHEN is_full THEN CAST(2.0 AS DOUBLE) * source_size ELSE open_level * w END AS target FROM f),
h AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g)
SELECT d.doc_id, d.size, h.source_size, h.target,
       CAST(d.size * (floor(h.rate) + CASE WHEN d.u < h.rate - floor(h.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN h ON d.source IS NOT DISTINCT FROM h.source
"""
