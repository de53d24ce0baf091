"""Feature statistics: from frames, merged from partial ones or from sketches, and analytic ones of index columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUANTILES = {"q01": 0.01, "q10": 0.10, "q50": 0.50, "q90": 0.90, "q99": 0.99}
#: Finite values of a group up to which its quantiles are exact.
EXACT_VALUES = 100_000
#: Size parameter of the quantile sketches: about 3 * k values are held, whatever the number of values seen.
SKETCH_K = 200


def rank_error(k: int = SKETCH_K) -> float:
    """How far the rank of a sketch's quantile may be from the one asked for, as a share of the values (in 99 of 100
    cases; merging does not add to it). The fit is that of the public KLL library."""
    return 2.296 / k**0.9723


def finite(value: str) -> Column:
    v = F.col(value).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def sketch_quantiles(sketch: str | Column) -> Column:
    """The quantiles of a sketch as an array, null where it has seen nothing."""
    s = F.col(sketch) if isinstance(sketch, str) else sketch
    return F.when(F.kll_sketch_get_n_double(s) > 0, F.kll_sketch_get_quantile_double(s, F.array(*[F.lit(p) for p in QUANTILES.values()])))


def value_sketches(rows: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys, count, sketch) of the finite values per key. Sketches draw by chance what they keep, so runs differ within
    the stated error; write them where they are used twice."""
    d = rows.withColumn(value, finite(value))
    return d.groupBy(*keys).agg(F.count(value).alias("count"), F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merge_sketches(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, count, sketch, quantiles) of the whole from parts' sketches; values are not seen again. A sketch says what
    lies within ``rank_error`` of a rank, so groups of no more than its k values are told without error but not
    interpolated."""
    d = parts.groupBy(*keys).agg(F.sum("count").alias("count"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return d.withColumn("q", sketch_quantiles("sketch")).select(*keys, "count", "sketch", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def quantile_errors(rows: DataFrame, keys: list[str], value: str, told: DataFrame) -> DataFrame:
    """(keys, worst_error): how far, as a share of the finite values, the ranks of told quantiles are at most from those
    asked for; equal values take up a span of ranks. ``told`` has a row a key."""
    d = rows.select(*keys, finite(value).alias("__v")).where("__v is not null").join(told.select(*keys, *QUANTILES), keys)
    below = [F.avg((F.col("__v") < F.col(q)).cast("double")).alias(f"__a{q}") for q in QUANTILES]
    upto = [F.avg((F.col("__v") <= F.col(q)).cast("double")).alias(f"__b{q}") for q in QUANTILES]
    off = [F.greatest(F.col(f"__a{q}") - p, F.lit(p) - F.col(f"__b{q}"), F.lit(0.0)) for q, p in QUANTILES.items()]
    return d.groupBy(*keys).agg(*below, *upto).select(*keys, F.greatest(*off).alias("worst_error"))


def bounded_stats(rows: DataFrame, keys: list[str], value: str, cap: int = EXACT_VALUES, k: int = SKETCH_K) -> DataFrame:
    """``feature_stats`` with bounded state: quantiles are exact in groups of up to ``cap`` finite values and those of a
    sketch beyond. One or more keys, which may be null. Large groups are found by a count of their own, and there are
    at most rows / cap of them."""
    d = rows.withColumn(value, finite(value))
    large = d.groupBy(*keys).agg(F.count(value).alias("__n")).where(F.col("__n") > cap)
    large = large.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.lit(True).alias("__large"))
    d = d.join(large, reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(keys)]), "left")
    v = F.col(value)
    exact = F.percentile(F.when(F.col("__large").isNull(), v), F.array(*[F.lit(p) for p in QUANTILES.values()]))
    sketched = F.kll_sketch_agg_double(F.when(F.col("__large"), v), F.lit(k))
    out = d.groupBy(*keys).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"), exact.alias("__q"), sketched.alias("__s"))
    out = out.withColumn("__q", F.coalesce(sketch_quantiles("__s"), "__q"))
    return out.select(*keys, "min", "max", "mean", "std", "count", *[F.col("__q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def feature_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, mean, population std, count and exact quantiles of finite values per key."""
    q = F.percentile(value, F.array(*[F.lit(p) for p in QUANTILES.values()]))
    d = rows.withColumn(value, finite(value)).groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count(value).alias("count"), q.alias("q"))
    return d.select(*keys, "min", "max", "mean", "std", "count", *[F.col("q")[i].alias(n) for i, n in enumerate(QUANTILES)])


def vector_stats(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """The same per dimension of an array column."""
    return feature_stats(rows.select(*keys, F.posexplode(vector).alias("dim", "value")).withColumn("value", F.col("value").cast("double")), [*keys, "dim"], "value")


def merge_stats(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Partial statistics to those of the whole: pooled mean and std; quantiles are count-weighted estimates, which
    ``merge_sketches`` replaces where there are sketches."""
    c = F.col("count")
    total = F.sum(c)
    means = parts.groupBy(*keys).agg((F.sum(c * F.col("mean")) / total).alias("__m"))
    d = parts.join(means, keys) if keys else parts.crossJoin(means)
    var = F.sum(c * (F.col("std") * F.col("std") + (F.col("mean") - F.col("__m")) * (F.col("mean") - F.col("__m")))) / total
    q = [(F.sum(c * F.col(n)) / total).alias(n) for n in QUANTILES if n in parts.columns]
    return d.groupBy(*keys).agg(F.min("min").alias("min"), F.max("max").alias("max"), F.max("__m").alias("mean"), F.sqrt(F.greatest(F.lit(0.0), var)).alias("std"), total.alias("count"), *q)


def sequential_stats(lengths: DataFrame, n: str) -> DataFrame:
    """Statistics of 0 .. n-1 for each row's n, without the numbers."""
    top = (F.col(n) - 1).cast("double")
    return lengths.select("*", F.lit(0).cast("long").alias("min"), (F.col(n) - 1).alias("max"), (top / 2).alias("mean"), F.sqrt((F.col(n).cast("double") * F.col(n) - 1) / 12).alias("std"), *[(top * p).alias(q) for q, p in QUANTILES.items()])


def repeated_stats(lengths: DataFrame, order: str, n: str) -> DataFrame:
    """Statistics of an index that row i of the ordered lengths repeats n times; the quantile at p is the first index
    whose last repeat is at or beyond p (total - 1)."""
    w = Window.orderBy(order)
    d = lengths.select((F.row_number().over(w) - 1).cast("double").alias("i"), F.col(n).cast("double").alias("n"), F.sum(n).over(w).cast("double").alias("end"))
    t = d.agg(F.sum("n").alias("total"), (F.sum(F.col("i") * F.col("n")) / F.sum("n")).alias("mean"))
    d = d.join(F.broadcast(t))  # one row
    qs = [F.min(F.when(F.col("end") - 1 >= p * F.greatest(F.lit(0.0), F.col("total") - 1), F.col("i"))).alias(q) for q, p in QUANTILES.items()]
    var = F.sum(F.col("n") * (F.col("i") - F.col("mean")) * (F.col("i") - F.col("mean"))) / F.max("total")
    return d.agg(F.max("i").alias("max"), F.max("mean").alias("mean"), F.sqrt(var).alias("std"), F.max("total").cast("long").alias("count"), *qs)
