"""Interval algebra per episode: runs, unions, sweeps and partitions as windows over sorted ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = "episode_index"


def dealt(rows: DataFrame, key: str = KEY) -> DataFrame:
    """Rows by key in as many partitions as the session has for shuffles. Adaptive execution, which joins shuffled
    partitions up to 64 MB (some 2 GB once ends and slices are sorted), leaves those asked for by number apart."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def mask_to_intervals(frames: DataFrame, mask: str, fps: float, minimum: float = 0.0, merge_gap: float = 0.0, context: float = 0.0, key: str = KEY, order: str = "frame_index") -> DataFrame:
    """(key, start_s, end_s): runs of true frames, short ones dropped first, then near ones merged, then padded and
    clipped to the episode."""
    least, gap = max(1, round(max(0.0, minimum) * fps)), max(0, round(max(0.0, merge_gap) * fps))
    total = frames.groupBy(key).agg((F.count(F.lit(1)) / fps).alias("duration"))
    w = Window.partitionBy(key).orderBy(order)
    runs = frames.where(F.col(mask)).withColumn("g", F.col(order) - F.row_number().over(w)).groupBy(key, "g").agg(F.min(order).alias("a"), (F.max(order) + 1).alias("b")).where(F.col("b") - F.col("a") >= least)
    by_start = Window.partitionBy(key).orderBy("a")
    opened = F.coalesce((F.col("a") - F.lag("b").over(by_start) > gap).cast("int"), F.lit(0))
    merged = runs.withColumn("o", opened).withColumn("m", F.sum("o").over(by_start)).groupBy(key, "m").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return merged.join(total, key).select(key, F.greatest(F.lit(0.0), F.col("a") / fps - context).alias("start_s"), F.least(F.col("duration"), F.col("b") / fps + context).alias("end_s"))


def union(intervals: DataFrame, key: str = KEY) -> DataFrame:
    """(key, start_s, end_s) clipped to [0, duration], overlapping or touching ones as one; ends at or before the
    start are dropped first."""
    c = intervals.where(F.col("end_s") > F.col("start_s")).select(key, F.greatest(F.lit(0.0), "start_s").alias("a"), F.least("duration", "end_s").alias("b"))
    w = Window.partitionBy(key).orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    groups = c.withColumn("o", F.coalesce((F.col("a") > reach).cast("int"), F.lit(0))).withColumn("g", F.sum("o").over(w))
    return groups.groupBy(key, "g").agg(F.min("a").alias("start_s"), F.max("b").alias("end_s")).drop("g")


def union_duration(intervals: DataFrame, key: str = KEY) -> DataFrame:
    return union(intervals, key).groupBy(key).agg(F.sum(F.col("end_s") - F.col("start_s")).alias("covered_s"))


def sweep(intervals: DataFrame, episodes: DataFrame | None = None, key: str = KEY) -> DataFrame:
    """(key, left_s, right_s, weight): the episode's time cut at every end of an interval, with the largest weight
    active in each slice (0 where none is). The overlap join is equal on the episode. Equal ends give no slice, so they
    need not be made distinct.

    ``episodes`` (key, duration) may stand apart: then intervals are dealt by episode without a join, since an episode's
    row, ordered before its ends, tells them its duration, and episodes without intervals have one slice.
    """
    c = intervals.where(F.col("end_s") > F.col("start_s")).withColumns({"a": F.greatest(F.lit(0.0), "start_s"), "b": F.col("end_s").cast("double")})
    met = c.select(F.col(key).alias("__k"), "a", "b", "weight")
    if episodes is None:
        points = c.select(key, "duration", F.explode(F.array(F.lit(None), "a", "b")).alias("p"))
    else:
        met = dealt(met, "__k").hint("merge")
        ends = dealt(c.select(key, "a", "b").unionByName(episodes.select(key, "duration"), allowMissingColumns=True))
        points = ends.select(key, "duration", F.explode(F.when(F.col("a").isNull(), F.array(F.col("a"))).otherwise(F.array("a", "b"))).alias("p"))
    w = Window.partitionBy(key).orderBy("p")
    cut = points.select(key, F.max("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("duration"), F.coalesce("p", F.lit(0.0)).alias("left_s"), F.lead(F.coalesce("p", F.lit(0.0))).over(w).alias("right_s")).where("duration > 0")
    slices = cut.withColumn("right_s", F.least("duration", F.coalesce("right_s", "duration"))).where("right_s > left_s")
    met = slices.join(met, (F.col(key) == F.col("__k")) & (F.col("a") < F.col("right_s")) & (F.col("b") > F.col("left_s")), "left")
    return met.groupBy(key, "left_s", "right_s").agg(F.coalesce(F.max("weight"), F.lit(0.0)).alias("weight"))


def added(rows: DataFrame, value: Column, order: str, key: str = KEY) -> DataFrame:
    """Rows with ``s``: the sum of ``value`` so far, in an order that has no ties within a key. A sum in order of arrival
    changes its last bits from run to run, and with them what is rounded at a tie or held against a limit."""
    return rows.withColumn("s", F.sum(value).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def weighted_duration(slices: DataFrame, key: str = KEY) -> DataFrame:
    """(key, weighted_s): seconds times weight of a sweep, added in order of time."""
    return added(slices, (F.col("right_s") - F.col("left_s")) * F.col("weight"), "left_s", key).groupBy(key).agg(F.max_by("s", "left_s").alias("weighted_s"))


def partition(intervals: DataFrame, key: str = KEY, grid: float = 0.01) -> DataFrame:
    """(key, start_s, end_s): [0, duration] cut at the interval ends, rounded to the grid."""
    at = lambda c: F.rint(c / grid) * grid
    points = intervals.select(key, F.explode(F.array(F.lit(0.0), F.col("duration"), F.greatest(F.lit(0.0), F.least("duration", "start_s")), F.greatest(F.lit(0.0), F.least("duration", "end_s")))).alias("p")).select(key, at(F.col("p")).alias("start_s"))
    return points.withColumn("end_s", F.lead("start_s").over(Window.partitionBy(key).orderBy("start_s"))).where("end_s is not null and end_s - start_s > 0.005")


def within(points: DataFrame, windows: DataFrame, key: str, at: str) -> DataFrame:
    """Points inside windows of the same key, both ends included; a null bound is open."""
    w = windows.withColumnRenamed(key, "__k")
    return points.join(w, (F.col(key) == F.col("__k")) & (F.col("start").isNull() | (F.col(at) >= F.col("start"))) & (F.col("end").isNull() | (F.col(at) <= F.col("end")))).drop("__k")
