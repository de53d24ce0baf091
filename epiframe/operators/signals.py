"""Sequence operators over frames: every one is a window or a grouped aggregate per episode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gap_split(rows: DataFrame, key: str, t: str, tie: str, gap: float) -> DataFrame:
    """Segments of a stream: a new one starts where the step in ``t`` is strictly greater than ``gap``.
    Adds ``segment`` (from 0) and ``position``."""
    w = Window.partitionBy(key).orderBy(t, tie)
    opened = F.coalesce((F.col(t) - F.lag(t).over(w) > gap).cast("int"), F.lit(0))
    return rows.withColumns({"position": (F.row_number().over(w) - 1).cast("long"), "__open": opened}).withColumn("segment", F.sum("__open").over(w).cast("long")).drop("__open")


def segments(rows: DataFrame, key: str, t: str) -> DataFrame:
    """One row a segment: first and last position, length and span."""
    return rows.groupBy(key, "segment").agg(F.min("position").alias("first_index"), F.max("position").alias("last_index"), F.count(F.lit(1)).alias("length"), (F.max(t) - F.min(t)).alias("span"))


def global_index(frames: DataFrame, key: str = "episode_index", order: str = "frame_index", name: str = "index") -> DataFrame:
    """A number over all frames in (episode, frame) order: offsets are summed over episode lengths, so no window
    goes over all frames."""
    lengths = frames.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    offsets = lengths.withColumn("__from", F.coalesce(F.sum("__n").over(Window.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return frames.join(offsets, key).withColumn(name, (F.col("__from") + F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1).cast("long")).drop("__from")


def derivatives(frames: DataFrame, fps: float, value: str = "value", key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """velocity, acceleration and jerk: successive differences times fps, null where there is no step."""
    w = Window.partitionBy(key).orderBy(order)
    out = frames
    for name, of in (("velocity", value), ("acceleration", "velocity"), ("jerk", "acceleration")):
        out = out.withColumn(name, (F.col(of) - F.lag(of).over(w)) * fps)
    return out


def robust_z(frames: DataFrame, value: str, key: str = "episode_index", name: str = "z") -> DataFrame:
    """(x - median) / scale per episode; scale is 1.4826 MAD, or the 75 % point of deviations where that is 0."""
    median = frames.groupBy(key).agg(F.percentile(value, F.lit(0.5)).alias("__median"))
    with_dev = frames.join(median, key).withColumn("__dev", F.abs(F.col(value) - F.col("__median")))
    scale = with_dev.groupBy(key).agg(F.percentile("__dev", F.array(F.lit(0.5), F.lit(0.75))).alias("__q"))
    mad = 1.4826 * F.col("__q")[0]
    s = F.when(mad > 1e-9, mad).otherwise(F.greatest(F.col("__q")[1], F.lit(1e-6)))
    return with_dev.join(scale, key).withColumn(name, (F.col(value) - F.col("__median")) / s).drop("__median", "__dev", "__q")


def signal_range(frames: DataFrame, value: str, key: str = "episode_index", least: float = 0.001) -> DataFrame:
    """1 % and 99 % points, their distance, and whether the dimension moves at all."""
    q = frames.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.01), F.lit(0.99))).alias("q"))
    span = F.greatest(F.lit(0.0), F.col("q")[1] - F.col("q")[0])
    return q.select(key, F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), span.alias("range"), (span >= least).alias("active"))


def jitter_hits(frames: DataFrame, fps: float, accel_z: float = 8.0, jerk_z: float = 8.0, accel_ratio: float = 0.15, jerk_ratio: float = 0.3, least_range: float = 0.001, align: int = 1, value: str = "value", key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """Frames with high acceleration and, within ``align`` frames, high jerk, each by robust z and by share of the
    signal's range."""
    d = derivatives(frames, fps, value, key, order)
    za = robust_z(d.where("acceleration is not null"), "acceleration", key, "za").select(key, order, "za")
    zj = robust_z(d.where("jerk is not null"), "jerk", key, "zj").select(key, order, "zj")
    r = signal_range(frames, value, key, least_range).select(key, "range", "active")
    d = d.join(za, [key, order], "left").join(zj, [key, order], "left").join(r, key)
    safe = F.greatest(F.col("range"), F.lit(2.220446049250313e-16))
    hit = lambda z, limit, x, power, ratio: F.coalesce((F.abs(z) > limit) & (F.abs(x) / (safe * fps**power) > ratio) & F.col("active"), F.lit(False))
    d = d.withColumns({"a_hit": hit(F.col("za"), accel_z, F.col("acceleration"), 2, accel_ratio), "j_hit": hit(F.col("zj"), jerk_z, F.col("jerk"), 3, jerk_ratio)})
    near = Window.partitionBy(key).orderBy(order).rowsBetween(-align, align)
    return d.withColumn("hit", F.col("a_hit") & F.max("j_hit").over(near))


def local_motion(frames: DataFrame, radius: int, least_range: float = 0.001, value: str = "value", key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """Reversals and excess travel in the window of ``radius`` frames around each frame (null under 3 frames)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(-radius, radius)
    d = frames.withColumn("__w", F.collect_list(value).over(w))
    d = d.withColumns({"__steps": F.when(F.size("__w") >= 3, F.transform(F.sequence(F.lit(1), F.size("__w") - 1), lambda i: F.get("__w", i) - F.get("__w", i - 1))), "__span": F.array_max("__w") - F.array_min("__w")})
    limit = F.greatest(F.lit(2.220446049250313e-16), F.lit(least_range * 0.05), F.col("__span") * 0.01)
    d = d.withColumn("__limit", limit).withColumn("__signs", F.transform(F.filter("__steps", lambda s: F.abs(s) >= F.col("__limit")), F.sign))
    turns = F.size(F.filter(F.transform("__signs", lambda s, i: (i > 0) & (F.get("__signs", i - 1) != s)), lambda x: x))
    travel = F.aggregate("__steps", F.lit(0.0), lambda a, s: a + F.abs(s))
    net = F.abs(F.element_at("__w", -1) - F.get("__w", F.lit(0)))
    excess = F.greatest(F.lit(0.0), travel - net) / F.greatest(F.col("__span"), F.lit(2.220446049250313e-16))
    ok = F.col("__steps").isNotNull()
    return d.withColumns({"reversals": F.when(ok, turns), "excess": F.when(ok, excess)}).drop("__w", "__steps", "__span", "__limit", "__signs")


def transitions(frames: DataFrame, delta: float, value: str = "value", key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """Frames whose step from the frame before is ``delta`` or more, with the step."""
    w = Window.partitionBy(key).orderBy(order)
    return frames.withColumn("step", F.col(value) - F.lag(value).over(w)).where(F.abs("step") >= delta)


def regrasps(frames: DataFrame, delta: float, window: int, value: str = "value", key: str = "episode_index", order: str = "frame_index") -> DataFrame:
    """The first three successive transitions of an episode, within ``window`` frames, whose directions alternate."""
    w = Window.partitionBy(key).orderBy(order)
    t = transitions(frames, delta, value, key, order)
    t = t.withColumns({"f2": F.lead(order, 1).over(w), "f3": F.lead(order, 2).over(w), "s2": F.lead("step", 1).over(w), "s3": F.lead("step", 2).over(w)})
    ok = (F.col("f3") - F.col(order) <= window) & (F.sign("step") == F.sign("s3")) & (F.sign("step") != F.sign("s2"))
    first = t.where(ok).groupBy(key).agg(F.min(F.struct(F.col(order).alias("f1"), "f2", "f3")).alias("x"))
    return first.select(key, "x.f1", "x.f2", "x.f3")


def downsample(rows: DataFrame, keys: list[str], order: str, cap: int, even: bool = True) -> DataFrame:
    """At most ``cap`` rows of each group: evenly from first to last (half-even rounding), or at floor(i n / cap)."""
    w = Window.partitionBy(*keys)
    d = rows.withColumns({"__n": F.count(F.lit(1)).over(w), "__i": (F.row_number().over(w.orderBy(order)) - 1)})
    step = (F.col("__n") - 1) / F.lit(float(max(1, cap - 1))) if even else F.col("__n") / F.lit(float(cap))
    at = lambda k: F.rint(k * step) if even else F.floor(k * F.col("__n") / cap)
    # the pick that could fall on row i is the i / step'th or a neighbour of it
    near = F.floor(F.col("__i") / F.greatest(step, F.lit(1e-9)))
    hit = F.lit(False)
    for off in (-1, 0, 1, 2):
        k = near + off
        hit = hit | ((k >= 0) & (k < cap) & (at(k).cast("long") == F.col("__i")))
    return d.where((F.col("__n") <= cap) | hit).drop("__n", "__i")


def nearest_rank(rows: DataFrame, keys: list[str], order: str, length: int) -> DataFrame:
    """Each group stretched or cut to ``length`` rows: row i is source row rint(i (n - 1) / (length - 1))."""
    d = rows.withColumn("__i", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))  # picks come from one row a group
    want = n.select(*keys, "__n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(length - 1).cast("long"))).alias("target"))
    want = want.select(*keys, "target", F.rint(F.col("target") * (F.col("__n") - 1) / float(max(1, length - 1))).cast("long").alias("__i"))
    return d.join(want, [*keys, "__i"]).select(*rows.columns, "target")


def positional_zip(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both sides by position within the key; the longer side's rest goes. Columns of the right get ``_r``."""
    n = lambda d: d.withColumn("position", (F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1).cast("long"))
    r = n(right)
    return n(left).join(r.select(*keys, "position", *[F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys]), [*keys, "position"])


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))
