"""Findings from frame metrics: exposure, blur, and frozen video weighed against the robot's own motion.

Input rows, one a sampled frame: episode_index, camera_key, frame_index (of the sample), mean_luma, blur, and from the
frame before ``change`` (mean absolute) and ``changed_ratio``; both are null for a camera's first frame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators import intervals as I

#: Fixed values of the checks.
DARK, BRIGHT, BLUR, ISSUE_SECONDS, ISSUE_GAP = 40.0, 245.0, 35.0, 0.5, 0.25
FREEZE_DELTA, FREEZE_CHANGED, FREEZE_SECONDS, FREEZE_GAP, FREEZE_MOTION, FREEZE_HARD = 0.75, 0.01, 2.0, 0.1, 0.02, 0.5
SHAKE_CHANGE, SHAKE_CHANGES, SHAKE_GAP = 4.0, 2, 0.2
STATIC_WORDS, MOVING_WORDS = ("base", "head", "main", "front", "overhead"), ("wrist", "hand", "eef")
CONTEXT = 0.1
CAMERA = ("episode_index", "camera_key")


def _keyed(spans: DataFrame) -> DataFrame:
    return spans.select("camera.*", "start_s", "end_s")


def exposure_findings(metrics: DataFrame, fps: float) -> DataFrame:
    """Spans that are dark, overexposed or blurred, padded by the context: (episode_index, camera_key, issue_code,
    start_s, end_s)."""
    rows, out = metrics.withColumn("camera", F.struct(*CAMERA)), None
    for code, mask in (("visual/dark", F.col("mean_luma") < DARK), ("visual/overexposed", F.col("mean_luma") > BRIGHT), ("visual/blur", F.col("blur") < BLUR)):
        found = _keyed(I.mask_to_intervals(rows.withColumn("__m", F.coalesce(mask, F.lit(False))), "__m", fps, ISSUE_SECONDS, ISSUE_GAP, CONTEXT, key="camera"))
        found = found.select("episode_index", "camera_key", F.lit(code).alias("issue_code"), "start_s", "end_s")
        out = found if out is None else out.unionByName(found)
    return out


def freeze_candidates(metrics: DataFrame, fps: float) -> DataFrame:
    """(episode_index, camera_key, start_s, end_s) of spans without change. The change at a frame is of the span that
    ends there, so a camera's first frame does not count and the others move up by one."""
    still = F.coalesce((F.col("change") <= FREEZE_DELTA) & (F.col("changed_ratio") <= FREEZE_CHANGED), F.lit(False))
    steps = metrics.where("frame_index > 0").select(F.struct(*CAMERA).alias("camera"), (F.col("frame_index") - 1).alias("frame_index"), still.alias("still"))
    return _keyed(I.mask_to_intervals(steps, "still", fps, FREEZE_SECONDS, FREEZE_GAP, key="camera"))


def motion_evidence(spans: DataFrame, signals: DataFrame, fps: float) -> DataFrame:
    """Adds ``motion``, the largest share of a dimension's own 1 to 99 % range that it covers within the span; null
    where the episode has no finite signal. Each signal is judged alone: one that is not finite leaves the others be.
    ``signals``: episode_index, dim, frame_index, value, and signal_key where there are several."""
    signals = signals if "signal_key" in signals.columns else signals.withColumn("signal_key", F.lit(""))
    own, v = ["episode_index", "signal_key"], F.col("value").cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    whole = signals.groupBy(*own, "dim").agg(F.percentile("value", F.array(F.lit(0.01), F.lit(0.99))).alias("q"), F.max(bad).alias("bad"), F.count(F.lit(1)).alias("n"))
    usable = whole.groupBy(*own).agg((~F.max("bad") & (F.min("n") >= 2)).alias("usable")).where("usable")
    ranges = whole.join(usable, own, "left_semi").select(*own, "dim", (F.col("q")[1] - F.col("q")[0]).alias("range"))
    numbered = spans.withColumns({"__a": F.floor(F.col("start_s") * fps), "__b": F.ceil(F.col("end_s") * fps)})
    met = numbered.join(signals.join(ranges, [*own, "dim"]), "episode_index").where("frame_index between __a and __b")
    local = met.groupBy(*own, "camera_key", "start_s", "end_s", "dim").agg((F.max("value") - F.min("value")).alias("span"), F.first("range").alias("range"))
    share = F.max(F.when(F.col("range") > 2.220446049250313e-16, F.col("span") / F.col("range")))
    found = local.groupBy("episode_index", "camera_key", "start_s", "end_s").agg(F.coalesce(share, F.lit(0.0)).alias("motion"))
    seen = usable.select("episode_index", F.col("usable").alias("__seen")).distinct()
    return spans.join(found, ["episode_index", "camera_key", "start_s", "end_s"], "left").join(seen, "episode_index", "left").withColumn("motion", F.coalesce("motion", F.when(F.col("__seen"), F.lit(0.0)))).drop("__seen")


def freeze_findings(metrics: DataFrame, signals: DataFrame, fps: float, signal_fps: float) -> DataFrame:
    """Frozen spans: those in which the robot moved, or whose episode tells nothing about that. Half of an episode
    frozen while it moved makes the video invalid."""
    spans = motion_evidence(freeze_candidates(metrics, fps), signals, signal_fps).where("motion is null or motion >= %s" % FREEZE_MOTION)
    duration = metrics.groupBy("episode_index", "camera_key").agg((F.count(F.lit(1)) / fps).alias("duration"))
    d = spans.join(duration, ["episode_index", "camera_key"])
    frozen = F.sum(F.least("end_s", "duration") - F.greatest(F.lit(0.0), F.col("start_s"))).over(Window.partitionBy("episode_index", "camera_key"))
    hard = (F.col("duration") > 0) & (F.col("frozen_s") / F.col("duration") >= FREEZE_HARD) & F.col("motion").isNotNull()
    d = d.withColumn("frozen_s", frozen).withColumn("hard_invalid", hard)
    return d.select(
        "episode_index", "camera_key", F.when(F.col("hard_invalid"), "integrity/video_frozen").otherwise("visual/frozen").alias("issue_code"), F.when(F.col("hard_invalid"), "fatal").otherwise("error").alias("severity"),
        F.when(F.col("motion").isNotNull(), 0.95).otherwise(0.7).alias("confidence"), F.greatest(F.lit(0.0), F.col("start_s") - CONTEXT).alias("start_s"), F.least("duration", F.col("end_s") + CONTEXT).alias("end_s"), "hard_invalid", "motion", "frozen_s",
    )


def camera_findings(metrics: DataFrame, expected: DataFrame, least: float = 0.9) -> DataFrame:
    """Cameras without frames, or with fewer than the share ``least`` of the expected ones: (episode_index, camera_key,
    issue_code). ``expected``: episode_index, camera_key, expected."""
    n = metrics.groupBy("episode_index", "camera_key").agg(F.count(F.lit(1)).alias("n"))
    d = expected.join(n, ["episode_index", "camera_key"], "left")
    code = F.when(F.col("n").isNull(), "integrity/empty_video").when((F.col("expected") > 0) & (F.col("n") / F.col("expected") < least), "integrity/video_frame_count_mismatch")
    return d.select("episode_index", "camera_key", code.alias("issue_code")).where("issue_code is not null")


def luma_summary(metrics: DataFrame) -> DataFrame:
    """Per episode: medians over cameras of each camera's median luma, and the largest share of dark and of bright clipped
    pixels of a camera (of all pixels of its frames, which are of one size)."""
    shares = [F.avg(c).alias(f"{c}_ratio") for c in ("dark", "bright")]
    cameras = metrics.groupBy("episode_index", "camera_key").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("p10", "p50", "p90")], *shares)
    return cameras.groupBy("episode_index").agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("p10", "p50", "p90")], F.max("dark_ratio").alias("dark_ratio"), F.max("bright_ratio").alias("bright_ratio"))


def is_static_camera(key: Column, configured: tuple[str, ...] = ()) -> Column:
    """Cameras that stand still: those that are named, where any are, else by words in the key, in any case."""
    if configured:
        return key.isin(*configured)
    has = lambda words: F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.lower(key).contains(w))
    return has(STATIC_WORDS) & ~has(MOVING_WORDS)


def motion_changes(samples: DataFrame) -> DataFrame:
    """Adds ``change``: the distance of the vector ``motion`` (from the sampled frame before) from that of the frame
    before; null unless both are there and finite."""
    d = samples.withColumn("__ok", F.coalesce((F.size("motion") > 0) & F.forall("motion", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    w = Window.partitionBy(*CAMERA).orderBy("frame_index")
    squares = F.aggregate(F.zip_with("motion", F.lag("motion").over(w), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda n, x: n + x)
    return d.withColumn("change", F.when(F.col("__ok") & F.lag("__ok", 1, False).over(w), F.sqrt(squares)))


def shake_findings(samples: DataFrame, fps: float) -> DataFrame:
    """Spans in which a standing camera shakes, with the camera's largest change and figures of its reliable pairs:
    episode_index, camera_key, issue_code, start_s, end_s, change_max, inlier_median, coverage_median, tracked_min.

    ``samples``, one row a sampled frame: episode_index, camera_key, frame_index (of the sample), motion (array of double,
    null for the first frame and where it could not be estimated), inlier_ratio, spatial_coverage, tracked_points."""
    d = motion_changes(samples.where(is_static_camera(F.col("camera_key")))).withColumn("__m", F.coalesce(F.col("change") > SHAKE_CHANGE, F.lit(False))).withColumn("camera", F.struct(*CAMERA))
    median = lambda c: F.coalesce(F.percentile(F.when(F.col("__ok"), F.col(c)), F.lit(0.5)), F.lit(0.0))
    figures = d.groupBy(*CAMERA).agg(
        F.coalesce(F.max("change"), F.lit(0.0)).alias("change_max"), median("inlier_ratio").alias("inlier_median"), median("spatial_coverage").alias("coverage_median"),
        F.coalesce(F.min(F.when(F.col("__ok"), F.col("tracked_points"))), F.lit(0)).alias("tracked_min"),
    )
    spans = _keyed(I.mask_to_intervals(d, "__m", fps, SHAKE_CHANGES / fps, SHAKE_GAP, CONTEXT, key="camera"))
    return spans.join(figures, list(CAMERA)).select(*CAMERA, F.lit("visual/camera_shake").alias("issue_code"), "start_s", "end_s", "change_max", "inlier_median", "coverage_median", "tracked_min")
