"""Detectors: each takes frames (and episodes) and gives findings as rows of one schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from epiframe.operators import intervals as I
from epiframe.operators import signals as S

COLUMNS = ("episode_index", "issue_code", "severity", "confidence", "start_s", "end_s", "hard_invalid")


def _findings(d: DataFrame, code: str, severity: str, confidence: float, hard: bool = False) -> DataFrame:
    have = lambda c: F.col(c) if c in d.columns else F.lit(None).cast("double").alias(c)
    return d.select("episode_index", F.lit(code).alias("issue_code"), F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), have("start_s"), have("end_s"), F.lit(hard).alias("hard_invalid"))


def jitter(frames: DataFrame, fps: float, *, window: float = 0.4, reversals: int = 1, excess: float = 0.5, minimum: float = 0.08, merge_gap: float = 0.15, context: float = 0.1, value: str = "value", **limits) -> DataFrame:
    """Spans in which the signal shakes: joint outliers of acceleration and jerk with a turn and backtracking near."""
    radius = max(1, max(2, round(window * fps)) // 2)
    hits = S.jitter_hits(frames, fps, value=value, **limits).select("episode_index", "frame_index", "hit")
    near = S.local_motion(frames, radius, limits.get("least_range", 0.001), value)
    marked = near.join(hits, ["episode_index", "frame_index"]).withColumn("shakes", F.col("hit") & F.coalesce((F.col("reversals") >= reversals) & (F.col("excess") >= excess), F.lit(False)))
    return _findings(I.mask_to_intervals(marked, "shakes", fps, minimum, merge_gap, context), "motion/jitter", "error", 0.9)


def stationary(frames: DataFrame, fps: float, delta: float = 0.0005, minimum: float = 3.0, value: str = "value") -> DataFrame:
    d = S.derivatives(frames, 1.0, value).withColumn("still", F.coalesce(F.abs("velocity") <= delta, F.lit(False)))
    return _findings(I.mask_to_intervals(d, "still", fps, minimum), "motion/stationary", "warning", 0.9)


def near_zero(frames: DataFrame, least: float = 0.01, value: str = "value") -> DataFrame:
    d = frames.groupBy("episode_index").agg((F.max(value) - F.min(value)).alias("span")).where(F.col("span") < least)
    return _findings(d, "motion/near_zero_episode", "error", 0.95)


def chatter(frames: DataFrame, fps: float, delta: float = 0.2, most: float = 4.0, value: str = "value") -> DataFrame:
    """Episodes whose gripper moves more than ``most`` times a second, from the first to the last move."""
    n = frames.groupBy("episode_index").agg((F.count(F.lit(1)) / fps).alias("duration"))
    t = S.transitions(frames, delta, value).groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.min("frame_index").alias("a"), F.max("frame_index").alias("b")).join(n, "episode_index")
    d = t.where(F.col("n") / F.greatest("duration", F.lit(1e-6)) > most).select("episode_index", (F.col("a") / fps).alias("start_s"), F.least("duration", (F.col("b") + 1) / fps).alias("end_s"))
    return _findings(d, "manipulation/gripper_chatter", "error", 0.9)


def regrasp(frames: DataFrame, fps: float, delta: float = 0.2, window: float = 5.0, value: str = "value") -> DataFrame:
    n = frames.groupBy("episode_index").agg((F.count(F.lit(1)) / fps).alias("duration"))
    d = S.regrasps(frames, delta, max(1, int(window * fps)), value).join(n, "episode_index")
    d = d.select("episode_index", F.greatest(F.lit(0.0), (F.col("f1") - 1) / fps).alias("start_s"), F.least("duration", (F.col("f3") + 1) / fps).alias("end_s"))
    return _findings(d, "manipulation/regrasp_candidate", "warning", 0.65)


def integrity(frames: DataFrame, episodes: DataFrame, fps: float, value: str = "value", tolerance: int = 2, ratio: float = 0.1) -> DataFrame:
    """Values that are not finite, missing signals, and lengths far from the episode's."""
    bad = F.col(value).isNull() | F.isnan(value) | (F.abs(value) == float("inf"))
    at = F.when(bad, F.col("frame_index"))
    s = frames.groupBy("episode_index").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    e = episodes.select("episode_index", F.col("length").alias("expected")).join(s, "episode_index", "left")
    spoiled = e.where("a is not null").select("episode_index", (F.col("a") / fps).alias("start_s"), F.least(F.col("n") / fps, (F.col("b") + 1) / fps).alias("end_s"))
    off = F.abs(F.col("n") - F.col("expected")) > F.greatest(F.lit(tolerance).cast("long"), F.rint(F.col("expected") * ratio).cast("long"))
    out = _findings(e.where("n is null"), "integrity/missing_action", "fatal", 1.0, True)
    out = out.unionByName(_findings(spoiled, "integrity/non_finite_signal", "fatal", 1.0, True))
    return out.unionByName(_findings(e.where("expected > 0").where(off), "integrity/signal_length_mismatch", "fatal", 1.0, True))


def signal_integrity(signals: DataFrame, episodes: DataFrame, fps: float, required: tuple[str, ...] = ("action",), tolerance: int = 2, ratio: float = 0.1) -> DataFrame:
    """Findings on whole vector signals, with their ``signal_key``: missing, ragged, without dimensions, not finite, and of
    another length than the episode or than one another. A ragged signal is looked at no further, one without dimensions
    only as to the others' lengths. ``signals``: episode_index, signal_key, frame_index, value (array of double; null
    values and null elements are not finite)."""
    finite = F.coalesce(F.forall("value", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    at = F.when(~finite, F.col("frame_index"))
    s = signals.groupBy("episode_index", "signal_key").agg(
        F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"), F.min(F.size("value")).alias("narrow"), F.max(F.size("value")).alias("wide")
    )
    e = episodes.select("episode_index", F.col("length").alias("expected"))
    wanted = e.select("episode_index", F.explode(F.array(*[F.lit(k) for k in required]).cast("array<string>")).alias("signal_key"))
    missing = wanted.join(s, ["episode_index", "signal_key"], "left_anti").withColumn("code", F.concat(F.lit("integrity/missing_"), F.element_at(F.split("signal_key", "[.]"), -1)))
    near = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(tolerance).cast("long"), F.rint(F.greatest(a, b) * ratio).cast("long"))
    expected_near = F.abs(F.col("n") - F.col("expected")) <= F.greatest(F.lit(tolerance).cast("long"), F.rint(F.col("expected") * ratio).cast("long"))
    ragged, flat = F.col("narrow") != F.col("wide"), F.col("wide") <= 0
    code = lambda c, name: F.when(c, F.lit(f"integrity/{name}"))
    codes = F.array(
        code(ragged, "invalid_signal_shape"), code(~ragged & flat, "empty_signal"), code(~ragged & ~flat & F.col("a").isNotNull(), "non_finite_signal"),
        code(~ragged & ~flat & (F.col("expected") > 0) & ~expected_near, "signal_length_mismatch"),
    )
    own = s.join(e, "episode_index").withColumn("code", F.explode(F.filter(codes, lambda c: c.isNotNull())))
    timed = F.col("code") == "integrity/non_finite_signal"
    own = own.withColumn("start_s", F.when(timed, F.col("a") / fps)).withColumn("end_s", F.when(timed, F.least(F.col("n") / fps, (F.col("b") + 1) / fps)))
    lengths = s.where(~ragged).join(e, "episode_index", "left_semi").groupBy("episode_index").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    apart = lengths.where(~near(F.col("most"), F.col("least"))).select("episode_index", F.lit(None).cast("string").alias("signal_key"), F.lit("integrity/action_state_length_mismatch").alias("code"))
    found = own.select("episode_index", "signal_key", "code", "start_s", "end_s").unionByName(missing.select("episode_index", "signal_key", "code").unionByName(apart), allowMissingColumns=True)
    return found.select("episode_index", F.col("code").alias("issue_code"), F.lit("fatal").alias("severity"), F.lit(1.0).alias("confidence"), "start_s", "end_s", F.lit(True).alias("hard_invalid"), "signal_key")


#: Detectors by name; others can be added, as functions of (frames, episodes, fps) to findings.
DETECTORS: dict[str, Callable[[DataFrame, DataFrame, float], DataFrame]] = {
    "signal_integrity": lambda f, e, fps: signal_integrity(f.select("episode_index", F.lit("action").alias("signal_key"), "frame_index", F.array(F.col("value").cast("double")).alias("value")), e, fps).select(*COLUMNS),
    "motion": lambda f, e, fps: jitter(f, fps).unionByName(stationary(f, fps)).unionByName(near_zero(f)),
    "gripper": lambda f, e, fps: chatter(f, fps).unionByName(regrasp(f, fps)),
}


def scan(frames: DataFrame, episodes: DataFrame, fps: float, names: tuple[str, ...] = tuple(DETECTORS)) -> DataFrame:
    """Findings of the named detectors in one lazy plan."""
    found = [DETECTORS[n](frames, episodes, fps) for n in names]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def per_dimension(name: str, signal: str = "action") -> Callable[[DataFrame, DataFrame, float], DataFrame]:
    """A detector of plain signals as one of vector signals (episode_index, signal_key, frame_index, value): each
    dimension is looked at alone, and equal findings of several are one."""

    def run(signals: DataFrame, episodes: DataFrame, fps: float) -> DataFrame:
        rows = signals.where(F.col("signal_key") == signal).select("episode_index", "frame_index", F.posexplode("value").alias("dim", "value"))
        rows = rows.select(F.struct("episode_index", "dim").alias("episode_index"), "frame_index", "value")
        return DETECTORS[name](rows, episodes, fps).withColumn("episode_index", F.col("episode_index.episode_index")).distinct()

    return run


#: Detectors of vector signals, with their weight in the coverage.
VECTOR_DETECTORS: dict[str, tuple[Callable[[DataFrame, DataFrame, float], DataFrame], float]] = {
    "signal_integrity": (lambda s, e, fps: signal_integrity(s, e, fps).select(*COLUMNS), 1.0),
    "motion": (per_dimension("motion"), 1.0),
    "gripper": (per_dimension("gripper"), 1.0),
}
