"""Scores and decisions of episodes, and queries over a report of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from epiframe.operators import intervals as I

#: Fixed values of the score: weight of a timed finding, and penalty of an untimed one.
SEVERITY_WEIGHTS = {"info": 0.0, "warning": 0.25, "error": 1.0, "fatal": 1.0}
UNTIMED = {"fatal": 100.0, "error": 25.0, "warning": 5.0}
PASS_QUALITY, PASS_USABLE, MIN_COVERAGE = 80.0, 90.0, 80.0


def _by_severity(values: dict[str, float]) -> Column:
    out = F.lit(0.0)
    for k, v in values.items():
        out = F.when(F.col("severity") == k, F.lit(v)).otherwise(out)
    return out


def score_episodes(episodes: DataFrame, findings: DataFrame) -> DataFrame:
    """usable_ratio, quality_score, coverage, integrity_status and auto_decision per episode.

    ``episodes``: episode_index, duration, coverage. ``findings``: episode_index, severity, confidence, start_s,
    end_s, hard_invalid.
    """
    known = findings.where(F.col("episode_index").isNotNull())
    timed = F.coalesce(F.col("end_s") > F.col("start_s"), F.lit(False))
    bad = timed & F.col("severity").isin("error", "fatal")
    f = known.select("episode_index", F.when(bad, F.greatest(F.lit(0.0), "start_s")).alias("a"), F.when(bad, F.col("end_s").cast("double")).alias("end_s"), _by_severity(UNTIMED).alias("flat"), F.when(~timed, _by_severity(UNTIMED)).alias("untimed"), F.col("hard_invalid").alias("hard"), (F.col("severity") == "fatal").alias("fatal"), (F.col("severity") == "error").alias("error"))
    # An episode's row comes before the intervals of its findings and tells them its duration, so nothing is joined.
    rows = I.dealt(f.unionByName(episodes.select("episode_index", "duration", "coverage", F.lit(True).alias("own")), allowMissingColumns=True))
    w = Window.partitionBy("episode_index").orderBy("a", "end_s")
    rows = rows.withColumn("b", F.when(F.col("a").isNotNull(), F.least(F.max("duration").over(w.rowsBetween(Window.unboundedPreceding, 0)), "end_s")))
    opened = F.coalesce((F.col("a") > F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))).cast("int"), F.lit(0))
    groups = rows.withColumn("o", opened).withColumn("g", F.sum("o").over(w))
    flags = ("duration", "coverage", "own", "flat", "untimed", "hard", "fatal", "error")
    parts = groups.groupBy("episode_index", "g").agg((F.max("b") - F.min("a")).alias("covered_s"), *[F.max(c).alias(c) for c in flags])
    e = I.added(parts, F.col("covered_s"), "g").groupBy("episode_index").agg(F.max_by("s", "g").alias("covered_s"), *[F.max(c).alias(c) for c in flags]).where("own")
    weighed = known.where(timed).select("episode_index", "start_s", "end_s", (_by_severity(SEVERITY_WEIGHTS) * F.coalesce("confidence", F.lit(1.0))).alias("weight"))
    penalty = I.weighted_duration(I.sweep(weighed, episodes))
    e = e.withColumn("untimed", F.when(F.col("duration") <= 0, F.col("flat")).otherwise(F.col("untimed"))).join(penalty, "episode_index", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    usable = F.when(no("hard"), 0.0).when(F.col("duration") <= 0, 100.0).otherwise(100.0 * (F.col("duration") - F.coalesce("covered_s", F.lit(0.0))) / F.col("duration"))
    time_part = F.when(F.col("duration") > 0, F.coalesce("weighted_s", F.lit(0.0)) / F.col("duration") * 100.0).otherwise(0.0)
    quality = F.when(no("hard"), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100.0 - time_part - F.coalesce("untimed", F.lit(0.0)))))
    e = e.withColumns({"usable_ratio": usable, "quality_score": quality})
    good = (F.col("quality_score") >= PASS_QUALITY) & (F.col("usable_ratio") >= PASS_USABLE) & (F.col("coverage") >= MIN_COVERAGE) & ~no("error")
    decision = F.when(no("hard") | no("fatal"), "quarantine").when(good, "pass").otherwise("review")
    return e.select("episode_index", F.when(no("hard"), "invalid").otherwise("valid").alias("integrity_status"), "usable_ratio", "quality_score", "coverage", decision.alias("auto_decision"))


def coverage(detectors: DataFrame) -> DataFrame:
    """Weight of completed among applicable detectors, in percent; 100 where none applies."""
    w = F.col("coverage_weight")
    done = F.sum(F.when(F.col("applicable") & (F.col("status") == "completed"), w).otherwise(0.0))
    able = F.sum(F.when(F.col("applicable"), w).otherwise(0.0))
    return detectors.groupBy("episode_index").agg(F.when(able <= 0, 100.0).otherwise(100.0 * done / able).alias("coverage"))


def open_findings(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Findings that no review has rejected, with their review status."""
    f = findings.join(reviews.select("finding_id", "review_status"), "finding_id", "left")
    return f.where(F.coalesce("review_status", F.lit("unreviewed")) != "rejected")


def summary_totals(episodes: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(c)
    avg = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return episodes.agg(
        F.count(F.lit(1)).alias("episodes"), n(F.col("integrity_status") == "invalid").alias("invalid"), *[n(F.col("auto_decision") == d).alias(f"n_{d}") for d in ("pass", "review", "quarantine")],
        avg("quality_score").alias("average_quality"), avg("usable_ratio").alias("average_usable"), avg("coverage").alias("average_coverage"),
    )


def issue_histogram(findings: DataFrame, reviews: DataFrame) -> DataFrame:
    return open_findings(findings, reviews).groupBy("issue_code", "severity").agg(F.count(F.lit(1)).alias("count"), F.countDistinct("episode_index").alias("episodes"))


def detector_coverage(runs: DataFrame) -> DataFrame:
    """Completed, skipped and failed episodes per detector; a detector skipped everywhere is skipped."""
    c = lambda s: F.count_if(F.col("status") == s)
    d = runs.groupBy("detector_id").agg(F.count(F.lit(1)).alias("total"), *[c(s).alias(f"n_{s}") for s in ("completed", "skipped", "failed")])
    return d.select("*", F.round(100.0 * F.col("n_completed") / F.col("total"), 3).alias("coverage"), F.when(F.col("n_skipped") == F.col("total"), "skipped").otherwise("completed").alias("status"))


def effective_decision(episodes: DataFrame) -> DataFrame:
    return episodes.withColumn("decision", F.coalesce("manual_decision", "auto_decision"))


def query_episodes(episodes: DataFrame, findings: DataFrame, reviews: DataFrame, *, integrity: str | None = None, decision: str | None = None, minimum: dict[str, float] | None = None, issues: list[str] | None = None, search: str | None = None, sort: str = "episode_index", descending: bool = False, limit: int = 100, offset: int = 0) -> DataFrame:
    """A page of the report. Sort keys other than the five known fall back to the episode; limit is clamped to
    1 .. 500 (0 means 100); ties go by episode."""
    open_ = open_findings(findings, reviews)
    e = effective_decision(episodes)
    if integrity in ("valid", "invalid", "unknown"):
        e = e.where(F.col("integrity_status") == integrity)
    if decision in ("pass", "review", "quarantine"):
        e = e.where(F.col("decision") == decision)
    for column, least in (minimum or {}).items():
        e = e.where(F.col(column) >= least)
    if issues:
        e = e.join(open_.where(F.col("issue_code").isin(issues)).select("episode_index").distinct(), "episode_index", "left_semi")
    if search:
        e = e.where(F.col("episode_index").cast("string").ilike(f"%{search}%") | F.col("task_text").ilike(f"%{search}%"))
    counts = open_.groupBy("episode_index").agg(F.count(F.lit(1)).alias("finding_count"))
    e = e.join(counts, "episode_index", "left").withColumn("finding_count", F.coalesce("finding_count", F.lit(0).cast("long")))
    by = sort if sort in ("episode_index", "quality_score", "usable_ratio", "coverage", "finding_count") else "episode_index"
    e = e.orderBy(F.col(by).desc() if descending else F.col(by).asc(), "episode_index")
    return e.offset(max(0, offset)).limit(min(500, max(1, limit or 100)))


def selection(episodes: DataFrame, decision: str) -> DataFrame:
    """Episodes of a decision, valid ones apart from invalid ones."""
    e = effective_decision(episodes).where(F.col("decision") == decision)
    return e.select("episode_index", F.when(F.col("integrity_status") == "invalid", "invalid").otherwise("selected").alias("part"))


def normalize_decision(c: Column) -> Column:
    """Old names to new ones; what is unknown needs a review."""
    d = F.lower(F.trim(c))
    return F.when(d.isin("pass", "keep"), "pass").when(d.isin("quarantine", "exclude"), "quarantine").otherwise("review")


def latest(rows: DataFrame, keys: list[str], order: str, tie: str, keep: int = 1) -> DataFrame:
    """The newest ``keep`` rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc(), F.col(tie).desc())
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)
