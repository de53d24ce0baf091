"""Scans of a dataset by detectors, kept in a report and reused by fingerprint.

An episode's fingerprint is a digest of what its metadata say and of the size and time of the files that hold it, so a
file listing and the metadata tell what has changed. A scan whose dataset fingerprint and configuration are those of a
finished one is that one, and no frame is read; else only episodes that are new or have changed are read, and findings
of the others are taken over from the newest finished scan of the same dataset and configuration. A scan's row is
written last, so a broken scan is never found.

What cannot be read is a finding of its own, ``integrity/signal_read_error``, and a detector that fails has status
``failed`` with its reason; both let the scan go on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.functions.kernels import config_hash
from epiframe.operators import detectors as DT
from epiframe.operators.quality import coverage, score_episodes
from epiframe.sources import episodes as E
from epiframe.sources import log_episodes as L
from epiframe.sources import registry
from epiframe.sources.report import read_table, write_table

#: Episodes that are digested together.
TOGETHER = 4096
#: Changed episodes up to which the reader is told which; beyond them all files are read and others' rows dropped.
NAMED = 10_000
SIGNALS = ("action", "observation.state")
FINDINGS = "episode_index long, issue_code string, severity string, confidence double, start_s double, end_s double, hard_invalid boolean"
SCANS = "scan_id string, status string, dataset string, fingerprint string, config_hash string, finished_at string, episodes long, reused long"


def file_states(spark: SparkSession, path: str) -> DataFrame:
    """(path, state) of all files below a path, from the listing: contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return f.select("path", F.concat_ws(":", "length", F.date_format("modificationTime", "yyyyMMddHHmmss.SSSSSS")).alias("state"))


def episode_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """(episode_index, fingerprint)."""
    kind, states = E.detect_format(spark, path), file_states(spark, path)
    name = lambda c: F.regexp_replace(c, "^file:/*", "/")
    if kind == E.MESSAGE_LOG:
        e = L.episodes(spark, path, errors=True)
        about, key, place = [kind], name(F.col("file")), name(F.col("path"))
        told = F.to_json(F.struct("episode_index", "length", "duration", "cameras", "start", "end"))
    else:
        e = registry.adapter_of(spark, path).episodes(spark, path)
        info = E.read_info(spark, path)
        about = [kind, info.get("fps"), info.get("features"), info.get("robot_type")]
        told = F.to_json(F.struct("episode_index", "length", "duration", "tasks"))
        if kind == E.V3:
            rows = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/meta/episodes")
            at = rows.select("episode_index", F.format_string("data/chunk-%03d/file-%03d.parquet", F.col("`data/chunk_index`"), F.col("`data/file_index`")).alias("key"))
            e = e.join(at, "episode_index")
            key, place = F.col("key"), F.regexp_extract("path", r"(data/chunk-\d+/file-\d+\.parquet)$", 1)
        else:
            key, place = F.format_string("episode_%06d.parquet", "episode_index"), F.element_at(F.split("path", "/"), -1)
    known = states.select(place.alias("__key"), "state").where("__key <> ''")
    d = e.select("episode_index", told.alias("told"), key.alias("__key")).join(known, "__key", "left")
    return d.groupBy("episode_index").agg(F.sha2(F.concat_ws("|", F.lit(config_hash(about, 64)), F.max("told"), F.array_join(F.sort_array(F.collect_set("state")), ",")), 256).alias("fingerprint"))


def dataset_fingerprint(episode_rows: DataFrame) -> str:
    """A digest of all episodes' fingerprints in their order: of digests of ``TOGETHER`` each."""
    digest = lambda key: F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "fingerprint"))), lambda s: s["fingerprint"]), ""), 256).alias("fingerprint")
    d = episode_rows.groupBy(F.floor(F.col("episode_index") / TOGETHER).alias("__g")).agg(digest("episode_index"))
    return d.agg(digest("__g")).first().fingerprint


def dataset_id(path: str) -> str:
    return config_hash(path.rstrip("/"), 24)


def scans(spark: SparkSession, report: str) -> DataFrame:
    s = E.Store(spark, report)
    return spark.read.schema(SCANS).parquet(f"{report}/scans") if s.has("scans") else spark.createDataFrame([], SCANS)


def finished(spark: SparkSession, report: str, path: str, configuration: str, fingerprint: str | None = None) -> str | None:
    """The newest finished scan of a dataset with a configuration, and with a fingerprint where one is given."""
    d = scans(spark, report).where((F.col("status") == "completed") & (F.col("dataset") == dataset_id(path)) & (F.col("config_hash") == configuration))
    d = d.where(F.col("fingerprint") == fingerprint) if fingerprint is not None else d
    row = d.orderBy(F.desc("finished_at"), "scan_id").first()
    return row and row.scan_id


def signals_of(frames: DataFrame) -> DataFrame:
    """(episode_index, signal_key, frame_index, value) of the vector series among ``SIGNALS``."""
    have = [k for k in SIGNALS if k in frames.columns]
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("signal_key"), F.col(f"`{k}`").cast("array<double>").alias("value")) for k in have]))
    return frames.select("episode_index", "frame_index", each.alias("s")).select("episode_index", "s.signal_key", "frame_index", "s.value")


def read_signals(spark: SparkSession, path: str, changed: DataFrame, few: list[int] | None) -> tuple[DataFrame, DataFrame]:
    """Signals of the changed episodes, and (episode_index, error) of those of which nothing can be read although their
    metadata tell of frames. Files that are broken give no rows."""
    if E.detect_format(spark, path) == E.MESSAGE_LOG:
        e = L.episodes(spark, path, errors=True).join(changed, "episode_index", "left_semi")
        frames = L.series(spark, path, few, list(SIGNALS), errors=True)
        errors = L.failures(spark, path, e)
    else:
        frames = E.frames(spark, path, few, list(SIGNALS), errors=True)
        e = registry.adapter_of(spark, path).episodes(spark, path).join(changed, "episode_index", "left_semi")
        errors = e.where("length > 0").join(frames.select("episode_index").distinct(), "episode_index", "left_anti").select("episode_index", F.lit("no frames can be read").alias("error"))
    return signals_of(frames.join(changed, "episode_index", "left_semi")), errors


def scan(spark: SparkSession, path: str, report: str, at: str, detectors: dict[str, tuple[Callable, float]] | None = None, options: dict | None = None) -> str:
    """Scans a dataset into a report, or finds that it has been; returns the scan's id. ``at``: the time to note, as
    text that sorts."""
    detectors = DT.VECTOR_DETECTORS if detectors is None else detectors
    configuration = config_hash([sorted(detectors), options or {}])
    now = episode_fingerprints(spark, path)
    fingerprint = dataset_fingerprint(now)
    if (found := finished(spark, report, path, configuration, fingerprint)) is not None:
        return found
    scan_id, last = uuid.uuid4().hex, finished(spark, report, path, configuration)
    write_table(now, report, "scan_episodes", scan_id)
    now = read_table(spark, report, "scan_episodes", scan_id).drop("scan_id")
    changed, kept = now.select("episode_index"), None
    if last is not None:
        before = read_table(spark, report, "scan_episodes", last).drop("scan_id")
        kept = now.join(before, ["episode_index", "fingerprint"], "left_semi").select("episode_index")
        changed = changed.join(kept, "episode_index", "left_anti")
    n, total = changed.count(), now.count()
    few = [r.episode_index for r in changed.collect()] if n <= NAMED and n < total else None
    episodes = registry.adapter_of(spark, path).episodes(spark, path) if E.detect_format(spark, path) != E.MESSAGE_LOG else L.episodes(spark, path, errors=True)
    fps = (float(E.read_info(spark, path).get("fps") or 0) if E.detect_format(spark, path) != E.MESSAGE_LOG else L.frame_rate(episodes)) or 1.0
    episodes = episodes.select("episode_index", "length", "duration")
    own = episodes.join(changed, "episode_index", "left_semi")
    parts, statuses = [], []
    if n:
        signals, errors = read_signals(spark, path, changed, few)
        parts.append(DT._findings(errors.select("episode_index").distinct(), "integrity/signal_read_error", "fatal", 1.0, True).withColumn("detector_id", F.lit("signal_integrity")))
        for name, (run, weight) in sorted(detectors.items()):
            status, reason = "completed", None
            try:
                found = run(signals, own, fps).select(*DT.COLUMNS)
                write_table(found, report, f"parts/{name}", scan_id)
                parts.append(read_table(spark, report, f"parts/{name}", scan_id, FINDINGS).drop("scan_id").withColumn("detector_id", F.lit(name)))
            except Exception as e:  # noqa: BLE001  a detector's failure is a result
                status, reason = "failed", f"{type(e).__name__}: {str(e)[:500]}"
            statuses.append(changed.select("episode_index", F.lit(name).alias("detector_id"), F.lit(status).alias("status"), F.lit(reason).cast("string").alias("skip_reason"), F.lit(weight).alias("coverage_weight"), F.lit(True).alias("applicable")))
    if kept is not None:
        parts.append(read_table(spark, report, "findings", last, f"{FINDINGS}, detector_id string").drop("scan_id").join(kept, "episode_index", "left_semi"))
        statuses.append(read_table(spark, report, "episode_detectors", last).drop("scan_id").join(kept, "episode_index", "left_semi"))
    whole = lambda ds: ds[0] if len(ds) == 1 else whole([ds[0].unionByName(ds[1]), *ds[2:]])
    write_table(whole(parts), report, "findings", scan_id)
    write_table(whole(statuses), report, "episode_detectors", scan_id)
    scored = episodes.join(coverage(read_table(spark, report, "episode_detectors", scan_id)), "episode_index", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0)))
    scores = score_episodes(scored, read_table(spark, report, "findings", scan_id, f"{FINDINGS}, detector_id string"))
    write_table(scores.withColumns({c: F.round(c, 3) for c in ("usable_ratio", "quality_score", "coverage")}), report, "episodes", scan_id)
    row = [(scan_id, "completed", dataset_id(path), fingerprint, configuration, at, total, total - n)]
    spark.createDataFrame(row, SCANS).coalesce(1).write.mode("append").parquet(f"{report}/scans")
    return scan_id
