"""Scans that are reused by fingerprint, read only what changed, and go on where something cannot be read."""

import os
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epiframe.operators import detectors as DT
from epiframe.sources import episodes as E
from epiframe.sources import log_episodes as L
from epiframe.sources import message_log as M
from epiframe.sources import report, scans


def dataset(spark, path, kind, n=4, **how):
    rows = [(e, f, [0.05 * f + e, 0.3 if e != 2 or f != 5 else float("nan")], [0.1 * f]) for e in range(n) for f in range(40)]
    d = spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>, `observation.state` array<double>")
    E.WRITERS[kind](d, path, 10.0, **how)


def found(spark, where, scan_id):
    return sorted((r.episode_index, r.issue_code) for r in report.read_table(spark, where, "findings", scan_id).where("detector_id = 'signal_integrity'").collect())


def counting(seen):
    """The integrity detector, noting which episodes it is given."""

    def run(signals, episodes, fps):
        seen.append(sorted(r.episode_index for r in signals.select("episode_index").distinct().collect()))
        return DT.VECTOR_DETECTORS["signal_integrity"][0](signals, episodes, fps)

    return {"signal_integrity": (run, 1.0)}


@pytest.mark.parametrize("kind", [E.V2, E.V3])
def test_second_scan_reads_nothing_and_a_change_is_read_alone(spark, tmp_path, kind):
    path, where, seen = str(tmp_path / "d"), str(tmp_path / "r"), []
    dataset(spark, path, kind, **({"shard_frames": 40} if kind == E.V3 else {}))
    first = scans.scan(spark, path, where, "2024-01-01", counting(seen))
    assert seen == [[0, 1, 2, 3]] and found(spark, where, first) == [(2, "integrity/non_finite_signal")]
    assert scans.scan(spark, path, where, "2024-01-02", counting(seen)) == first and len(seen) == 1
    f = next(Path(path).glob("data/chunk-*/*1.parquet"))
    os.utime(f, (1, 1))
    second = scans.scan(spark, path, where, "2024-01-03", counting(seen))
    assert second != first and seen[1:] == [[1]] and found(spark, where, second) == found(spark, where, first)
    row = scans.scans(spark, where).where(F.col("scan_id") == second).first()
    assert (row.episodes, row.reused, row.status) == (4, 3, "completed")
    other = scans.scan(spark, path, where, "2024-01-04", counting(seen), {"delta": 2})
    assert other not in (first, second) and seen[2] == [0, 1, 2, 3]  # another configuration


def test_broken_and_missing_files_and_failing_detectors(spark, tmp_path):
    path, where = str(tmp_path / "d"), str(tmp_path / "r")
    dataset(spark, path, E.V2)
    (Path(path) / "data/chunk-000/episode_000001.parquet").write_bytes(b"PAR1 broken")
    for f in Path(path).glob("data/chunk-000/.*crc"):
        f.unlink()
    (Path(path) / "data/chunk-000/episode_000003.parquet").unlink()

    def fails(signals, episodes, fps):
        raise RuntimeError("no such thing")

    done = scans.scan(spark, path, where, "1", DT.VECTOR_DETECTORS | {"own": (fails, 2.0)})
    assert {c for c in found(spark, where, done) if c[1] != "integrity/missing_action"} == {(1, "integrity/signal_read_error"), (2, "integrity/non_finite_signal"), (3, "integrity/signal_read_error")}
    status = {(r.detector_id, r.status, r.skip_reason) for r in report.read_table(spark, where, "episode_detectors", done).collect()}
    assert ("own", "failed", "RuntimeError: no such thing") in status and {s[1] for s in status if s[0] != "own"} == {"completed"}
    e = {r.episode_index: (r.integrity_status, r.auto_decision, round(r.coverage, 3)) for r in report.read_table(spark, where, "episodes", done).collect()}
    assert e[1] == e[3] == ("invalid", "quarantine", 60.0) and e[0] == ("valid", "review", 60.0)
    assert scans.scan(spark, path, where, "2", DT.VECTOR_DETECTORS | {"own": (fails, 2.0)}) == done


def test_a_cut_chunk_of_a_log(spark, tmp_path):
    path, where, sec = str(tmp_path / "x.mcap"), str(tmp_path / "r"), 1_000_000_000
    M.write_log(path, [("/joint_state", "s", (e * 60 + i) * sec // 10 + e * 60 * sec, struct.pack("<2d", i, e)) for e in range(3) for i in range(60)], chunk_bytes=2000)
    f, size = M._open(path)
    with f:
        s = M.read_summary(f, size)
    at, length, first, _ = s.chunks[len(s.chunks) // 2]
    raw = bytearray(Path(path).read_bytes())
    raw[at + length - 40 : at + length] = bytes(40)
    Path(path).write_bytes(raw)
    with pytest.raises(Exception):  # noqa: B017
        L.messages(spark, path).count()
    bad = L.messages(spark, path, errors=True).where("error is not null").collect()
    assert [r.log_time for r in bad] == [first] and 0 < L.messages(spark, path, errors=True).count() < 181
    only = {"signal_integrity": DT.VECTOR_DETECTORS["signal_integrity"]}
    done = scans.scan(spark, path, where, "1", only)
    (hit,) = [c for c in found(spark, where, done) if c[1] == "integrity/signal_read_error"]
    e = {r.episode_index: (r.start, r.end) for r in L.episodes(spark, path, errors=True).collect()}
    assert e[hit[0]][0] <= first and len(e) >= 3 and scans.scan(spark, path, where, "2", only) == done
    (tmp_path / "set").mkdir()
    M.write_log(str(tmp_path / "set/a.mcap"), [("/joint_state", "s", i, struct.pack("<d", i)) for i in range(5)])
    (tmp_path / "set/b.mcap").write_bytes(b"no log at all")
    two = scans.scan(spark, str(tmp_path / "set"), where, "3", only)
    assert (1, "integrity/signal_read_error") in found(spark, where, two) and not any(c == (0, "integrity/signal_read_error") for c in found(spark, where, two))
