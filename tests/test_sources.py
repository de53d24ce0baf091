"""Readers, writers, payloads and streams on small data made here."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F

from epiframe.functions import payloads
from epiframe.operators import datasets as D
from epiframe.operators import intervals as I
from epiframe.operators import quality as Q
from epiframe.operators import signals as S
from epiframe.operators import stats as ST
from epiframe.sources import episodes as E
from epiframe.sources.message_log import MessageLogSource, write_log
from epiframe.streaming import telemetry


def test_message_log_round_trip(spark, tmp_path):
    rows = [("/a", "raw", 5, struct.pack("<2d", 1.0, 2.0)), ("/b", "raw", 3, b"x"), ("/a", "raw", 9, struct.pack("<2d", 3.0, 4.0))]
    write_log(str(tmp_path / "one.mcap"), rows)
    spark.dataSource.register(MessageLogSource)
    d = spark.read.format("message_log").load(str(tmp_path))
    assert [(r.topic, r.log_time, bytes(r.data)) for r in d.orderBy("log_time").collect()] == [(t, n, b) for t, _, n, b in sorted(rows, key=lambda r: r[2])]
    assert d.where("topic = '/b'").count() == 1 and d.count() == 3
    v = spark.read.format("message_log").options(topics="/a", since=6).load(str(tmp_path)).select(payloads.decode_vector(F.col("data"), F.col("schema_name")).alias("v"))
    assert [r.v for r in v.collect()] == [[3.0, 4.0]]
    d.select("topic", "schema_name", "log_time", "data").write.format("message_log").mode("append").option("path", str(tmp_path / "out")).save()
    assert spark.read.format("message_log").load(str(tmp_path / "out")).count() == 3


def test_payloads():
    part = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    doubles = lambda *v: b"".join(bytes([i << 3 | 1]) + struct.pack("<d", x) for i, x in enumerate(v, 1))
    assert payloads.pose(part(3, part(1, doubles(1, 2, 3)) + part(2, doubles(0, 0, 1, 0)))) == [1, 2, 3, 0, 0, 1, 0]
    assert payloads.pose(part(3, part(1, doubles(1, 2, 3)))) == [1, 2, 3, 0, 0, 0, 1] and payloads.pose(b"") is None
    assert payloads.numbers(struct.pack("<d", 1.5)) == [1.5] and payloads.numbers(b"\0\1\0\0" + struct.pack("<d", 1.5)) is not None and payloads.numbers(b"abc") is None


def test_dataset_round_trip(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = [(i, e, f, f / 10, [float(f), 1.0]) for i, (e, f) in enumerate((e, f) for e in (0, 2, 5) for f in range(e + 2))]
    frames = spark.createDataFrame(rows, "index long, episode_index long, frame_index long, timestamp double, action array<double>")
    kept = E.subset(frames, spark.createDataFrame([(2,), (5,)], "episode_index long"))
    E.write_v2(kept.select(*frames.columns), path, 10.0)
    assert E.detect_format(spark, path) == E.V2
    assert [(r.episode_index, r.length, r.duration) for r in E.episodes(spark, path).orderBy("episode_index").collect()] == [(0, 4, 0.4), (1, 7, 0.7)]
    back = E.frames(spark, path, [1]).orderBy("frame_index").collect()
    assert [r["index"] for r in back] == list(range(4, 11)) and back[3].action == [3.0, 1.0]
    assert E.long_series(E.frames(spark, path), "action").count() == 22


def test_broken_label_lines_go(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text(json.dumps({"target": "frame", "episode_index": 1, "frame_index": 2}) + "\n{broken\n" + json.dumps({"target": "interval", "episode_index": 1, "start_s": 1.0}) + "\n")
    labels = E.read_labels(spark, str(p))
    assert labels.where("episode_index is not null").count() == 2
    assert [r.rule for r in D.label_violations(labels.where("episode_index is not null")).collect()] == ["interval_bounds"]


def test_hand_cases(spark):
    t = spark.createDataFrame([(1, i, x) for i, x in enumerate((0.0, 1.0, 2.0, 4.0, 6.1))], "k int, i int, t double")
    assert sorted((r.first_index, r.last_index) for r in S.segments(S.gap_split(t, "k", "t", "i", 2.0), "k", "t").collect()) == [(0, 3), (4, 4)]
    m = spark.createDataFrame([(0, i, bool(x)) for i, x in enumerate((0, 1, 1, 0, 1, 1, 0))], "episode_index int, frame_index int, m boolean")
    one = lambda c: [(round(r.start_s, 6), round(r.end_s, 6)) for r in I.mask_to_intervals(m, "m", 10, 0.2, 0.1, c).collect()]
    assert one(0.0) == [(0.1, 0.6)] and one(0.1) == [(0.0, 0.7)]
    spans = spark.createDataFrame([(0, 0.0, 2.0, 10.0), (0, 1.0, 3.0, 10.0), (0, 5.0, 4.0, 10.0)], "episode_index int, start_s double, end_s double, duration double")
    assert I.union_duration(spans).first().covered_s == 3.0
    e = spark.createDataFrame([(0, 10.0, 100.0), (1, 10.0, 100.0), (2, 10.0, 100.0), (3, 10.0, 100.0)], "episode_index int, duration double, coverage double")
    f = spark.createDataFrame([(0, "error", 0.9, 2.0, 4.0, False), (1, "warning", 0.9, None, None, False), (2, "fatal", 1.0, None, None, True)], "episode_index int, severity string, confidence double, start_s double, end_s double, hard_invalid boolean")
    got = {r.episode_index: (r.usable_ratio, round(r.quality_score, 6), r.auto_decision, r.integrity_status) for r in Q.score_episodes(e, f).collect()}
    assert got == {0: (80.0, 82.0, "review", "valid"), 1: (100.0, 95.0, "pass", "valid"), 2: (0.0, 0.0, "quarantine", "invalid"), 3: (100.0, 100.0, "pass", "valid")}
    parts = spark.createDataFrame([("f", 1, 0.0, 0.0, 0.0, 0.0), ("f", 3, 4.0, 1.0, 3.0, 5.0)], "k string, count long, mean double, std double, min double, max double")
    r = ST.merge_stats(parts, ["k"]).first()
    assert (r["mean"], r["count"]) == (3.0, 4) and r["std"] == pytest.approx(3.75**0.5)
    r = ST.repeated_stats(spark.createDataFrame([(0, 2), (1, 3)], "e int, n int"), "e", "n").first()
    assert (r["mean"], r.q10, r.q50) == (0.6, 0.0, 1.0) and r["std"] == pytest.approx(0.24**0.5)
    four = spark.createDataFrame([(0, i) for i in range(4)], "k int, i int")
    assert [x.i for x in S.downsample(four, ["k"], "i", 3).orderBy("i").collect()] == [0, 2, 3]
    ten = spark.createDataFrame([(0, i) for i in range(10)], "k int, i int")
    assert [x.i for x in S.downsample(ten, ["k"], "i", 4, even=False).orderBy("i").collect()] == [0, 2, 5, 7]
    assert [x.i for x in S.nearest_rank(four.where("i < 3"), ["k"], "i", 5).orderBy("target").collect()] == [0, 0, 1, 2, 2]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("a", i * 1_000_000_000, float(i)) for i in range(50)] + [("b", 5, 1.0)], "key string, t_ns long, value double").write.parquet(src)
    stream = spark.readStream.schema("key string, t_ns long, value double").parquet(src)
    q = telemetry.bounded_history(stream, seconds=20).writeStream.outputMode("update").format("memory").queryName("history").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.processAllAvailable()
    q.stop()
    got = {r.key: (r.n, r.last_value) for r in spark.table("history").collect()}
    assert got == {"a": (21, 49.0), "b": (1, 1.0)}
    q = telemetry.last_values(stream, ["key"], "t_ns", "value").writeStream.outputMode("complete").format("memory").queryName("latest").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.processAllAvailable()
    q.stop()
    assert {r.key: r.value for r in spark.table("latest").collect()} == {"a": 49.0, "b": 1.0}
    assert telemetry.bounds(1, 5) == (5.0, 100) and os.path.isdir(src)


def test_conversion_between_layouts(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    rows = [(i, e, f, f / 10, [float(f), float(e)]) for i, (e, f) in enumerate((e, f) for e in (0, 1) for f in range(e + 3))]
    frames = spark.createDataFrame(rows, "index long, episode_index long, frame_index long, timestamp double, action array<double>")
    E.write_v2(frames, a, 10.0, "r", spark.createDataFrame([(0, ["t"]), (1, ["u", "v"])], "episode_index long, tasks array<string>"))
    E.convert(spark, a, b, E.V3)
    E.convert(spark, b, c, E.V2)
    assert (E.detect_format(spark, a), E.detect_format(spark, b), E.detect_format(spark, str(tmp_path / "none"))) == (E.V2, E.V3, None)
    key = lambda r: (r.episode_index, r.frame_index, list(r.action))
    assert sorted(map(key, E.frames(spark, c).collect())) == sorted(map(key, frames.collect())) == sorted(map(key, E.frames(spark, b).collect()))
    assert [(r.length, r.tasks) for r in E.episodes(spark, b).orderBy("episode_index").collect()] == [(3, ["t"]), (4, ["u", "v"])]
    assert E.fidelity(E.V2, E.V3) == "high" and E.fidelity(E.HDF5, E.V2) == "partial"


def test_detectors(spark):
    from epiframe.operators import detectors

    wave = lambda f: 0.05 * f + (1.0 if 20 <= f < 26 and f % 2 else 0.0)
    values = {0: [wave(f) for f in range(60)], 1: [0.05 * f + (5.0 if f >= 30 else 0.0) for f in range(60)], 2: [1.0] * 60, 3: [0.01 * f for f in range(29)] + [float("nan")] + [0.3] * 30}
    frames = spark.createDataFrame([(e, f, x) for e, v in values.items() for f, x in enumerate(v)], "episode_index long, frame_index long, value double")
    episodes = spark.createDataFrame([(e, 60) for e in range(5)], "episode_index long, length long")
    ok = frames.where("episode_index < 3")
    assert {r.episode_index for r in detectors.jitter(ok, 10.0).collect()} == {0}
    assert {r.episode_index for r in detectors.stationary(ok, 10.0).collect()} == {2} == {r.episode_index for r in detectors.near_zero(ok).collect()}
    found = {(r.episode_index, r.issue_code) for r in detectors.integrity(frames, episodes, 10.0).collect()}
    assert found == {(3, "integrity/non_finite_signal"), (4, "integrity/missing_action")}
    assert detectors.scan(ok, episodes.where("episode_index < 3"), 10.0).columns == list(detectors.COLUMNS)


def test_frame_metrics(spark):
    from epiframe.functions import images

    dark, bright = bytes([10] * 8 * 8 * 3), bytes([250] * 8 * 8 * 3)
    rows = [(0, "c", i, 8, 8, 3, bytearray(p)) for i, p in enumerate((dark, dark, bright))]
    d = images.visual_flags(images.frame_metrics(spark.createDataFrame(rows, "episode_index long, camera_key string, frame_index long, height int, width int, channels int, pixels binary")))
    assert [(r.dark, r.overexposed, r.blurred, r.frozen) for r in d.orderBy("frame_index").collect()] == [(True, False, True, False), (True, False, True, True), (False, True, True, False)]


def test_report_tables(spark, tmp_path):
    from epiframe.sources import report

    path = str(tmp_path / "r")
    one = spark.createDataFrame([("f1", 0, "x"), ("f2", 1, "y")], "finding_id string, episode_index int, issue_code string")
    report.write_table(one, path, "findings", "a")
    report.write_table(one, path, "findings", "b")
    report.write_table(one.where("episode_index = 1"), path, "findings", "a")
    assert report.read_table(spark, path, "findings").count() == 3 and report.read_table(spark, path, "findings", "a").count() == 1
    for status, at in (("accepted", "2024-01-01"), ("rejected", "2024-01-02")):
        report.add_reviews(spark.createDataFrame([("f1", status, at)], "finding_id string, review_status string, reviewed_at string"), path)
    assert [r.review_status for r in report.current_reviews(spark, path).collect()] == ["rejected"]
    assert spark.read.parquet(f"{path}/audit_log").count() == 2
    left = Q.open_findings(report.read_table(spark, path, "findings", "b"), report.current_reviews(spark, path))
    assert [r.finding_id for r in left.collect()] == ["f2"]
    report.export_csv(one, f"{path}/csv", ["finding_id"])
    assert spark.read.option("header", True).csv(f"{path}/csv").count() == 2
    p = spark.createDataFrame([("p1", "completed", "k"), ("p2", "running", "k")], "preview_id string, status string, fingerprint string")
    want = spark.createDataFrame([("p1", "k"), ("p1", "z"), ("p2", "k")], "preview_id string, fingerprint string")
    assert report.preview_gate(want, p).count() == 1 and report.missing_previews(p, want.where("preview_id = 'p2'")).count() == 1


def test_logs_split_at_chunks(spark, tmp_path):
    from epiframe.sources import message_log as M
    from epiframe.sources import registry

    rows = [(f"/t{i % 3}", "s", i * 10, bytes([i % 256]) * 50) for i in range(500)]
    key = lambda m: (m[1], m[2], m[6], m[8])
    for kind in ("zstd", "lz4", ""):
        path = str(tmp_path / f"x{kind}.mcap")
        write_log(path, rows, kind, 1000)
        parts = M.splits(path, 3000)
        assert len(parts) > 1 and [key(m) for p in parts for m in M.messages(path, span=p)] == rows
        assert [m[6] for m in M.messages(path, frozenset({"/t1"}), 100, 200)] == [100, 130, 160, 190]
        assert {(r[1], r[4], r[5], r[6], r[7]) for r in M.summary_rows(path)} == {("/t0", 167, 0, 4990, True), ("/t1", 167, 0, 4990, True), ("/t2", 166, 0, 4990, True)}
    whole = open(path, "rb").read()
    cut = str(tmp_path / "cut.mcap")
    with open(cut, "wb") as f:
        f.write(whole[:-60])
    assert len(M.splits(cut, 3000)) == 1 and [key(m) for m in M.messages(cut)] == rows and not any(r[7] for r in M.summary_rows(cut))
    write_log(str(tmp_path / "none.mcap"), [])
    assert list(M.summary_rows(str(tmp_path / "none.mcap"))) == [] == list(M.messages(str(tmp_path / "none.mcap")))
    spark.dataSource.register(MessageLogSource)
    spark.dataSource.register(M.MessageLogSummarySource)
    d = spark.read.format("message_log").option("splitBytes", 3000).load(path)
    assert d.rdd.getNumPartitions() == len(parts) and d.count() == 500
    d.where("topic = '/t1'").write.format("message_log").mode("append").option("path", str(tmp_path / "out")).save()
    s = spark.read.format("message_log_summary").load(str(tmp_path / "out"))
    assert s.groupBy("topic").agg(F.sum("messages").alias("n")).collect() == [("/t1", 167)]
    t = spark.createDataFrame([("f", "/a", "x", 9), ("f", "/joint_states", "x", 2), ("g", "/b", "x", 4), ("g", "/c", "x", 4)], "file string, topic string, schema_name string, messages long")
    assert {(r.file, r.topic) for r in D.anchor_topics(t).collect()} == {("f", "/joint_states"), ("g", "/b")}
    assert [(r.length, r.duration) for r in registry.MessageLogAdapter().episodes(spark, path).collect()] == [(167, 4980 / 1e9)]  # by the anchor, /t0


def test_signal_integrity(spark):
    from epiframe.operators import detectors

    rows = lambda e, k, n, v: [(e, k, f, v(f)) for f in range(n)]
    two = lambda f: [1.0, 2.0]
    data = rows(0, "action", 60, two) + rows(0, "observation.state", 59, two)
    data += rows(1, "action", 60, two) + rows(1, "observation.state", 40, two)
    data += rows(2, "action", 60, lambda f: [1.0] * (1 + f % 2)) + rows(3, "action", 60, lambda f: [])
    data += rows(4, "action", 60, lambda f: [1.0, float("nan") if f in (7, 9) else 0.0]) + rows(5, "observation.state", 60, two)
    s = spark.createDataFrame(data, "episode_index long, signal_key string, frame_index long, value array<double>")
    e = spark.createDataFrame([(i, 60) for i in range(6)], "episode_index long, length long")
    got = {(r.episode_index, r.issue_code, r.signal_key, r.start_s, r.end_s) for r in detectors.signal_integrity(s, e, 10.0).collect()}
    assert got == {
        (1, "integrity/signal_length_mismatch", "observation.state", None, None), (1, "integrity/action_state_length_mismatch", None, None, None), (2, "integrity/invalid_signal_shape", "action", None, None),
        (3, "integrity/empty_signal", "action", None, None), (4, "integrity/non_finite_signal", "action", 0.7, 1.0), (5, "integrity/missing_action", "action", None, None),
    }
    state = detectors.signal_integrity(s, e, 10.0, ("observation.state",)).where("issue_code = 'integrity/missing_state'")
    assert {r.episode_index for r in state.collect()} == {2, 3, 4}


def test_camera_shake(spark):
    from epiframe.operators import visual

    moves = [None, [0.0, 0.0], [9.0, 0.0], [0.0, 0.0], [9.0, 0.0], [9.0, 0.0], None, [0.0, 9.0], [0.0, 9.0], [0.0, float("nan")]]
    rows = [(0, c, i, m, 0.5 + i / 100, 0.25, 10 + i) for c in ("head", "left_wrist_front") for i, m in enumerate(moves)]
    d = spark.createDataFrame(rows, "episode_index long, camera_key string, frame_index long, motion array<double>, inlier_ratio double, spatial_coverage double, tracked_points int")
    assert [r.change for r in visual.motion_changes(d.where("camera_key = 'head'")).orderBy("frame_index").collect()] == [None, None, 9.0, 9.0, 9.0, 0.0, None, None, 0.0, None]
    got = visual.shake_findings(d, 2.0).collect()
    assert [(r.camera_key, r.start_s, r.end_s, r.change_max, round(r.inlier_median, 6), r.tracked_min) for r in got] == [("head", 0.9, 2.6, 9.0, 0.54, 11)]


def test_image_folder(spark, tmp_path):
    import zlib

    from epiframe.functions import images

    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    png = lambda rgb: b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress((b"\0" + bytes(rgb) * 2) * 2)) + part(b"IEND", b"")
    (tmp_path / "b.png").write_bytes(png((250, 10, 0)))
    (tmp_path / "a.png").write_bytes(png((1, 2, 3)))
    (tmp_path / "c.png").write_bytes(b"none")
    d = images.image_folder(spark, str(tmp_path), "head")
    assert [(r.frame_index, bytes(r.pixels)) for r in d.orderBy("frame_index").collect()] == [(0, bytes((1, 2, 3)) * 4), (1, bytes((250, 10, 0)) * 4)]
    assert images.frame_metrics(d).count() == 2
