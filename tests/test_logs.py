"""Episodes of message logs, and logs copied, cut and merged, against plain loops over all messages."""

import os
import random
import struct

import pytest
from pyspark.sql import functions as F

from epiframe.sources import log_episodes as L
from epiframe.sources import message_log as M
from epiframe.sources import registry

S = 1_000_000_000


def pose(x):
    part = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    return part(3, part(1, b"".join(bytes([i << 3 | 1]) + struct.pack("<d", v) for i, v in enumerate((x, 2.0, 3.0), 1))))


def recording(rng, starts, lengths, rate=0.1):
    """Messages (topic, schema, t, data) of several episodes; late ones lie behind the anchor's last."""
    rows = []
    for start, n in zip(starts, lengths, strict=True):
        for i in range(n):
            t = int((start + i * rate) * S)
            rows.append(("/arm/pose", "pkg.PoseInFrame", t, pose(float(i))))
            if i % 2 == 0:
                rows.append(("/camera/image", "pkg.CompressedImage", t + 7, rng.randbytes(400)))
            if i % 3 == 0:
                rows.append(("/gripper/state", "raw", t + 9, struct.pack("<2d", i, start)))
    return rows


def everything(path):
    return sorted((m[1], m[2], m[4], m[6], m[7], m[8]) for p in M.log_files(str(path)) for m in M.messages(p))


def by_gap(times, gap):
    out = []
    for t in sorted(times):
        if not out or t - out[-1][-1] > gap:
            out.append([])
        out[-1].append(t)
    return [(i, x[0], x[-1], len(x)) for i, x in enumerate(out)]


@pytest.mark.parametrize(("seed", "gap"), [(0, 0), (1, 1), (2, 5), (3, 40)])
def test_gaps_without_sorting(spark, seed, gap):
    rng = random.Random(seed)
    times = {k: [rng.randrange(-300, 300) for _ in range(n)] for k, n in (("a", 120), ("b", 15), ("c", 1))}
    rows = spark.createDataFrame([(k, t) for k, ts in times.items() for t in ts] + [("d", None)], "k string, t long").repartition(5)
    got = L.gap_episodes(rows, ["k"], "t", gap).collect()
    assert sorted((r.k, r.segment, r.start, r.end, r.length) for r in got) == sorted((k, *e) for k, ts in times.items() for e in by_gap(ts, gap))
    met = L.in_windows(rows, L.gap_episodes(rows, ["k"], "t", gap), ["k"], "t")
    assert met.count() == sum(map(len, times.values())) and met.where("t < start or t > end").count() == 0


def test_hand_case_of_the_gap(spark, tmp_path):
    path = str(tmp_path / "task" / "00001" / "x.mcap")
    os.makedirs(os.path.dirname(path))
    M.write_log(path, [("/joint", "s", int(t * S), b"x") for t in (0, 1, 2, 4, 6.1)])
    e = L.episodes(spark, path).orderBy("episode_index").collect()
    assert [(r.episode_index, r.length, r.start, r.end, r.duration, r.tasks) for r in e] == [(0, 4, 0, 4 * S, 4.0, ["task"]), (1, 1, int(6.1 * S), int(6.1 * S), 0.0, ["task"])]
    assert L.frame_rate(L.episodes(spark, path)) == 4 / 6.1
    M.write_log(str(tmp_path / "empty.mcap"), [])
    assert [(r.length, r.cameras) for r in L.episodes(spark, str(tmp_path / "empty.mcap")).collect()] == [(0, [])]
    with pytest.raises(ValueError, match="no message logs"):
        L.episodes(spark, str(tmp_path / "task"  / "none"))


def test_single_file(spark, tmp_path):
    rng = random.Random(5)
    path = str(tmp_path / "one.mcap")
    M.write_log(path, recording(rng, (0, 30, 60), (20, 41, 7)), chunk_bytes=900)
    e = L.episodes(spark, path).orderBy("episode_index").collect()
    assert [(r.length, r.start, r.cameras) for r in e] == [(20, 0, ["camera_image"]), (41, 30 * S, ["camera_image"]), (7, 60 * S, ["camera_image"])]
    m = L.labelled(spark, path, L.episodes(spark, path))
    want = {(i, r[1], r[2], r[6]) for i, (r0, r1) in enumerate((x.start, x.end) for x in e) for r in ((p, *x[1:]) for p, x in ((None, x) for x in M.messages(path))) if r0 <= r[6] <= r1}
    assert {(r.episode_index, r.topic, r.schema_name, r.log_time) for r in m.collect()} == want
    d = registry.MessageLogAdapter().frames(spark, path, [1])
    rows = d.orderBy("frame_index").collect()
    assert {r.episode_index for r in rows} == {1} and len(rows) == 41 and rows[3].action == [3.0, 2.0, 3.0, 0.0, 0.0, 0.0, 1.0] == rows[3]["eef.arm_pose"]
    assert [r["observation.state"] for r in rows[:2]] == [[0.0, 30.0], [3.0, 30.0]] and rows[20].asDict()["observation.state"] is None
    assert registry.MessageLogAdapter().frames(spark, path, [1], ["observation.state"]).columns == ["episode_index", "frame_index", "eef.arm_pose", "observation.state"]


def test_several_files(spark, tmp_path):
    rng = random.Random(6)
    for i, n in enumerate((10, 3)):
        os.makedirs(tmp_path / "set" / f"{i:05}")
        M.write_log(str(tmp_path / "set" / f"{i:05}" / "x.mcap"), recording(rng, (i * 100, i * 100 + 50), (n, 2)))
    M.write_log(str(tmp_path / "set" / "00001" / "y.mcap"), [("/plain", "s", 5, b"1"), ("/plain", "s", 9, b"2")])
    e = L.episodes(spark, str(tmp_path / "set")).orderBy("episode_index").collect()
    assert [(r.length, r.cameras) for r in e] == [(6, ["camera_image"]), (3, ["camera_image"]), (2, [])]  # image topics, else all
    assert [r.tasks for r in e] == [["set"]] * 3
    rates = [(n - 1) / d for n, d in ((6, e[0].duration), (3, e[1].duration), (2, e[2].duration))]
    assert L.frame_rate(L.episodes(spark, str(tmp_path / "set"))) == pytest.approx(sum(rates) / 3)
    assert L.labelled(spark, str(tmp_path / "set"), L.episodes(spark, str(tmp_path / "set"))).count() == len(everything(tmp_path / "set"))


@pytest.mark.parametrize("kind", ["zstd", ""])
def test_subset_keeps_messages_and_whole_chunks(spark, tmp_path, kind):
    rng = random.Random(7)
    path = str(tmp_path / "one.mcap")
    M.write_log(path, recording(rng, (0, 30, 60), (200, 141, 70)), kind, 3000)
    e = {r.episode_index: (r.start, r.end) for r in L.episodes(spark, path).collect()}
    inside = lambda *k: sorted(m for m in everything(path) if any(e[i][0] <= m[3] <= e[i][1] for i in k))
    r = L.subset(spark, path, [2, 0, 2], str(tmp_path / "out.mcap")).collect()
    assert everything(tmp_path / "out.mcap") == inside(0, 2) and [x.messages for x in r] == [len(inside(0, 2))]
    assert r[0].whole_chunks > 10
    s = list(M.summary_rows(str(tmp_path / "out.mcap")))
    assert all(x[7] for x in s) and sum(x[4] for x in s) == len(inside(0, 2)) and not [f for f in os.listdir(tmp_path) if "building" in f]
    L.subset(spark, path, [0, 1], str(tmp_path / "many"))
    assert [everything(p) for p in M.log_files(str(tmp_path / "many"))] == [inside(0), inside(1)]
    with pytest.raises(FileExistsError):
        L.subset(spark, path, [0], str(tmp_path / "many"))
    with pytest.raises(ValueError, match="no episodes"):
        L.subset(spark, path, [0, 9], str(tmp_path / "other"))


def test_definitions_keep_data_and_metadata(spark, tmp_path):
    """Schemas with data and channels with metadata, written by hand, in a file without chunks and without a summary."""
    text = lambda s: struct.pack("<I", len(s)) + s
    rec = lambda op, b: struct.pack("<BQ", op, len(b)) + b
    schema = rec(M.SCHEMA, struct.pack("<H", 7) + text(b"S") + text(b"proto") + text(b"\x01\x02"))
    channel = rec(M.CHANNEL, struct.pack("<HH", 3, 7) + text(b"/joint") + text(b"enc") + text(text(b"k") + text(b"v")))
    body = b"".join(rec(M.MESSAGE, struct.pack("<HIQQ", 3, i, i * S, i * S + 1) + b"d") for i in range(4))
    path = str(tmp_path / "hand.mcap")
    with open(path, "wb") as f:
        f.write(M.MAGIC + rec(M.HEADER, text(b"") + text(b"")) + schema + channel + body + rec(M.DATA_END, struct.pack("<I", 0)) + rec(M.FOOTER, struct.pack("<QQI", 0, 0, 0)) + M.MAGIC)
    L.subset(spark, path, [0], str(tmp_path / "out.mcap"))
    f, size = M._open(str(tmp_path / "out.mcap"))
    with f:
        bodies = M.read_summary(f, size).bodies
    assert [b[2:] for (op, _), b in bodies.items() if op == M.SCHEMA] == [schema[11:]] and [b[4:] for (op, _), b in bodies.items() if op == M.CHANNEL] == [channel[13:]]
    assert everything(tmp_path / "out.mcap") == everything(path) and len(everything(path)) == 4


@pytest.mark.parametrize("target", ["all.mcap", "folder"])
def test_merge_is_retimed(spark, tmp_path, target):
    rng = random.Random(8)
    a, b = str(tmp_path / "a.mcap"), tmp_path / "b"
    M.write_log(a, recording(rng, (100, 130), (30, 12)), chunk_bytes=2000)
    b.mkdir()
    for i in range(2):
        log = M.LogWriter(str(b / f"{i}.mcap"))
        for t in range(5):
            log.add("/other", "s", (50 + t) * S, b"%d" % t, publish=(50 + t) * S + (9 * S if t == 4 else 0))
        log.add("/camera/image", "pkg.CompressedImage", 52 * S, b"i")
        log.close()
    r = L.merged(spark, [a, str(b)], str(tmp_path / target)).collect()
    cursor, want = 0, []
    for path in (a, str(b)):
        for e in L.episodes(spark, path).orderBy("episode_index").collect():
            rows = [m for m in M.messages(e.file) if e.start <= m[6] <= e.end]
            moved = [(m[1], m[2], m[4], cursor + m[6] - e.start, cursor + max(0, m[7] - e.start), m[8]) for m in rows]
            want += moved
            cursor += max([e.end - e.start, 1] + [t - cursor for m in moved for t in m[3:5]]) + 3 * S
    assert everything(tmp_path / target) == sorted(want) and sum(x.messages for x in r) == len(want)
    assert len(M.log_files(str(tmp_path / target))) == (1 if target.endswith("p") else 4)


def test_messages_find_slices_of_a_hot_file(spark):
    """One file, far more messages than windows: the join is by slices of time, so one file is not one key."""
    rows = spark.range(20_000).select(F.lit("f").alias("file"), (F.col("id") * 10).alias("t"))
    e = L.gap_episodes(rows.where("t % 5000 < 4000"), ["file"], "t", 100)
    got = L.in_windows(rows, e, ["file"], "t")
    assert got.count() == 20_000 * 4 // 5 and got.groupBy("segment").count().count() == e.count() == 40
