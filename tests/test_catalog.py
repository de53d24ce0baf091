"""Layouts on disk, export, registry, catalog, kernels, payloads and frozen video."""

import json
import struct
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epiframe.functions import kernels as K
from epiframe.functions import payloads
from epiframe.operators import tables, visual
from epiframe.sources import catalog, registry
from epiframe.sources import episodes as E


@pytest.fixture(scope="module")
def dataset(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("layouts") / "v2")
    rows = [(e, f, [float(f), float(e)]) for e in range(4) for f in range(e + 3)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>")
    tasks = spark.createDataFrame([(0, ["t"]), (1, ["u", "v"]), (2, ["t"]), (3, None)], "episode_index long, tasks array<string>")
    E.write_v2(frames, path, 10.0, "r", tasks)
    return path


def test_layout_of_version_two(spark, dataset):
    p = Path(dataset)
    assert sorted(str(f.relative_to(p)) for f in p.rglob("*") if f.is_file() and not f.name.startswith(".")) == [f"data/chunk-000/episode_00000{i}.parquet" for i in range(4)] + ["meta/episodes.jsonl", "meta/episodes_stats.jsonl", "meta/info.json", "meta/tasks.jsonl"]
    info = json.loads((p / "meta/info.json").read_text())
    assert (info["total_episodes"], info["total_frames"], info["total_tasks"], info["splits"]) == (4, 18, 3, {"train": "0:4"})
    assert info["features"]["action"] == {"dtype": "float64", "shape": [2], "names": ["action.d0", "action.d1"]}
    assert [json.loads(x) for x in (p / "meta/tasks.jsonl").read_text().splitlines()] == [{"task_index": i, "task": t} for i, t in enumerate("tuv")]
    stats = [json.loads(x) for x in (p / "meta/episodes_stats.jsonl").read_text().splitlines()]
    assert stats[1]["stats"]["action"]["max"] == [3.0, 1.0] and [r.task for r in E.tasks_table(spark, dataset).orderBy("task_index").collect()] == list("tuv")
    d = E.frames(spark, dataset).orderBy("index").collect()
    assert [r["index"] for r in d] == list(range(18)) and d[4].timestamp == 0.1 and {r.task_index for r in d if r.episode_index == 1} == {1}
    assert len(E.data_files(spark, dataset, [1, 3])) == 2 and E.frames(spark, dataset, [1, 3]).count() == 10


def test_layout_of_version_three_and_export(spark, dataset, tmp_path):
    three, out = str(tmp_path / "v3"), str(tmp_path / "out")
    E.write_v3(E.frames(spark, dataset).drop("index"), three, 10.0, "r", E.episodes(spark, dataset), shard_frames=7)
    names = sorted(str(f.relative_to(three)) for f in Path(three).rglob("*.parquet"))
    assert names == [f"data/chunk-000/file-00{i}.parquet" for i in range(2)] + ["meta/episodes/chunk-000/file-000.parquet"]
    e = spark.read.parquet(f"{three}/meta/episodes/chunk-000/file-000.parquet").orderBy("episode_index").collect()
    assert [(r.dataset_from_index, r.dataset_to_index, r["data/file_index"]) for r in e] == [(0, 3, 0), (3, 7, 0), (7, 12, 1), (12, 18, 1)]
    assert e[1]["stats/action/max"] == [3.0, 1.0] and len(E.data_files(spark, three, [3])) == 1
    labels = spark.createDataFrame([(3, "x"), (0, "y")], "episode_index long, note string")
    made = E.export(spark, three, out, [3, 1, 1], E.V2, labels)
    assert made["episodes"] == {"1": 0, "3": 1} and made["total_frames"] == 10 and made["fidelity"] == "high"
    assert sorted((r.episode_index, r.frame_index, r.action[1]) for r in E.frames(spark, out).collect())[-1] == (1, 5, 3.0)
    assert json.loads(Path(out, "meta/labels.jsonl").read_text()) == {"note": "x", "episode_index": 1}
    with pytest.raises(ValueError, match="no episodes"):
        E.export(spark, three, str(tmp_path / "bad"), [9])
    with pytest.raises(FileExistsError):
        E.export(spark, three, out, [1])
    assert not list(Path(tmp_path).glob("*building*"))


def test_detection(spark, tmp_path):
    for name, version in (("a", "v3.0"), ("b", "v2.0")):
        (tmp_path / name / "meta").mkdir(parents=True)
        (tmp_path / name / "meta/info.json").write_text(json.dumps({"codebase_version": version}))
    (tmp_path / "c/deep").mkdir(parents=True)
    (tmp_path / "c/deep/x.mcap").write_bytes(b"x")
    (tmp_path / "d/meta").mkdir(parents=True)
    (tmp_path / "d/meta/info.json").write_text("{broken")
    found = [E.detect_format(spark, str(tmp_path / n)) for n in ("a", "b", "c", "d", "c/deep/x.mcap")]
    assert found == [E.V3, E.V2, E.MESSAGE_LOG, None, E.MESSAGE_LOG]
    assert E.resolve(spark, str(tmp_path / "c")).endswith("x.mcap") and len(E.collect_files(spark, str(tmp_path / "c"), (".mcap",))) == 1
    assert isinstance(registry.adapter_of(spark, str(tmp_path / "a")), registry.ParquetAdapter)
    with pytest.raises(ModuleNotFoundError, match="h5py"):
        registry.adapter_of(spark, "x", E.HDF5).frames(spark, "x")
    assert {(r.suffix, r.files) for r in catalog.census(spark, str(tmp_path)).collect()} == {(".json", 1), (".mcap", 1)}


def test_catalog(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"id": f"j{i}", "status": "running", "created_at": f"2024-01-0{i + 1}T00:00:00Z", "updated_at": f"2024-01-0{i + 1}T00:01:00Z", "progress": 2.0, "total": 8}))
    j = catalog.eta(catalog.jobs(spark, str(tmp_path), 2)).orderBy(F.desc("created_at")).collect()
    assert [(r.id, r.eta_s) for r in j] == [("j2", 180.0), ("j1", 180.0)]
    catalog.save_progress(spark, str(tmp_path / "p"), {3: "pass", 4: "quarantine"}, {4: "dark"}, "d", "now")
    catalog.save_progress(spark, str(tmp_path / "p"), {3: "pass", 4: "quarantine"}, {4: "dark"}, "d", "later")
    assert sorted(map(tuple, catalog.read_progress(spark, str(tmp_path / "p")).collect())) == [(3, "pass", None), (4, "quarantine", "dark")]


def test_configurations():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert K.deep_merge(base, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": [1]}, "d": {"e": 1}} and base["d"] == 2
    assert K.canonical_json({"b": [1, {"z": 1, "a": None}], "a": "é"}) == '{"a":"é","b":[1,{"a":null,"z":1}]}'
    assert K.without_keys({"t": 1, "x": [{"t": 2, "y": 3}]}, frozenset("t")) == {"x": [{"y": 3}]}
    assert len(K.config_hash(base)) == 16 and tables.camel("start_s_at") == "startSAt"


def test_payload_tables(spark):
    field = lambda n, b: bytes([n << 3 | 2, len(b)]) + b
    double = lambda n, x: bytes([n << 3 | 1]) + struct.pack("<d", x)
    position = double(1, 1.0) + double(3, 3.0)  # y is zero and not on the wire
    message = field(2, b"base") + field(3, field(1, position) + field(2, double(1, 0.6) + double(4, 0.8)))
    assert payloads.pose(message) == [1.0, 0.0, 3.0, 0.6, 0.0, 0.0, 0.8]
    assert payloads.pose(field(3, field(1, position)))[3:] == [0.0, 0.0, 0.0, 1.0] and payloads.pose(field(2, b"x")) is None
    assert payloads.read_fields(b"\x08\x96\x01\x12\x05ab") == {1: [150]}  # the second field is cut off
    assert payloads.image(field(2, b"\xff\xd8") + field(3, b"jpeg")) == ("jpeg", b"\xff\xd8")
    assert payloads.numbers(struct.pack("<2d", 1, 2)) == [1.0, 2.0] and payloads.numbers(b"\0\1\0\0" + struct.pack("<d", 5)) is not None and payloads.numbers(b"abc") is None
    d = spark.createDataFrame([(bytearray(message), "x.PoseInFrame"), (bytearray(struct.pack("<3f", 1, 2, 3)), None), (None, "y")], "data binary, name string")
    assert [r[0] for r in d.select(payloads.decode_vector(F.col("data"), F.col("name"))).collect()][1:] == [[1.0, 2.0, 3.0], None]
    rgb = spark.createDataFrame([(bytearray([1, 2, 3]), 1, 1, 3, "bgr8"), (bytearray([1, 2]), 1, 1, 3, "rgb")], "d binary, h int, w int, c int, o string")
    assert [r[0] and bytes(r[0]) for r in rgb.select(K.to_rgb(*map(F.col, "dhwco"))).collect()] == [b"\x03\x02\x01", None]


def test_frozen_video(spark):
    still = lambda i: (0.0, 0.0) if 10 <= i < 30 else (5.0, 0.4)
    rows = [(e, "c", i, 100.0, 90.0, *(still(i) if i else (None, None))) for e in range(3) for i in range(40)]
    metrics = spark.createDataFrame(rows, "episode_index long, camera_key string, frame_index long, mean_luma double, blur double, change double, changed_ratio double")
    signals = spark.createDataFrame([(e, 0, f, float(f) if e == 0 else 0.0 if 15 <= f < 70 else float(f)) for e in range(2) for f in range(80)], "episode_index long, dim int, frame_index long, value double")
    got = {r.episode_index: r for r in visual.freeze_findings(metrics, signals, 5.0, 10.0).collect()}
    assert set(got) == {0, 2}  # the robot of episode 1 stood still
    assert (got[0].issue_code, got[0].severity, got[0].confidence, round(got[0].start_s, 6), round(got[0].end_s, 6)) == ("integrity/video_frozen", "fatal", 0.95, 1.7, 5.9)
    assert (got[2].issue_code, got[2].confidence, got[2].motion) == ("visual/frozen", 0.7, None)
    want = spark.createDataFrame([(0, "c", 40), (1, "c", 80), (2, "d", 1)], "episode_index long, camera_key string, expected int")
    assert {(r.episode_index, r.issue_code) for r in visual.camera_findings(metrics, want).collect()} == {(1, "integrity/video_frame_count_mismatch"), (2, "integrity/empty_video")}
