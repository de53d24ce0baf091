"""Merges of datasets, read back, against plain loops over the sources."""

import json
import statistics
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from epiframe.sources import episodes as E
from epiframe.sources import log_episodes as L
from epiframe.sources import merging
from epiframe.sources import message_log as M


def dataset(spark, path, kind, lengths, tasks, shift=0.0, fps=10.0):
    rows = [(e, f, [f + shift, float(e)], [shift]) for e, n in lengths.items() for f in range(n)]
    frames = spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>, `observation.state` array<double>")
    t = spark.createDataFrame([(e, tasks.get(e, [])) for e in lengths], "episode_index long, tasks array<string>")
    E.WRITERS[kind](frames, path, fps, "arm", t)
    return rows


@pytest.mark.parametrize("kind", [E.V2, E.V3])
def test_merge_reads_back(spark, tmp_path, kind):
    a, b, out = (str(tmp_path / x) for x in "abc")
    one = dataset(spark, a, kind, {0: 3, 1: 5}, {0: ["t"], 1: ["u", "v"]})
    two = dataset(spark, b, kind, {0: 4, 1: 2, 2: 6}, {0: ["v"], 1: ["w"], 2: ["t"]}, 100.0)
    Path(a, "meta/notes.txt").write_text("kept")
    Path(a, "labels.jsonl").write_text(json.dumps({"episode_index": 1, "note": "x"}) + "\n")
    Path(b, "labels.jsonl").write_text(json.dumps({"episode_index": 2, "note": "y"}) + "\n" + json.dumps({"episode_index": 9, "note": "gone"}) + "\n")
    made = merging.merge(spark, [a, b], out)
    assert (made["total_episodes"], made["total_frames"], made["labels_merged"]) == (5, 20, 2)
    assert E.detect_format(spark, out) == kind and not list(tmp_path.glob("*building*"))
    want = [(e, f, v) for e, f, v, _ in one] + [(e + 2, f, v) for e, f, v, _ in two]
    d = E.frames(spark, out).orderBy("index").collect()
    assert [(r.episode_index, r.frame_index, r.action) for r in d] == want and [r["index"] for r in d] == list(range(20))
    assert [(r.length, r.tasks) for r in E.episodes(spark, out).orderBy("episode_index").collect()] == [(3, ["t"]), (5, ["u", "v"]), (4, ["v"]), (2, ["w"]), (6, ["t"])]
    assert [r.task for r in E.tasks_table(spark, out).orderBy("task_index").collect()] == list("tuvw")
    assert [min(r.task_index for r in d if r.episode_index == e) for e in range(5)] == [0, 1, 2, 3, 0]
    stats = json.loads(Path(out, "meta/stats.json").read_text())["action"]
    x = [v[0] for _, _, v in want]
    assert (stats["min"][0], stats["max"][0], stats["count"]) == (min(x), max(x), [20, 20])
    assert stats["mean"][0] == pytest.approx(statistics.fmean(x)) and stats["std"][0] == pytest.approx(statistics.pstdev(x))
    own = {r.episode_index: r["stats/action/max"] for r in E.episode_stats(spark, out).collect()}
    assert own == {0: [2.0, 0.0], 1: [4.0, 1.0], 2: [103.0, 0.0], 3: [101.0, 1.0], 4: [105.0, 2.0]}
    labels = [json.loads(x) for x in Path(out, "labels.jsonl").read_text().splitlines()]
    assert [(x["episode_index"], x["note"]) for x in labels] == [(1, "x"), (4, "y")]
    pairs = [json.loads(x) for x in Path(out, "merge_mapping.jsonl").read_text().splitlines()]
    assert [(p["source_dataset"], p["source_episode_index"]) for p in pairs] == [(a, 0), (a, 1), (b, 0), (b, 1), (b, 2)]
    info = E.read_info(spark, out)
    assert (info["total_frames"], info["total_tasks"], info["robot_type"], Path(out, "meta/notes.txt").read_text()) == (20, 4, "arm", "kept")
    again = str(tmp_path / "d")
    merging.merge(spark, [out, b], again, labels=False)
    assert E.frames(spark, again).count() == 32 and not Path(again, "labels.jsonl").exists()


def test_statistics_come_from_metadata(spark, tmp_path):
    """Statistics that the frames do not have, to tell where they are taken from; and a source without any."""
    a, b, out = (str(tmp_path / x) for x in "abc")
    dataset(spark, a, E.V2, {0: 3}, {})
    dataset(spark, b, E.V2, {0: 2}, {}, 7.0)
    told = Path(a, "meta/episodes_stats.jsonl")
    told.write_text(json.dumps({"episode_index": 0, "stats": {"action": {"min": [-9.0, 0.0], "max": [9.0, 0.0], "mean": [1.0, 0.0], "std": [2.0, 0.0], "count": [3]}}}) + "\n")
    Path(b, "meta/episodes_stats.jsonl").unlink()
    for f in (Path(a, "meta/.episodes_stats.jsonl.crc"), Path(b, "meta/.episodes_stats.jsonl.crc")):
        f.unlink(missing_ok=True)
    merging.merge(spark, [a, b], out)
    s = json.loads(Path(out, "meta/stats.json").read_text())["action"]
    assert s["min"][0] == -9.0 and s["max"][0] == 9.0 and s["count"] == [5, 5] and s["mean"][0] == pytest.approx((3 * 1.0 + 7.0 + 8.0) / 5)


def test_what_cannot_be_merged(spark, tmp_path):
    a, b, c = (str(tmp_path / x) for x in "abc")
    dataset(spark, a, E.V2, {0: 3}, {})
    dataset(spark, b, E.V2, {0: 3}, {}, fps=20.0)
    dataset(spark, c, E.V3, {0: 3}, {})
    assert merging.preflight(spark, [a, b])[1] == [(1, "fps_mismatch")]
    assert (1, "format_mismatch") in merging.preflight(spark, [a, c])[1]
    for paths, target, message in (([a, b], "x", "fps_mismatch"), ([a], "x", "two or more"), ([a, a], "x", "different"), ([a, b], "a/x", "within")):
        with pytest.raises(ValueError, match=message):
            merging.merge(spark, paths, str(tmp_path / target))
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b", "c"]
    d = str(tmp_path / "d")
    dataset(spark, d, E.V2, {0: 2, 1: 2}, {})
    lines = Path(d, "meta/episodes.jsonl")
    lines.write_text(lines.read_text().replace('"length":2', '"length":3', 1))
    Path(d, "meta/.episodes.jsonl.crc").unlink(missing_ok=True)
    with pytest.raises(ValueError, match="frames"):
        merging.merge(spark, [a, d], str(tmp_path / "e"))
    assert not list(tmp_path.glob("e*"))


def test_merge_of_logs(spark, tmp_path):
    for n in "ab":
        M.write_log(str(tmp_path / f"{n}.mcap"), [("/joint", "s", t * 1_000_000_000 + i, b"x%d" % i) for t in (0, 60) for i in range(4)])
    made = merging.merge(spark, [str(tmp_path / "a.mcap"), str(tmp_path / "b.mcap")], str(tmp_path / "c.mcap"))
    assert (made["messages"], made["total_episodes"]) == (16, 4) and len(Path(tmp_path, "c.mcap.merge_mapping.jsonl").read_text().splitlines()) == 4
    e = L.episodes(spark, str(tmp_path / "c.mcap")).orderBy("episode_index").collect()
    assert [r.length for r in e] == [4] * 4 and [r.start for r in e] == [i * (3_000_000_003) for i in range(4)]
    assert L.messages(spark, str(tmp_path / "c.mcap")).where(F.col("topic") == "/joint").count() == 16
