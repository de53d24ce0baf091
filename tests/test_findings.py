"""Motion judged signal by signal, clipped pixels, vectors with late NaNs, and conversions that nothing writes."""

import struct

import pytest

from epiframe.functions import images, payloads
from epiframe.operators import visual
from epiframe.sources import episodes as E
from epiframe.sources import message_log as M


def test_one_bad_signal_leaves_the_other(spark):
    span = spark.createDataFrame([(e, "c", 0.0, 1.0) for e in range(3)], "episode_index long, camera_key string, start_s double, end_s double")
    rows = [(e, k, d, f, float("nan") if (k == "observation.state" and e == 1 and f == 3) or e == 2 and f == 3 else float(f)) for e in range(3) for k in ("action", "observation.state") for d in range(2) for f in range(20)]
    s = spark.createDataFrame(rows, "episode_index long, signal_key string, dim int, frame_index long, value double")
    got = {r.episode_index: r.motion for r in visual.motion_evidence(span, s, 10.0).collect()}
    assert got[0] == got[1] == pytest.approx(10 / (18.81 - 0.19)) and got[2] is None
    alone = s.where("signal_key = 'action'").drop("signal_key")
    assert {r.episode_index: r.motion for r in visual.motion_evidence(span, alone, 10.0).collect()}[1] == got[0]


def test_clipped_pixels_are_counted(spark):
    half = bytes([0] * 8 * 4 * 3) + bytes([255] * 8 * 4 * 3)
    rows = [(0, c, i, 8, 8, 3, bytearray(p)) for c, ps in (("a", (half, bytes([100] * 192))), ("b", (bytes([3] * 192),) * 2)) for i, p in enumerate(ps)]
    d = images.frame_metrics(spark.createDataFrame(rows, "episode_index long, camera_key string, frame_index long, height int, width int, channels int, pixels binary"))
    r = visual.luma_summary(d).first()
    assert (r.dark_ratio, r.bright_ratio) == (1.0, 0.25)


def test_late_nan_stays_in_the_vector():
    v = [float(i) for i in range(40)]
    v[35] = float("nan")
    got = payloads.numbers(struct.pack("<40d", *v))
    assert len(got) == 40 and got[34] == 34.0 and got[35] != got[35]


def test_formats_without_a_writer(spark, tmp_path):
    assert E.fidelity(E.V2, E.HDF5) is None and E.fidelity(E.V2, E.MESSAGE_LOG) is None and E.fidelity(E.MESSAGE_LOG, E.MESSAGE_LOG) == "full"
    with pytest.raises(ValueError, match="nothing writes"):
        E.convert(spark, "x", "y", E.HDF5)
    path = str(tmp_path / "x.mcap")
    M.write_log(path, [("/joint", "s", t * 10**9, b"x") for t in (0, 1, 9)])
    made = E.export(spark, path, str(tmp_path / "y.mcap"), [1])
    assert (made["messages"], made["episodes"]) == (1, {"1": 0}) and [m[6] for m in M.messages(str(tmp_path / "y.mcap"))] == [9 * 10**9]
