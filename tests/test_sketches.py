"""Quantile sketches against exact ranks, and through merges of datasets."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.operators import stats as ST
from epiframe.sources import episodes as E
from epiframe.sources import merging
from epiframe.sources import sketches as K


def rank_span(values, x):
    v = np.sort(np.asarray(values))
    return np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)


def off(values, row):
    """The largest distance of a told quantile's ranks from the one asked for."""
    out = 0.0
    for q, p in ST.QUANTILES.items():
        lo, hi = rank_span(values, row[q])
        out = max(out, lo - p, p - hi)
    return out


def test_sketches_merge_within_the_stated_error(spark):
    d = spark.range(300_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 40).alias("part"), F.when(F.col("id") % 3 == 0, F.exp(F.rand(3) * 8)).when(F.col("id") % 3 == 1, F.floor(F.rand(4) * 3)).otherwise(F.randn(5)).alias("v")).persist()
    parts = ST.value_sketches(d, ["k", "part"], "v")
    assert max(r[0] for r in parts.select(F.length("sketch")).collect()) < 6000
    told = spark.createDataFrame(ST.merge_sketches(parts, ["k"]).drop("sketch").collect())  # chance is drawn anew by each run
    values = {k: [r.v for r in d.where(F.col("k") == k).select("v").collect()] for k in range(3)}
    errors = {r.k: r.worst_error for r in ST.quantile_errors(d, ["k"], "v", told).collect()}
    for r in told.collect():
        assert r["count"] == 100_000 and errors[r.k] == pytest.approx(off(values[r.k], r), abs=1e-9)
        assert errors[r.k] <= 2 * ST.rank_error()  # the stated one holds in 99 of 100 cases
    d.unpersist()


def test_nothing_and_odd_values(spark):
    d = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", 3.0), ("a", float("inf")), ("b", None), (None, 5.0)], "k string, v double")
    got = {r.k: r for r in ST.merge_sketches(ST.value_sketches(d, ["k"], "v"), ["k"]).collect()}
    assert (got["a"]["count"], got["a"].q01, got["a"].q99) == (2, 1.0, 3.0)
    assert (got["b"]["count"], got["b"].q50) == (0, None) and got[None].q50 == 5.0
    assert ST.merge_sketches(ST.value_sketches(d.where("false"), ["k"], "v"), ["k"]).count() == 0
    order = lambda x: sorted(map(tuple, x.collect()), key=lambda r: str(r[0]))
    assert order(ST.bounded_stats(d, ["k"], "v")) == order(ST.feature_stats(d, ["k"], "v"))


def test_bounded_statistics(spark):
    """A group beyond the cap is sketched, one at the cap is exact; a null key may be either."""
    d = spark.range(5000).select(F.when(F.col("id") % 5 > 0, F.lit("large")).alias("k"), F.col("id").cast("double").alias("v"))
    got = {r.k: r for r in ST.bounded_stats(d, ["k"], "v", cap=1000).collect()}
    exact = {r.k: r for r in ST.feature_stats(d, ["k"], "v").collect()}
    assert got[None] == exact[None] and got["large"]["count"] == 4000
    assert [got["large"][c] for c in ("min", "max", "mean", "std")] == [exact["large"][c] for c in ("min", "max", "mean", "std")]
    assert off([i for i in range(5000) if i % 5], got["large"]) <= 2 * ST.rank_error()
    assert {r.k: r for r in ST.bounded_stats(d, ["k"], "v", cap=999).collect()}[None]["count"] == 1000


def dataset(spark, path, kind, lengths, low, high):
    rng = np.random.default_rng(7)
    x = {e: rng.uniform(low, high, n) for e, n in lengths.items()}
    rows = [(e, f, [float(v), 1.0]) for e, vs in x.items() for f, v in enumerate(vs)]
    E.WRITERS[kind](spark.createDataFrame(rows, "episode_index long, frame_index long, action array<double>"), path, 10.0)
    return [v for vs in x.values() for v in vs]


@pytest.mark.parametrize("kind", [E.V2, E.V3])
def test_merged_quantiles(spark, tmp_path, kind):
    """Sources far apart: the weighted mean of medians lies where there are no values, the sketches' median does not."""
    a, b, c, out, again = (str(tmp_path / x) for x in ("a", "b", "c", "out", "again"))
    x = dataset(spark, a, kind, {0: 900, 1: 300}, 0.0, 1.0) + dataset(spark, b, kind, {0: 800}, 100.0, 101.0)
    z = dataset(spark, c, kind, {0: 700}, 50.0, 51.0)
    for p in (a, b):
        K.add(spark, p)
    merging.merge(spark, [a, b], out)
    stats = lambda p: json.loads(Path(p, "meta/stats.json").read_text())["action"]
    first = {q: v[0] for q, v in stats(out).items()}
    assert off(x, first) <= 2 * ST.rank_error() and first["q50"] < 1.0
    assert [v[1] for q, v in stats(out).items() if q in ST.QUANTILES] == [1.0] * 5
    assert {(r.episode_index, r.dim): r["count"] for r in K.read(spark, out).collect()} == {(e, i): n for e, n in enumerate((900, 300, 800)) for i in range(2)}
    two = {r.dim: r for r in K.quantiles(spark, out, [0, 2]).collect()}
    assert two[0]["count"] == 1700 and off(x[:900] + x[1200:], two[0]) <= 2 * ST.rank_error()
    K.add(spark, c)
    merging.merge(spark, [out, c], again)
    assert off(x + z, {q: v[0] for q, v in stats(again).items()}) <= 2 * ST.rank_error()
    K.add(spark, c, 400)  # in place of those it has
    assert K.read(spark, c).count() == 2


def test_estimates_stay_without_sketches(spark, tmp_path):
    """A source without sketches leaves the merge with estimates; sketches of other frames are not believed."""
    a, b, one, two = (str(tmp_path / x) for x in ("a", "b", "one", "two"))
    dataset(spark, a, E.V3, {0: 30}, 0.0, 1.0)
    dataset(spark, b, E.V3, {0: 30}, 100.0, 101.0)
    K.add(spark, a)
    with pytest.raises(ValueError, match="no sketches"):
        K.quantiles(spark, b)
    merging.merge(spark, [a, b], one)
    assert K.read(spark, one) is None and 40 < json.loads(Path(one, "meta/stats.json").read_text())["action"]["q50"][0] < 60
    K.add(spark, b)
    K.write(K.read(spark, b).withColumn("count", F.col("count") + 1), E.Store(spark, b))
    merging.merge(spark, [a, b], two)
    assert 40 < json.loads(Path(two, "meta/stats.json").read_text())["action"]["q50"][0] < 60
