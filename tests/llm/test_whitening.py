"""Whitening against NumPy on whole tables, and its edge cases."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from epiframe.llm import whitening

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, whitened string, x int, component int"


def brute(rows):
    """{(vec_id, component): (n, deviation, whitened, explained)} of (vec_id, vector) rows, repeats in a list."""
    held = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in held})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    m = np.array([float(Fraction(t, n)) for t in s])
    centred = np.array(fit, float) - m
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    out = []
    for i, x in held:
        d = sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True))
        for k in range(min(4, int((e > 1e-11 * e[0]).sum()))):
            out.append((i, k + 1, n, d, float((np.array(x) - m) @ u[:, k] / math.sqrt(e[k])), e[k] / np.trace(v)))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))


def query(spark, path):
    return sorted((tuple(r) for r in whitening.op13_embedding_whitening(spark, path).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4])))


def same(got, want):
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for k in {r[1] for r in want}:
        a, b = (np.array([r[4] for r in t if r[1] == k]) for t in (got, want))
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-9  # one sign for all rows
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-10)
    assert len({r[6] for r in got}) == 1 and got[0][6] < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_against_numpy(spark, sf):
    path = f"/root/testdata/{sf}"
    same(query(spark, path), brute([(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]))


@pytest.mark.parametrize("dim", [3, 32, 33, 70])
def test_odd_rows_repeats_and_widths(spark, tmp_path, dim):
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(60, dim)) * np.linspace(1, 3, dim)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [rows[3], (None, rows[5][1]), (3, rows[9][1])]  # a hot vector, repeats, a null id
    rows += [(200, None), (201, []), (202, [None] * dim), (203, [float("nan")] * dim), (204, [float("inf")] + [0.0] * (dim - 1)), (205, [0.0] * dim), (206, [-0.0] * dim)]
    odd = [(300, [1.0] * (dim + 1))]  # of another length
    spark.createDataFrame([(*r, "w", 1, 2) for r in rows + odd], SCHEMA).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(query(spark, str(tmp_path)), brute(rows))


@pytest.mark.parametrize("rows", [[], [(1, [0.5, 0.25])] * 3, [(1, None)]])
def test_nothing_to_whiten(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert query(spark, str(tmp_path)) == []


def test_components_without_variance_and_large_entries(spark, tmp_path):
    rows = [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)]
    spark.createDataFrame([(*r, "w", 1, 2) for r in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    same(query(spark, str(tmp_path)), brute(rows))
    assert {r[1] for r in query(spark, str(tmp_path))} == {1}
    big = spark.createDataFrame([(i, [3e30 * i, 1.0 * i * i], "w", 1, 2) for i in range(5)], SCHEMA)
    out, _, _ = whitening.whitened(big)
    assert out.count() == 5 and out.where(F.col("deviation").isNotNull()).count() == 0
