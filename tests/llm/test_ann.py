"""That probing and the dimension test decide what is read, and how much the search still finds."""

import numpy as np
import pytest

from epiframe.llm import ann


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_lists_and_dimensions_read(spark, sf):
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    grid = ann.Quantizer(x, int(2 * np.sqrt(len(x))))
    assert grid.first < grid.probes < 0.7 * grid.lists
    q, lists = np.arange(0, len(x), 10), grid.lists_of(x)
    order, bound, best, read = grid.order(x[q], grid.probes), np.full(len(q), np.inf), [[] for _ in q], 0
    for start, end in ((0, grid.first), (grid.first, grid.probes)):
        for cell in range(grid.lists):
            ids, asks = np.flatnonzero(lists == cell), np.flatnonzero((order[:, start:end] == cell).any(1))
            if len(ids) and len(asks):
                place, found, d, n = ann.scan(x[q[asks]], bound[asks], ids, x[ids], 11, grid)
                read += n
                for i, v, s in zip(asks[place], found, d, strict=True):
                    best[i].append((s, v))
        best = [sorted(b)[:11] for b in best]
        bound = np.array([b[-1][0] ** 2 if len(b) == 11 else np.inf for b in best])
    hits = 0
    for i, own in zip(q, best, strict=True):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        hits += len(set(np.argsort(d)[:10]) & {v for _, v in own if v != i})
    assert hits / len(q) / 10 >= 0.9
    assert read < 0.65 * x.size * len(q)  # of all dimensions of all vectors


def test_a_known_distance_abandons_what_is_far():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 64))
    grid, ids, q = ann.Quantizer(x, 8), np.arange(500), x[:3]
    exact = np.sqrt(((x[None] - q[:, None]) ** 2).sum(2))
    place, found, d, read = ann.scan(q, np.full(3, np.inf), ids, x, 500, grid)
    assert np.allclose(d, np.sort(exact, 1).ravel()) and read == 3 * 500 * 64  # nothing is known: all is read
    place, found, d, less = ann.scan(q, np.sort(exact, 1)[:, 5] ** 2, ids, x, 6, grid)
    assert less < 0.7 * read and np.allclose(d[place == 0], np.sort(exact[0])[: (place == 0).sum()]) and set(found[place == 1]) <= set(np.argsort(exact[1])[:6])
