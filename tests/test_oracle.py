"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from epiframe.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def key(row):
    return tuple("" if v is None else f"{v:.5f}" if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    rel = duck.execute(registry.ORACLES[name])
    cols = [d[0] for d in rel.description]
    assert sorted(cols) == sorted(got.columns)
    want = sorted(key(r) for r in rel.fetchall())
    have = sorted(key(r) for r in got.select(*cols).collect())
    assert len(have) == len(want)
    assert have == want
