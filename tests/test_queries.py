"""Every named query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from corpusloom.plans import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 9) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    if name not in catalog.SQL:
        assert got
        return
    cur = con.execute(catalog.SQL[name])
    at = {c[0]: i for i, c in enumerate(cur.description)}
    assert sorted(at) == cols
    want = sorted(([plain(r[at[c]]) for c in cols] for r in cur.fetchall()), key=repr)
    assert got == want
