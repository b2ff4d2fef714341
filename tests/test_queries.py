"""Every evaluation query against its SQL in DuckDB, over the smallest tables."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from evalweave.plans import registry

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(rows):
    def one(x):
        return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else x

    return Counter(tuple(one(x) for x in r) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = df.select(*(df[c] for c in columns)).collect()
    if name not in registry.ORACLES:
        assert got
        return
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got) == plain([r[k] for k in order] for r in want.fetchall())
