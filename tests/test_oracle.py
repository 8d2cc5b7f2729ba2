"""Every query with a SQL twin gives the twin's rows."""

import duckdb
import pytest

from check_oracle import normal
from tidepanel.plans import ORACLES, QUERIES
from tidepanel.plans.scans import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_twin(spark, sf, duck, key):
    df = QUERIES[key](spark, sf)
    got = df.collect()
    result = duck.execute(ORACLES[key])
    names = [c[0] for c in result.description]
    want = result.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted(tuple(normal(r[c]) for c in order) for r in got)
    right = sorted(tuple(normal(r[names.index(c)]) for c in order) for r in want)
    assert left == right
    assert left
