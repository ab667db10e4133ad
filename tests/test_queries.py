"""Every registered query of the engine against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from heatfield.plans.queries import ORACLES, QUERIES

DIR = os.environ.get("HEATFIELD_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DIR):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return con


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    cur = duck.execute(ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(got.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) and not math.isnan(v) else v
    key = lambda rows: sorted(repr([plain(v) for v in r]) for r in rows)
    assert key(got.select(*cols).collect()) == key(cur.fetchall())
