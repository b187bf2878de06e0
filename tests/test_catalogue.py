"""The catalogue's queries against their SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, db, name):
    made = QUERIES[name](spark, str(DATA))
    columns = sorted(made.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in made.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
