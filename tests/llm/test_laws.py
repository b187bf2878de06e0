"""What SQL can say of the operators' results, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from tidemark.llm.queries import ORACLES, QUERIES

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    db = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    made = QUERIES[name](spark, str(DATA))
    columns = sorted(made.columns)
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in made.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)
