"""Every signal query against its SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import undula.plans.more_queries  # noqa: F401  (adds to the queries)
from undula.plans.queries import ORACLES, QUERIES

FOLDER = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(rows):
    """Rows as tuples in an order that allows for nulls."""
    tidy = [tuple(None if isinstance(x, float) and math.isnan(x) else x for x in r) for r in rows]
    return sorted(tidy, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_beyond_sql(spark, name):
    """What SQL can't express has tests of its own; here it runs and has no NaN."""
    rows = QUERIES[name](spark, str(FOLDER)).collect()
    assert rows
    if name == "heart_beats_matched":
        assert all(r.f1 > 0.98 for r in rows if r.tp + r.fn > 5)
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, tables, name):
    found = QUERIES[name](spark, str(FOLDER))
    columns = sorted(found.columns)
    want = tables.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert plain(tuple(r) for r in found.select(*columns).collect()) == plain(want)
    assert want
