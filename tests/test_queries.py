"""Every registered query against DuckDB on the driver's tables, in both row counts and values."""

import math
import os

import duckdb
import pytest

from tremor.plans import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF_DIR}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_matches_duckdb(spark, con, name):
    out = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(out.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in out.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert got
        return
    found = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert len(got) == len(expected)
    assert got == expected
    assert got, "the query gives no rows"
