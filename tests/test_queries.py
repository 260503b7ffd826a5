"""Every query with SQL against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from leafweave.plans import registry

DATA = os.environ.get("LEAFWEAVE_TEST_DATA", "/root/testdata/sf0.001")
TABLES = ("documents", "pages", "labels", "benchmark", "conversations", "events")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool | str):
        return v
    return float(f"{float(v):.9g}")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    got = registry.queries()[name](spark, DATA)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [x[0] for x in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    assert sorted(names) == sorted(got.columns)
    order = sorted(names)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got.collect()), key=repr) == sorted((tuple(plain(r[c]) for c in order) for r in want), key=repr)


def test_all_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
