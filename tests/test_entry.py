"""The entry point: every query runs over the smallest tables, and agrees with its SQL."""

import glob
import importlib
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")
CORE = [n for m in entry.CORE for n in importlib.import_module(m).QUERIES]


def plain(x):
    if hasattr(x, "asDict"):
        x = tuple(x)
    if isinstance(x, float):
        return None if x != x else round(x, 6)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, int) and not isinstance(x, bool):
        return float(x)
    return x


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    rows = df.collect()
    if name in entry.oracle_sql():
        cur = duck.execute(entry.oracle_sql()[name])
        cols = [d[0] for d in cur.description]
        assert sorted(cols) == sorted(df.columns)
        order = [cols.index(c) for c in df.columns]
        want = sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == want


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("kind", ["empty", "dirty"])
def test_odd_tables(spark, tmp_path, kind):
    from tests.dirty import failures, make

    assert failures(spark, CORE, make(kind, str(tmp_path))) == []
