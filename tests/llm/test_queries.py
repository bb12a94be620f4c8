"""Every query of the subpackage over the smallest tables, their SQL, and odd copies of the tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from tests.dirty import SRC, failures, make
from tests.test_entry import plain

pytestmark = pytest.mark.skipif(not os.path.isdir(SRC), reason="no test tables here")
OWN = [n for n in entry.queries() if n[:1] == "p" and n[1:2].isdigit() and not n.startswith("p2_")]
COLUMNS = {
    "p1_found": ["id", "page"], "p3_found": ["speaker_id", "field_name", "label"], "p4_found": ["result_id", "field_name"], "p5_found": ["plan", "category"], "p6_found": ["index", "modality", "category", "score"],
    "p7_found": ["doc_id", "item_id"], "p8_found": ["mix", "source"], "p9_found": ["doc_a", "doc_b"],
}


@pytest.mark.parametrize("name", OWN)
def test_query(spark, name):
    df = entry.queries()[name](spark, SRC)
    rows = df.collect()
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)
    if name in entry.oracle_sql():
        c = duckdb.connect()
        for p in glob.glob(f"{SRC}/*.parquet"):
            c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
        cur = c.execute(entry.oracle_sql()[name])
        order = [[d[0] for d in cur.description].index(x) for x in df.columns]
        assert sorted((tuple(map(plain, r)) for r in rows), key=repr) == sorted((tuple(plain(r[k]) for k in order) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("kind", ["empty", "dirty"])
def test_odd_tables(spark, tmp_path, kind):
    assert failures(spark, OWN, make(kind, str(tmp_path))) == []
