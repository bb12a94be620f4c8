"""Copies of the smallest test tables: without rows, and with nulls, blanks, repeated rows, a very long text and clashing columns."""

import glob
import os

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

SRC = "/root/testdata/sf0.001"
CLASHING = ("h", "w", "pos", "t", "key", "rows", "size", "n", "k", "cell", "plan", "label", "value", "share", "hits", "row", "name", "names", "m", "length", "_rank", "_part", "p", "r", "s")


def make(kind: str, out: str) -> str:
    os.makedirs(out, exist_ok=True)
    for path in glob.glob(f"{SRC}/*.parquet"):
        t = pq.read_table(path)
        if kind == "empty":
            t = t.slice(0, 0)
        else:
            rng, cols = np.random.default_rng(1), {}
            for c in t.column_names:
                a = t[c].combine_chunks()
                values = [None if x else v for v, x in zip(a.to_pylist(), rng.random(len(a)) < 0.15)]
                if pa.types.is_string(a.type) and len(values) > 3 and c not in ("id", "field_name", "plan", "mix"):
                    values[:3] = ["", " \n", "word " * (20_000 if c == "text" else 50)]
                cols[c] = pa.array(values, a.type)
            t = pa.table(cols)
            t = pa.concat_tables([t, t.slice(0, max(1, len(t) // 10))])
            for c in CLASHING:
                if c not in t.column_names:
                    t = t.append_column(c, pa.array(["x"] * len(t)))
        pq.write_table(t, f"{out}/{os.path.basename(path)}")
    return out


def failures(spark, names, out) -> list[str]:
    import __spark_entry__ as entry

    bad = []
    for name in names:
        try:
            entry.queries()[name](spark, out).collect()
        except Exception as e:
            bad.append(f"{name}: {str(e).strip()[:200]}")
    return bad
