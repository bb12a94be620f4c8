"""Similarity of vectors held in arrays."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null for a zero vector."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def nearest(base: DataFrame, queries: DataFrame, key: str, vec: str, k: int, block: int = 2048) -> DataFrame:
    """(query, key, cosine, rank): the k nearest rows of ``base`` for each query, itself left out, ties by key.

    The stated query set goes against all rows in blocks of ``block`` queries, so a block's matrix is
    bounded whatever the number of queries: each block is one matrix product per batch of rows, every
    task keeps k rows a query, and a block's result is written before the next is sent.  Rows without
    a vector are left out.
    """
    from pyspark.sql import Window

    from quillspark.session import table

    n = queries.count()
    q = queries.select(key, vec).where(f"{vec} is not null")
    blocks = max(1, -(-n // block))
    rows, parts = base.select(key, vec).where(f"{vec} is not null"), []
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == b).toPandas()
        if part.empty:
            continue
        m = np.stack(part[vec].to_numpy()).astype(np.float64)
        lengths = np.linalg.norm(m, axis=1, keepdims=True)
        m = np.divide(m, lengths, out=np.zeros_like(m), where=lengths > 0)
        shared = base.sparkSession.sparkContext.broadcast((part[key].to_numpy(), m))
        w = Window.partitionBy("query").orderBy(F.desc(F.round("cosine", 12)), "key")
        got = rows.mapInPandas(_block_scores(shared, key, vec, k), "query bigint, key bigint, cosine double")
        parts.append(table(got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k), "nearest") if blocks > 1 else got.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        if blocks > 1:
            shared.destroy()
    out = base.select(F.col(key).alias("query"), F.col(key).alias("key"), F.lit(0.0).alias("cosine"), F.lit(0).alias("rank")).where("false")
    for p in parts:
        out = out.unionByName(p)
    return out


def _block_scores(shared, key: str, vec: str, k: int):
    def run(batches):
        qi, qm = shared.value
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.stack(pdf[vec].to_numpy()).astype(np.float64)
            size = np.linalg.norm(x, axis=1, keepdims=True)
            x = np.divide(x, size, out=np.zeros_like(x), where=size > 0)
            own = pdf[key].to_numpy()
            s = qm @ x.T
            s[qi[:, None] == own[None, :]] = -np.inf
            if s.shape[1] > k:  # everything as good as the k-th, so that ties are told by key later
                least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
                rows, cols = np.nonzero(s >= least - 1e-11)
            else:
                rows, cols = np.nonzero(np.ones_like(s))
            ok = np.isfinite(s[rows, cols])
            rows, cols = rows[ok], cols[ok]
            yield pd.DataFrame({"query": qi[rows], "key": own[cols], "cosine": s[rows, cols]})

    return run


def greedy_match(a: Column, b: Column) -> Column:
    """Precision, recall and F1 of two arrays of vectors by their best cosine matches."""
    best = lambda xs, ys: F.aggregate(F.transform(xs, lambda x: F.array_max(F.transform(ys, lambda y: cosine(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(xs)
    p, r = best(a, b), best(b, a)
    return F.struct(p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"))
