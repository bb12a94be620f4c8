"""Seeded keys and exact 'the k smallest of each group' for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts into which a group's keys are cut; only the part with the k-th key is sorted.
PARTS = 1024


def uniform(seed: Column | str | int, *keys: Column | str) -> Column:
    """A number in (0, 1) that depends only on the seed and the keys (52 bits of a portable hash)."""
    text = F.concat_ws("\0", F.lit(seed) if isinstance(seed, (int, str)) else seed, *[F.col(k) if isinstance(k, str) else k for k in keys])
    return (F.conv(F.substring(F.sha2(text, 256), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def smallest(df: DataFrame, groups: list[str], key: str, k: str, tie: str) -> DataFrame:
    """The rows of each group with the ``k`` smallest values of ``key`` (k: a column, equal within a group).

    key lies in [0, 1).  The keys of a group are counted in PARTS equal parts first; parts below the
    one that holds the k-th key are taken whole and only that one is ranked (ties by ``tie``), so no
    task sorts a group.  Groups with fewer rows come whole; k of null or below 1 gives none.
    """
    part = F.least(F.lit(PARTS - 1), F.floor(F.col(key) * PARTS)).cast("int")
    df = df.withColumn("_part", part)
    counts = df.groupBy(*groups, "_part").agg(F.count("*").alias("_n"))
    upto = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    got = df.join(counts, [*groups, "_part"]).where(F.col("_before") < F.coalesce(F.col(k), F.lit(0)))
    whole = got.where(F.col("_before") + F.col("_n") <= F.col(k))
    edge = got.where(F.col("_before") + F.col("_n") > F.col(k))
    edge = edge.withColumn("_rank", F.row_number().over(Window.partitionBy(*groups, "_part").orderBy(key, tie))).where(F.col("_before") + F.col("_rank") <= F.col(k)).drop("_rank")
    return whole.unionByName(edge).drop("_part", "_n", "_before")
