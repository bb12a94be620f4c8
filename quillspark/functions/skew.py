"""Joins whose keys may be held by a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows up to which a looked-up table is broadcast; above, the join is salted.
BROADCAST_ROWS = 200_000


def lookup_join(left: DataFrame, right: DataFrame, key: str | list[str], spread: Column, rows: int | None = None, how: str = "inner", salts: int = 16) -> DataFrame:
    """Join ``left`` to a table with few rows per key, however skewed the keys of ``left`` are.

    Up to BROADCAST_ROWS rows ``right`` is broadcast (the count is the check); beyond, each row of
    ``right`` is given ``salts`` times and each of ``left`` goes to one of them by ``spread``.
    """
    if (right.count() if rows is None else rows) <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), key, how)
    left = left.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*([key] if isinstance(key, str) else key), "_salt"], how).drop("_salt")


def counted_join(left: DataFrame, right: DataFrame, key: str, count: str, spread: Column, most: int = 20_000) -> DataFrame:
    """Inner join of ``left`` to ``right`` (few rows per key), whose column ``count`` says how many rows of ``left`` have the key.

    Keys of more than ``most`` rows are few and are sent to them; the rows of all others go to their key,
    which no task then has more than ``most`` of.  A ``right`` of up to BROADCAST_ROWS rows is broadcast whole.
    """
    if right.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right.drop(count)), key)
    hot, cold = right.where(F.col(count) > most).drop(count), right.where(F.col(count) <= most).drop(count)
    return lookup_join(left, hot, key, spread).unionByName(left.join(cold, key))
