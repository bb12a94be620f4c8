"""Content-addressed results: keys, hits, misses and additions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def canonical_key(**parts: Column | str) -> Column:
    """sha256 of the parts as JSON with sorted names, for keys that Spark and SQL agree on.

    Strings are escaped as JSON does; null is null; numbers are written as they are cast to string.
    """
    def one(name: str, c) -> Column:
        c = F.col(c) if isinstance(c, str) else c
        text = F.to_json(F.struct(c.cast("string").alias("x")))
        return F.concat(F.lit(json.dumps(name) + ": "), F.when(c.isNull(), "null").otherwise(F.substring(text, F.lit(6), F.length(text) - 6)))

    body = F.concat_ws(", ", *[one(n, parts[n]) for n in sorted(parts)])
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")).cast("binary"), 256)


def json_key(payload: Column) -> Column:
    """sha256 of a JSON text with its keys sorted at every depth and unescaped non-ASCII; null for malformed JSON."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return hashlib.sha256(json.dumps(json.loads(t), sort_keys=True, ensure_ascii=False).encode()).hexdigest()
            except (TypeError, ValueError):
                return None

        return texts.map(one)

    return run(payload)


def lookup(wanted: DataFrame, stored: DataFrame, key: str, files: Column | int) -> DataFrame:
    """``wanted`` with hit: whether all of a key's files are stored. ``stored`` has one row per file."""
    have = stored.groupBy(key).agg(F.count("*").alias("_n"))
    n = F.lit(files) if isinstance(files, int) else files
    return wanted.join(have, key, "left").withColumn("hit", F.coalesce(F.col("_n") >= n, F.lit(False))).drop("_n")


def hit_ratio(df: DataFrame, *by: str) -> DataFrame:
    g = df.groupBy(*by).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    return g.withColumn("ratio", F.try_divide(F.col("hits").cast("double"), F.col("hits") + F.col("misses")))


def additions(new: DataFrame, stored: DataFrame, key: str, tie: str) -> DataFrame:
    """Rows to add: keys that are not stored, of several for one key the first by ``tie``; what is stored stays."""
    first = new.groupBy(key).agg(F.min_by(F.struct("*"), tie).alias("_r")).select("_r.*")
    return first.join(stored.select(key).distinct(), key, "left_anti")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, length, sha256, blob_sha1) of a binaryFile listing; blob_sha1 is git's name for the content."""
    head = F.concat(F.lit("blob ").cast("binary"), F.col("length").cast("string").cast("binary"), F.unhex(F.lit("00")))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), F.sha1(F.concat(head, F.col("content"))).alias("blob_sha1"))


def backoff(attempt: Column, base: float = 10.0, most: float = 60.0) -> Column:
    """Seconds to wait before the next attempt: doubled each time, bounded."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt.cast("double")))
