"""Mixes of sources with target shares of the total size (problem 8).

Each source's budget is fitted by lengths, not by documents: documents are counted by their exact
token length; whole passes over the source come first, a seeded proportional part of every length
next, and what then remains of the budget is filled by a bounded knapsack over the lengths left.
Only (source, length, count) rows reach the planning; seeded documents are then picked by length.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.sampling import smallest, uniform
from quillspark.functions.skew import lookup_join
from quillspark.functions.tokencount import RANKS, token_counts
from quillspark.session import read, table

#: What the knapsack fills exactly is less than this many tokens, or twice the longest text left.
LAST_TOKENS = 1 << 15


def source_name(column):
    """A source as it is compared: lower case, outer spaces aside."""
    return F.lower(F.btrim(column, F.lit("".join(map(chr, (*range(9, 14), *range(28, 33), 0xA0))))))


def knapsack(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as close below ``budget`` as can be.

    The reachable sums are the bits of one number, shifted and joined by binary parts of each count.
    Each sum keeps only the part that first reached it, so memory goes with the budget (about five
    bytes a token) and not with the lengths; the search ends once the budget itself is reached.
    """
    full = (1 << (budget + 1)) - 1
    reach, parts = 1, []
    first = np.zeros(budget + 1, np.int32)
    for k, (size, n) in enumerate(zip(lengths, counts)):
        n = min(n, budget // size) if size else 0
        step = 1
        while n > 0 and not reach >> budget & 1:
            take = min(step, n)
            fresh = (reach << (take * size)) & full & ~reach
            if fresh:
                bits = np.unpackbits(np.frombuffer(fresh.to_bytes(budget // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(parts)
                parts.append((k, take))
                reach |= fresh
            n -= take
            step *= 2
    at, used = reach.bit_length() - 1, [0] * len(lengths)
    while at:  # the sum before a part was reached by earlier parts only, so no part comes twice
        k, take = parts[first[at]]
        used[k] += take
        at -= take * lengths[k]
    return used


def plan_lengths(lengths: list[int], counts: list[int], budget: int, repeats: int) -> tuple[int, list[int]]:
    """(whole passes, documents of each length used once more) for one source.

    Lengths are positive and different.  The sum never goes over the budget; with ``repeats`` whole
    passes used up nothing is added.
    """
    total = sum(a * n for a, n in zip(lengths, counts))
    if total <= 0 or budget <= 0 or repeats <= 0:
        return 0, [0] * len(lengths)
    passes = min(repeats, budget // total)
    rest = budget - passes * total
    if passes == repeats or rest <= 0:
        return passes, [0] * len(lengths)
    extra = [n * rest // total for n in counts]
    left = rest - sum(a * n for a, n in zip(lengths, extra))
    # what the rounding left: single documents, the longest first, until the knapsack can take over
    order = sorted(range(len(lengths)), key=lambda k: -lengths[k])
    for k in order:
        last = max(LAST_TOKENS, 2 * lengths[k])
        if left > last and extra[k] < counts[k]:
            more = min(counts[k] - extra[k], (left - last) // lengths[k] + 1, left // lengths[k])
            extra[k] += more
            left -= more * lengths[k]
    # texts longer than the knapsack is wide: single ones while one fits
    for k in order:
        if left > 4 * LAST_TOKENS:
            more = min(counts[k] - extra[k], -(-(left - 4 * LAST_TOKENS) // lengths[k]), left // lengths[k])
            extra[k] += more
            left -= more * lengths[k]
    # more than 4 * LAST_TOKENS is only left where no remaining text fits, so this bounds the knapsack
    small = [k for k in order if extra[k] < counts[k] and lengths[k] <= left]
    fill = knapsack([lengths[k] for k in small], [counts[k] - extra[k] for k in small], left) if small else []
    for k, n in zip(small, fill):
        extra[k] += n
    return passes, extra


def _plan(pdf):
    import pandas as pd

    pdf = pdf.sort_values("length")
    first = pdf.iloc[0]
    repeats = 0 if pd.isna(first.max_repeats) else int(first.max_repeats)
    lengths, counts = [int(x) for x in pdf.length if x > 0], [int(n) for n, x in zip(pdf.n, pdf.length) if x > 0]
    passes, extra = plan_lengths(lengths, counts, int(first.budget), repeats)
    return pd.DataFrame({"mix": first.mix, "name": first["name"], "length": lengths, "n": counts, "passes": passes, "extra": extra})


class Mix:
    """Plans for all mixes; sizes, shares and the documents of each."""

    def __init__(self, docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", path: str = RANKS):
        """Null texts have size 0, null shares and ratios are 0; null sources belong to no target but to the total; a key that comes again counts once."""
        picked = docs.select(F.col(key).cast("bigint").alias("doc_id"), source_name(F.col(source)).alias("name"), F.col(text).alias("t")).where("doc_id is not null")
        sized = token_counts(picked, ["doc_id", "name"], "t", path).groupBy("doc_id").agg(F.min("name").alias("name"), F.max("tokens").alias("length"))
        self.sized = table(sized, "mix-sizes")
        self.histogram = table(self.sized.groupBy("name", "length").agg(F.count("*").alias("n")), "mix-lengths")
        total = self.histogram.agg(F.coalesce(F.sum(F.col("length") * F.col("n")), F.lit(0))).collect()[0][0]
        self.total = int(total)
        self.targets = targets.where("mix is not null and source is not null").select("mix", "source", "target_share", "max_repeats", "budget_ratio").withColumn("name", source_name(F.col("source"))).withColumn("wanted", F.coalesce("target_share", F.lit(0.0)) * F.coalesce("budget_ratio", F.lit(0.0)) * F.lit(float(self.total)))
        asked = self.targets.groupBy("mix", "name").agg(F.sum("wanted").alias("wanted"), F.min("max_repeats").alias("max_repeats")).withColumn("budget", F.floor(F.col("wanted") + 1e-6))
        joined = self.histogram.join(F.broadcast(asked) if asked.count() <= 100_000 else asked, "name")
        planned = joined.select("mix", "name", "length", "n", "max_repeats", "budget").groupBy("mix", "name").applyInPandas(_plan, "mix string, name string, length bigint, n bigint, passes bigint, extra bigint")
        self.planned = table(planned, "mix-plan")

    def report(self) -> DataFrame:
        """(mix, source, target_share, actual_share, wanted, size, most, short): one row per target.

        size is the tokens planned, most what the source can give at its repeat cap, and short tells
        that this is less than wanted.
        """
        sizes = self.histogram.groupBy("name").agg(F.sum(F.col("length") * F.col("n")).alias("own"))
        used = self.planned.groupBy("mix", "name").agg(F.sum(F.col("length") * (F.col("n") * F.col("passes") + F.col("extra"))).alias("size"))
        got = self.targets.join(sizes, "name", "left").join(used, ["mix", "name"], "left").withColumn("size", F.coalesce("size", F.lit(0))).withColumn("most", F.coalesce("own", F.lit(0)) * F.coalesce("max_repeats", F.lit(0)))
        share = F.try_divide(F.col("size").cast("double"), F.sum("size").over(Window.partitionBy("mix")))
        return got.select("mix", "source", "target_share", share.alias("actual_share"), "wanted", "size", "most", (F.col("most") < F.col("wanted")).alias("short"))

    def documents(self, seed: str = "11") -> DataFrame:
        """(mix, doc_id, uses): how often each document is used; those that are not have no row.

        Of the documents of one source and length, the seed decides which are used once more.
        """
        joined = lookup_join(self.sized, self.planned, ["name", "length"], F.col("doc_id"))
        keyed = joined.withColumn("key", uniform(seed, "mix", "doc_id"))
        more = smallest(keyed.where("extra > 0"), ["mix", "name", "length"], "key", "extra", "doc_id").select("mix", "doc_id", F.lit(1).cast("bigint").alias("uses"))
        whole = joined.where("passes > 0").select("mix", "doc_id", F.col("passes").alias("uses"))
        return whole.unionByName(more).groupBy("mix", "doc_id").agg(F.sum("uses").alias("uses"))


def _mix(spark: SparkSession, sf_dir: str) -> Mix:
    return Mix(read(spark, sf_dir, "documents"), read(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target whose source falls short of its share at its repeat cap."""
    got = _mix(spark, sf_dir).report()
    # the fitted budget stays below what is wanted; that nothing more was to be had is checked on top
    return got.where("size < wanted and short").select("mix", "source").distinct()


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The actual share of each source in each mix."""
    return _mix(spark, sf_dir).report().select("mix", "source", "target_share", F.round("actual_share", 6).alias("actual_share"), F.round("wanted", 1).alias("wanted"), "size", "most", "short")


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each mix uses each document."""
    return _mix(spark, sf_dir).documents()


QUERIES = {"p8_found": p8_found, "p8_shares": p8_shares, "p8_documents": p8_documents}
_SQL_SPACES = " || ".join(f"chr({k})" for k in (*range(9, 14), *range(28, 33), 0xA0))
_SQL_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+".replace("'", "''")
ORACLE = {
    # sizes in the pieces that the tokenizer splits texts into before it merges bytes, so of another tokenizer
    "p8_found": f"""
WITH d AS (SELECT doc_id, min(lower(trim(source, {_SQL_SPACES}))) AS name, max(coalesce(len(regexp_extract_all(text, '{_SQL_PIECES}')), 0)) AS n FROM documents WHERE doc_id IS NOT NULL GROUP BY doc_id),
s AS (SELECT name, sum(n) AS own FROM d GROUP BY name), t AS (SELECT coalesce(sum(n), 0) AS total FROM d)
SELECT DISTINCT m.mix, m.source FROM mix_targets m CROSS JOIN t LEFT JOIN s ON s.name = lower(trim(m.source, {_SQL_SPACES}))
WHERE m.mix IS NOT NULL AND m.source IS NOT NULL AND coalesce(own, 0) * coalesce(max_repeats, 0) < coalesce(target_share, 0) * coalesce(budget_ratio, 0) * total"""
}
