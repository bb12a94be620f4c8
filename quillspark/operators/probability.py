"""Probability vectors as long tables (key, place, label, p) and as arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def normalized(p: Column) -> Column:
    """An array of probabilities, negatives as 0, divided by their sum; uniform where that is 0."""
    pos = F.transform(p, lambda x: F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0)))
    total = F.aggregate(pos, F.lit(0.0), lambda a, x: a + x)
    return F.when(total > 0, F.transform(pos, lambda x: x / total)).otherwise(F.transform(p, lambda _: F.lit(1.0) / F.size(p)))


def argmax(p: Column, labels: list[str]) -> Column:
    """The label of the largest value, of equal ones the first declared."""
    return F.element_at(F.array(*map(F.lit, labels)), F.array_position(p, F.array_max(p)).cast("int"))


def weighted_average(df: DataFrame, by: list[str], label: str, p: str, weight: str) -> DataFrame:
    """Per group and label the weighted mean over models, normalised within the group."""
    avg = df.groupBy(*by, label).agg(F.coalesce(F.try_divide(F.sum(F.col(p) * F.col(weight)), F.sum(weight)), F.lit(0.0)).alias("_v"))
    total = F.sum(F.greatest(F.col("_v"), F.lit(0.0))).over(Window.partitionBy(*by))
    n = F.count("*").over(Window.partitionBy(*by))
    return avg.withColumn("p", F.when(total > 0, F.greatest(F.col("_v"), F.lit(0.0)) / total).otherwise(1.0 / n)).drop("_v")


def top_k(logits: Column, k: int) -> Column:
    """Which places have one of the k largest values; those equal to the k-th too."""
    kth = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda v: v >= kth)


def long_softmax(df: DataFrame, key: str, logits: str) -> DataFrame:
    """(key, place, p): the softmax of each row's array as rows; places are 0-based."""
    w = Window.partitionBy(key)
    d = df.select(key, F.array_max(logits).alias("_top"), F.posexplode(logits).alias("place", "_v")).select(key, "place", F.exp(F.col("_v") - F.col("_top")).alias("_e"))
    return d.select(key, "place", (F.col("_e") / F.sum("_e").over(w)).alias("p"))


def top_p(df: DataFrame, key: str, logits: str, p: float) -> DataFrame:
    """(key, place, p) of the nucleus: the likeliest places until their sum passes p, that one still in; equal ones by place."""
    d = long_softmax(df, key, logits)
    w = Window.partitionBy(key).orderBy(F.desc("p"), "place").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("_c", F.sum("p").over(w)).where(F.col("_c") - F.col("p") <= p).drop("_c")


def confidence(df: DataFrame, key: str, logits: str) -> DataFrame:
    """(key, top1, margin, neg_entropy): of the softmax, its largest value, that less the second, and the sum of p log p."""
    d = long_softmax(df, key, logits)
    top = F.slice(F.sort_array(F.collect_list("p"), asc=False), 1, 2)
    g = d.groupBy(key).agg(top.alias("_t"), F.sum(F.col("p") * F.log(F.col("p") + 1e-10)).alias("neg_entropy"))
    return g.select(key, F.get("_t", F.lit(0)).alias("top1"), (F.get("_t", F.lit(0)) - F.get("_t", F.lit(1))).alias("margin"), "neg_entropy")


def commit_step(df: DataFrame, by: list[str], place: str, conf: str, done: str, step: int, steps: int) -> DataFrame:
    """The places that a decoding step commits: the most confident ceil(open / (steps - step)) still open."""
    w = Window.partitionBy(*by)
    open_ = df.where(~F.col(done)).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(conf), place)))
    return open_.where(F.col("_r") <= F.ceil(F.col("_n") / (steps - step))).drop("_n", "_r")


def best_resolution(width: Column, height: Column, options: list[tuple[int, int]]) -> Column:
    """The option with the largest effective area, of equal ones the least waste, then the first."""
    def one(n, w, h):
        scale = F.least(F.lit(w) / width, F.lit(h) / height)
        eff = F.least(F.floor(width * scale) * F.floor(height * scale), width * height)
        return F.struct((-eff).cast("double").alias("e"), (w * h - eff).cast("double").alias("waste"), F.lit(n).alias("n"), F.lit(w).alias("width"), F.lit(h).alias("height"))

    best = F.array_min(F.array(*[one(n, w, h) for n, (w, h) in enumerate(options)]))
    return F.struct(best["width"].alias("width"), best["height"].alias("height"))
