"""Attribute comparison, frequencies and bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

FIELDS = ("emotion", "speed", "pitch", "gender")
#: Units a second and hertz at which speech changes class; (low, high) by gender, '' for others. Fixed values.
SPEED = (2.6, 4.7)
PITCH = {"male": (110.0, 170.0), "female": (165.0, 255.0), "": (145.0, 220.0)}


def matches(candidate: str, truth: str, present: Column) -> list[Column]:
    """One flag per field: equal as labels; null equals null; nothing matches without a candidate."""
    return [(present & (T.label(f"{candidate}.{f}") == T.label(f"{truth}.{f}"))).alias(f) for f in FIELDS]


def accuracy(df: DataFrame, expected: Column) -> DataFrame:
    """Correct per field, mean share per item and exact matches, all over the expected number of items."""
    share = sum(F.col(f).cast("int") for f in FIELDS) / len(FIELDS)
    exact = F.col(FIELDS[0]) & F.col(FIELDS[1]) & F.col(FIELDS[2]) & F.col(FIELDS[3])
    n = expected.cast("double")
    rate = lambda c: F.coalesce(F.try_divide(c, n), F.lit(0.0))
    return df.agg(*[rate(F.count_if(f)).alias(f"{f}_accuracy") for f in FIELDS], rate(F.sum(share)).alias("item_accuracy"), rate(F.count_if(exact)).alias("exact_accuracy"), F.count("*").alias("written"))


def frequencies(df: DataFrame, candidate: str, truth: str, present: Column) -> DataFrame:
    """(field, side, label, n): labels of candidates, truths and correct candidates; blanks dropped.

    Truths count whether or not there is a candidate.
    """
    rows = []
    for f in FIELDS:
        c, t = T.label(f"{candidate}.{f}"), T.label(f"{truth}.{f}")
        rows += [F.struct(F.lit(f).alias("field"), F.lit("candidate").alias("side"), F.when(present, c).alias("label")), F.struct(F.lit(f).alias("field"), F.lit("ground_truth").alias("side"), t.alias("label"))]
        rows += [F.struct(F.lit(f).alias("field"), F.lit("correct_candidate").alias("side"), F.when(present & (c == t), c).alias("label"))]
    return df.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("label <> ''").groupBy("field", "side", "label").agg(F.count("*").alias("n"))


def speed_class(rate: Column) -> Column:
    """slow below the first bound, fast above the second, else normal (also for null and NaN)."""
    return F.when(rate.isNull() | F.isnan(rate), "normal").when(rate < SPEED[0], "slow").when(rate > SPEED[1], "fast").otherwise("normal")


def pitch_class(hertz: Column, gender: Column) -> Column:
    """low, normal or high by the bounds of the gender."""
    g = T.lookup(gender, T.GENDERS)
    low = F.when(g == "male", PITCH["male"][0]).when(g == "female", PITCH["female"][0]).otherwise(PITCH[""][0])
    high = F.when(g == "male", PITCH["male"][1]).when(g == "female", PITCH["female"][1]).otherwise(PITCH[""][1])
    return F.when(hertz.isNull() | F.isnan(hertz), "normal").when(hertz < low, "low").when(hertz > high, "high").otherwise("normal")


def gender_of(female: Column, male: Column) -> Column:
    """male if at least as likely as female; no other class is chosen."""
    return F.when(F.coalesce(male, F.lit(0.0)) >= F.coalesce(female, F.lit(0.0)), "male").otherwise("female")


def speech_rate(chunks: Column, words: Column, duration: Column) -> Column:
    """Timed units over their span (1e-6 s at least), or else words over the duration; null without either.

    chunks: array of struct<start, end, text>; those without text or with no positive length don't count.
    """
    good = F.filter(chunks, lambda c: (T.strip(c["text"]) != "") & c["start"].isNotNull() & (c["end"] > c["start"]))
    span = F.greatest(F.array_max(F.transform(good, lambda c: c["end"])) - F.array_min(F.transform(good, lambda c: c["start"])), F.lit(1e-6))
    return F.when(F.size(good) > 0, F.size(good) / span).when((words > 0) & (duration > 0), words / duration)


def pitch_summary(f0: Column | str, *by: str):
    """Aggregates: median and mean of voiced frames (five at least) and their share of all frames."""
    v = F.col(f0) if isinstance(f0, str) else f0
    voiced = F.when(~F.isnan(v), v)
    enough = F.count(voiced) >= 5
    return [F.when(enough, F.percentile(voiced, F.lit(0.5))).alias("median_f0"), F.when(enough, F.avg(voiced)).alias("mean_f0"), F.when(enough, F.count(voiced) / F.count("*")).otherwise(0.0).alias("voiced_ratio")]
