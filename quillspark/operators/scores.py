"""Averages, histograms, gates and tables over judged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.judgejson import CATEGORIES

#: Inference states of rows that no gate counts. Fixed values.
NOT_ELIGIBLE = ("skipped", "dry_run_ok", "dry_run_missing")


def zero_filled(value: Column | str) -> list[Column]:
    """average with null as 0.0, how many were null, and the average of what is there."""
    v = F.col(value) if isinstance(value, str) else value
    return [F.coalesce(F.avg(F.coalesce(v, F.lit(0.0))), F.lit(0.0)).alias("average"), F.count_if(v.isNull()).alias("zero_filled_count"), F.avg(v).alias("valid_average")]


def finite(value: Column | str) -> Column:
    """The value, or null where it is no finite number."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)


def valid_score(score: Column) -> Column:
    """A score 1..10, else null."""
    return F.when(score.between(1, 10), score)


def long_scores(results: DataFrame) -> DataFrame:
    """(result_id, index, modality, stage, judge, category, score): every category that a result should have.

    A category that the result lacks, or whose score is none of 1..10, has a null score.  A
    result_id that comes again counts once: what is shuffled for that is the scores alone.
    """
    wanted = F.create_map(*[x for m, cs in CATEGORIES.items() for x in (F.lit(m), F.array(*map(F.lit, cs)))])
    scores = F.transform(F.try_element_at(wanted, F.col("modality")), lambda c: F.struct(c.alias("category"), valid_score(F.try_element_at("judge_eval", c)["score"]).alias("score")))
    once = results.where("result_id is not null").select("result_id", "index", "modality", "stage", "judge", scores.alias("s")).groupBy("result_id").agg(*[F.first(c).alias(c) for c in ("index", "modality", "stage", "judge", "s")])
    return once.select("result_id", "index", "modality", "stage", "judge", F.inline("s"))


def judge_average(scores: DataFrame, *by: str) -> DataFrame:
    """Per group: records, the mean of the records' zero-filled means, and how many records lack a score."""
    record = scores.groupBy(*by, "result_id").agg(F.avg(F.coalesce("score", F.lit(0)).cast("double")).alias("mean"), F.bool_or(F.col("score").isNull()).alias("lacks"))
    return record.groupBy(*by).agg(F.count("*").alias("record_count"), F.avg("mean").alias("average"), F.count_if("lacks").alias("zero_filled_record_count"))


def histogram(df: DataFrame, column: str, *by: str) -> DataFrame:
    """Rows per value; null is 'unknown'."""
    return df.groupBy(*by, F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def quality_gate(records: DataFrame, *by: str, max_rate: float = 0.5, zero_unresolved: bool = False) -> DataFrame:
    """Rates of runtime and unresolved parse errors among eligible records, and whether the gate passes.

    The rate gate is strict: a rate equal to ``max_rate`` fails. A group without eligible records passes.
    """
    ok = F.coalesce(~F.col("inference_status").isin(*NOT_ELIGIBLE), F.lit(True))
    runtime = ok & F.coalesce(F.col("inference_status").isin("error", "runtime_error"), F.lit(False))
    parse = ok & F.coalesce((F.col("inference_status") == "ok") & (F.col("status") == "parse_error"), F.lit(False))
    g = records.groupBy(*by).agg(F.count_if(ok).alias("eligible"), F.count_if(runtime).alias("runtime_errors"), F.count_if(parse).alias("unresolved"))
    rate = lambda c: F.coalesce(F.try_divide(c.cast("double"), F.col("eligible")), F.lit(0.0))
    bad = F.col("runtime_errors") + F.col("unresolved")
    systemic = (F.col("eligible") == 0) | (rate(F.col("runtime_errors")) < max_rate)
    return g.select(
        *by, "eligible", "runtime_errors", "unresolved", rate(F.col("runtime_errors")).alias("runtime_rate"), rate(F.col("unresolved")).alias("parse_rate"), rate(bad).alias("unresolved_rate"),
        systemic.alias("rate_gate"), (bad == 0).alias("zero_gate"), (bad == 0 if zero_unresolved else systemic).alias("passed"),
    )


def stage_table(scores: DataFrame) -> DataFrame:
    """One row per stage, one column per modality: judge averages, zero-filled."""
    avg = judge_average(scores, "stage", "modality").select("stage", "modality", "average")
    wide = avg.groupBy("stage").pivot("modality", ["text", "image", "speech", "joint"]).agg(F.first("average"))
    return wide.select("stage", *[F.col(m).alias(f"judge_{m}") for m in ("text", "image", "speech", "joint")])


def with_aux(stages: DataFrame, aux: dict[str, float | None], stage: int = 1) -> DataFrame:
    """Metrics that only one stage has, null for the others."""
    return stages.withColumns({n: F.when(F.col("stage") == stage, F.lit(v).cast("double")) for n, v in aux.items()})


def formatted(value: Column | str, digits: int = 6) -> Column:
    """A number with fixed decimals, '' for null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.when(v.isNotNull(), F.format_string(f"%.{digits}f", v.cast("double"))).otherwise("")


def attempts(df: DataFrame, *key: str, ok: Column) -> DataFrame:
    """ok and error counts, share solved at the first try, mean and largest number of attempts."""
    per = df.groupBy(*key).agg(F.count("*").alias("attempts"), F.bool_or(ok).alias("ok"))
    return per.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("errors"), F.count_if(F.col("ok") & (F.col("attempts") == 1)).alias("first_try"), F.avg("attempts").alias("mean_attempts"), F.max("attempts").alias("max_attempts"))
