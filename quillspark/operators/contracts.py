"""Checks of an index table: each gives rows that break a rule, or one row of counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: Columns of an index row that may not be blank, and those that may be empty but not null. Fixed values.
REQUIRED = ["id", "source", "book", "from_key", "to_key", "current_image", "current_text", "current_text_path", "next_image", "next_text", "next_text_path", "scene", "text_instruction", "ambient_sound", "speech_utterance", "speech_speaker", "speech_emotion", "speech_speed", "speech_pitch", "speech_gender", "sample_path", "metadata_path"]
OPTIONAL = ["genre", "topic", "style", "narrative_tense", "narrative_perspective"]
LISTS = ["condition_characters", "book_characters"]


class ContractError(ValueError):
    pass


def missing_columns(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c not in df.columns]


def blank_fields(df: DataFrame, key: str, required: list[str] = REQUIRED, optional: list[str] = OPTIONAL) -> DataFrame:
    """(key, column): required fields that are blank and optional ones that are null."""
    flags = [F.when(T.blank(c), F.lit(c)) for c in required if c in df.columns] + [F.when(F.col(c).isNull(), F.lit(c)) for c in optional if c in df.columns]
    return df.select(key, F.explode(F.array_compact(F.array(*flags))).alias("column"))


def is_object_list(c: Column | str) -> Column:
    """True for a text that is a JSON list of objects (an empty list too); strict JSON."""
    v = F.try_parse_json(T.col(c))
    each = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce((F.schema_of_variant(v).startswith("ARRAY")) & F.forall(each, lambda x: F.schema_of_variant(x).startswith("OBJECT")), F.lit(False))


def path_problem(path: Column | str) -> Column:
    """Why a path is no safe repo-relative one: 'blank', 'absolute', 'escape'; null if it is."""
    p = F.replace(T.col(path), F.lit("\\"), F.lit("/"))
    # every prefix must stay at or below the root: count names up and '..' down, part by part
    depth = F.aggregate(F.split(p, "/"), F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, x: F.struct((a["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(x == "..", -1).when(x.isin("", "."), 0).otherwise(1)).alias("low")))
    return F.when(T.blank(p), "blank").when(p.startswith("/"), "absolute").when(depth["low"] < 0, "escape")


def id_mismatch(df: DataFrame) -> DataFrame:
    """Rows whose id is not source/book/from__to."""
    want = F.concat(F.col("source"), F.lit("/"), F.col("book"), F.lit("/"), F.col("from_key"), F.lit("__"), F.col("to_key"))
    return df.where(~F.col("id").eqNullSafe(want))


def counts(df: DataFrame, key: str) -> DataFrame:
    """One row: rows, different keys, null keys."""
    return df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("null_keys"))


def histogram_gap(df: DataFrame, column: str, expected: dict[str, int]) -> DataFrame:
    """(column, n, expected): values whose number differs from what is expected, either way."""
    have = df.groupBy(column).agg(F.count("*").alias("n"))
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{column} string, expected bigint")
    return have.join(want, column, "full_outer").select(column, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected")).where("n <> expected")


def sentinels(df: DataFrame, ordinal: str, key: str, expected: dict[int, str]) -> DataFrame:
    """(ordinal, expected, key): stated places that do not hold the stated key; the statement is the caller's dictionary, so it is small."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{ordinal} bigint, expected string")
    return F.broadcast(want).join(df.select(ordinal, key), ordinal, "left").where(~F.col("expected").eqNullSafe(F.col(key)))


def ordinals(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """0-based places in a total order without one task holding all rows: counts per range first, then offsets."""
    from pyspark.sql import Window

    d = df.withColumn("_part", F.spark_partition_id()) if not order else df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id())
    from quillspark.session import table

    d = table(d, "ordinals")
    sizes = d.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    w = Window.partitionBy("_part").orderBy(*order)
    return d.join(F.broadcast(before.select("_part", "_before")), "_part").withColumn(name, F.coalesce("_before", F.lit(0)) + F.row_number().over(w) - 1).drop("_part", "_before")


def between(df: DataFrame, ordinal: str, start: int, end: int | None, limit: int = 0, total: int | None = None) -> DataFrame:
    """Rows with start <= ordinal < end, the end clamped to the total, the first ``limit`` of them if positive."""
    start = max(start, 0)
    if end is not None and total is not None:
        end = min(end, total)
    if end is not None and start >= end:
        raise ContractError(f"no rows in [{start}, {end})")
    if limit > 0:
        end = start + limit if end is None else min(end, start + limit)
    d = df.where(F.col(ordinal) >= start)
    return d if end is None else d.where(F.col(ordinal) < end)


def inclusive(df: DataFrame, ordinal: str, start: int, end: int, limit: int = 0) -> DataFrame:
    """Rows with start <= ordinal <= end."""
    return between(df, ordinal, start, end + 1, limit)


def dropped_empty(lists: Column, field: str) -> Column:
    """Objects (as maps) without ``field`` where it is empty."""
    return F.transform(lists, lambda m: F.map_filter(m, lambda k, v: ~((k == field) & (v == ""))))


def repair_problems(df: DataFrame, key: str, lists: str, field: str) -> DataFrame:
    """(key, repaired, empty): ``lists`` (array of maps) without ``field`` where it is empty, and how many objects that were.

    Null lists have null and 0.
    """
    empty = F.size(F.filter(F.coalesce(lists, F.array().cast("array<map<string,string>>")), lambda m: F.coalesce(F.try_element_at(m, F.lit(field)) == "", F.lit(False))))
    return df.select(key, dropped_empty(F.col(lists), field).alias("repaired"), empty.alias("empty"))


def targeted_repair(df: DataFrame, key: str, lists: str, field: str, ids: list[str]) -> DataFrame:
    """``df`` with ``lists`` repaired in the stated rows, in each of which exactly one object has ``field`` empty.

    Other rows stay as they are.  A stated row that is missing, comes twice or has another number of
    such objects is an error, so that a source that was mended or changed isn't repaired blindly.
    """
    got = repair_problems(df.where(F.col(key).isin(ids)), key, lists, field).select(key, "empty").collect()  # the stated rows only
    found = {i: [r.empty for r in got if r[0] == i] for i in ids}
    bad = {i: n for i, n in found.items() if n != [1]}
    if bad:
        raise ContractError("; ".join(f"{i}: {'no row' if not n else f'{len(n)} rows' if len(n) > 1 else f'{n[0]} objects with empty {field}'}" for i, n in sorted(bad.items())))
    return df.withColumn(lists, F.when(F.col(key).isin(ids), dropped_empty(F.col(lists), field)).otherwise(F.col(lists)))


def file_problems(df: DataFrame, key: str, columns: list[str], listing: DataFrame, root: str = "") -> DataFrame:
    """(key, column, problem): paths that are blank, absolute, leave the root, name no file of ``listing`` ('missing') or an empty one ('empty').

    ``listing`` has path (below ``root``) and length, as readers.files() gives it; it is joined once,
    salted, for all columns.  Separators and doubled ones count alike.
    """
    from quillspark.functions.skew import lookup_join

    clean = lambda c: F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"/{2,}", "/"), r"^\./", "")
    have = listing.select(clean(F.substring_index(F.col("path"), root.rstrip("/") + "/", -1) if root else F.col("path")).alias("_path"), "length").groupBy("_path").agg(F.max("length").alias("_length"))
    long = df.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("path")) for c in columns])).alias("_c")).select(key, "_c.column", "_c.path")
    long = long.withColumn("_why", path_problem("path")).withColumn("_path", clean(F.col("path")))
    met = lookup_join(long, have, "_path", F.col(key), how="left")
    why = F.coalesce("_why", F.when(F.col("_length").isNull(), "missing").when(F.col("_length") == 0, "empty"))
    return met.select(key, "column", why.alias("problem")).where("problem is not null")


def tree_problems(listing: DataFrame, expected: list[str], links: list[str] = ()) -> DataFrame:
    """(path, problem): files of an output tree whose name no expected pattern allows ('unexpected'), and links ('link').

    Patterns are file globs over the path below the root; a link may lead out of the root and is none of
    a result's files, so it is told apart by the caller's list of them.
    """
    from quillspark.operators.candidates import like

    ok = reduce(lambda a, b: a | b, [F.col("path").rlike(like(p)) for p in expected], F.lit(False))
    link = F.col("path").isin(list(links)) if links else F.lit(False)
    return listing.select("path", F.when(link, "link").when(~ok, "unexpected").alias("problem")).where("problem is not null")


def set_difference(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that are wanted and missing, or there and unexpected."""
    h, w = have.select(key).distinct().withColumn("_h", F.lit(True)), want.select(key).distinct().withColumn("_w", F.lit(True))
    return h.join(w, key, "full_outer").where("_h is null or _w is null").select(key, F.when(F.col("_h").isNull(), "missing").otherwise("unexpected").alias("side"))


def check(df: DataFrame, key: str = "id", rows: int | None = None) -> DataFrame:
    """One row of how many rows break each rule of an index table."""
    d = df.withColumn("_want", F.concat("source", F.lit("/"), "book", F.lit("/"), "from_key", F.lit("__"), "to_key"))
    blank = reduce(lambda a, b: a | b, [T.blank(c) for c in REQUIRED])
    paths = [c for c in df.columns if c.endswith(("_path", "_image"))]
    unsafe = reduce(lambda a, b: a | b, [path_problem(c).isNotNull() for c in paths])
    return d.agg(
        F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(~F.col("id").eqNullSafe(F.col("_want"))).alias("id_mismatch"), F.count_if(blank).alias("blank_required"),
        F.count_if(unsafe).alias("unsafe_path"), *[F.count_if(~is_object_list(c)).alias(f"bad_{c}") for c in LISTS], F.lit(rows).cast("bigint").alias("expected_rows"),
    )
