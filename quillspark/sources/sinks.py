"""Writers: manifests, tables as CSV and Markdown, appended error logs, first writer wins, quarantine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators.cache import additions
from quillspark.operators.scores import formatted
from quillspark.sources.readers import exists


def confined(path: str, root: str) -> str:
    """The path, if it lies below root."""
    import posixpath

    p, r = posixpath.normpath(path), posixpath.normpath(root)
    if p != r and not p.startswith(r + "/"):
        raise ValueError(f"{path} lies outside {root}")
    return path


def json_document(df: DataFrame, path: str, root: str) -> None:
    """A one-row result as one JSON line below root; more rows are an error."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document has one row")
    df.limit(1).coalesce(1).write.mode("overwrite").json(confined(path, root))


def write_manifest(records: DataFrame, path: str, version: int, dataset: dict) -> None:
    """Records as Parquet, and beside them one row of metadata with their number."""
    records.write.mode("overwrite").parquet(f"{path}/records")
    n = records.sparkSession.read.parquet(f"{path}/records").count()
    meta = records.sparkSession.createDataFrame([(version, n, sorted(dataset.items()))], "schema_version int, record_count bigint, dataset array<struct<key:string,value:string>>")
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_manifest(spark, path: str, version: int) -> DataFrame:
    """What write_manifest wrote, its version and number checked."""
    meta = spark.read.json(f"{path}/meta").first()
    if meta.schema_version != version:
        raise ValueError(f"schema version is {meta.schema_version}, not {version}")
    d = spark.read.parquet(f"{path}/records")
    if d.count() != meta.record_count:
        raise ValueError("records are missing")
    return d


def csv_table(df: DataFrame, header: list[str], text: list[str], path: str, digits: int = 6) -> None:
    """A CSV with a fixed header; numbers with fixed decimals, '' for null. Small results, one file."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in text else formatted(c, digits).alias(c) for c in header]
    df.select(*cols).coalesce(1).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def markdown_table(df: DataFrame, header: list[str], text: list[str], digits: int = 3, most: int = 1000) -> str:
    """A Markdown table of a small result; more than ``most`` rows is an error."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")) if c in text else formatted(c, digits) for c in header]
    rows = df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cols), F.lit(" |")).alias("line")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no table to read")
    return "\n".join(["| " + " | ".join(header) + " |", "| " + " | ".join("---" for _ in header) + " |", *(r.line for r in rows)]) + "\n"


def append_errors(errors: DataFrame, path: str) -> None:
    """One JSON line for each modality that an error touches, behind those that are there."""
    all_ = F.array(F.lit("text"), F.lit("image"), F.lit("speech"))
    errors.withColumn("modality", F.explode(F.coalesce(F.nullif("modalities", F.array().cast("array<string>")), all_))).drop("modalities").write.mode("append").partitionBy("modality").json(path)


def publish(new: DataFrame, path: str, key: str, tie: str) -> int:
    """Add rows whose key is not there yet; the first writer wins. Returns how many were added."""
    from quillspark.session import table

    spark = new.sparkSession
    stored = spark.read.parquet(path) if exists(spark, path) else spark.createDataFrame([], new.schema)
    add = table(additions(new, stored, key, tie).select(*new.columns), "publish")
    add.write.mode("append").parquet(path)
    return add.count()


def split_partial(df: DataFrame, parts: list[str]) -> tuple[DataFrame, DataFrame]:
    """(complete or untouched rows, rows with some of the parts but not all)."""
    have = sum(F.col(p).isNotNull().cast("int") for p in parts)
    some = (have > 0) & (have < len(parts))
    return df.where(~some), df.where(some)


def preview(df: DataFrame, by: str, order: str, most: int) -> DataFrame:
    """The first rows of each source, with how many it has."""
    from pyspark.sql import Window

    from quillspark.functions.skew import lookup_join

    n = df.groupBy(by).agg(F.count("*").alias("total"))
    w = Window.partitionBy(by).orderBy(order)
    # each task keeps ``most`` rows of a source before they are shuffled
    return lookup_join(df.withColumn("row", F.row_number().over(w)).where(F.col("row") <= most), n, by, F.col(order))
