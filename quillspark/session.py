"""The Spark session for local runs, and tables that cut a long lineage."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the queries are tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where that is unset (tests, local runs) one of this machine's temporary folders is used.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), "quillspark-shared")
    return at.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_KEPT: list[list[tuple[SparkSession, str]]] = [[]]


@contextmanager
def scope(spark: SparkSession):
    """Deletes the tables written inside it when it ends: for whoever has used up the results.

    Without a scope they go when the session is stopped by close() or the application ends.
    """
    _KEPT.append([])
    try:
        yield spark
    finally:
        for s, path in _KEPT.pop():
            _quietly(s, path)


def close(spark: SparkSession) -> None:
    """Delete what table() wrote and stop the session: on shared storage nothing is left behind."""
    _release()
    spark.stop()


def _release() -> None:
    for kept in _KEPT:
        while kept:
            _quietly(*kept.pop())


def keep(spark: SparkSession, path: str) -> None:
    """Have a folder deleted when the scope ends, as the tables are that table() writes."""
    _KEPT[-1].append((spark, path))


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The written table replaces the lineage and is kept in a place that survives lost executors; see
    scope() for how long.  Writing is a job, so whoever calls this is not lazy: operators that say
    so run their first steps while their result is being built.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    keep(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the JVM may be gone already
        if path.startswith("file://"):
            import shutil

            shutil.rmtree(path[7:], ignore_errors=True)


atexit.register(_release)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
