"""Status logs as streams: windowed counts with late rows, runs per key, files as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.session import keep


def event_stream(spark: SparkSession, path: str, schema, files_a_trigger: int | None = 8) -> DataFrame:
    """The files of a folder as they come; ``files_a_trigger`` None takes all that are there together."""
    r = spark.readStream.schema(schema)
    return (r if files_a_trigger is None else r.option("maxFilesPerTrigger", files_a_trigger)).parquet(path)


def windowed_counts(events: DataFrame, late: str = "2 hours", size: str = "3 hours", hop: str = "90 minutes") -> DataFrame:
    """Counts per sliding window and event type; rows later than ``late`` are left out.

    The same plan runs over a table: there no row is late.
    """
    d = events.withColumn("at", F.col("ts").cast("timestamp"))
    d = d.withWatermark("at", late) if d.isStreaming else d
    return d.groupBy(F.window("at", size, hop).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


RUN = "user_id bigint, event_type string, n bigint"


def runs(events: DataFrame, quiet: str | None = None) -> DataFrame:
    """(user_id, event_type, n): each run of equal event types of a user as it ends; state is one type and one number a user.

    A user's rows of one trigger are put in order together, however many Arrow batches they come in;
    rows that come in a later trigger count as later.  A run ends with the next event of another type;
    with ``quiet`` (e.g. "1 hour", of the processing clock) also when its user has been silent for so
    long, so that a user's last run comes too.
    """
    import numpy as np

    wait = None if quiet is None else int(pd.Timedelta(quiet).total_seconds() * 1000)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            kind, n = state.get
            state.remove()
            yield pd.DataFrame([(key[0], kind, n)], columns=["user_id", "event_type", "n"])
            return
        pdf = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        kinds = pdf.event_type.astype(object).where(pdf.event_type.notna(), None).to_numpy()
        at = np.flatnonzero(np.append(True, kinds[1:] != kinds[:-1]))
        types, sizes = list(kinds[at]), np.diff(np.append(at, len(kinds))).tolist()
        if state.exists:
            kind, n = state.get
            if kind == types[0]:
                sizes[0] += n
            else:
                types, sizes = [kind, *types], [n, *sizes]
        state.update((types[-1], sizes[-1]))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame({"user_id": [key[0]] * (len(types) - 1), "event_type": types[:-1], "n": sizes[:-1]})

    return events.select("user_id", "event_type", "ts", "event_id").groupBy("user_id").applyInPandasWithState(step, RUN, "event_type string, n bigint", "append", "NoTimeout" if wait is None else "ProcessingTimeTimeout")


def collected(stream: DataFrame, name: str, mode: str, checkpoint: str, most_s: int | None = None) -> DataFrame:
    """Run a stream over what is there and give its result as a table; for tests and backfills.

    It ends when all that is there has been read, or is stopped with an error after ``most_s`` seconds.
    Appended rows go to files beside the checkpoint; only a result that is replaced as a whole, one
    row per group, is held by the driver.
    """
    spark = stream.sparkSession
    w = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    rows = f"{checkpoint}-rows"
    if mode == "append":
        keep(spark, rows)
        q = w.format("parquet").option("compression", "zstd").start(rows)
    else:
        q = w.format("memory").start()
    if most_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(most_s):
        q.stop()
        raise TimeoutError(f"{name} did not end in {most_s} s")
    return spark.read.schema(stream.schema).parquet(rows) if mode == "append" else spark.table(name)


def to_table(stream: DataFrame, path: str, checkpoint: str, key: str):
    """Append each batch to a table, rows whose key is there already left out: a batch that is retried adds nothing."""
    from quillspark.sources.sinks import publish

    return stream.writeStream.foreachBatch(lambda df, _: publish(df, path, key, key) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
