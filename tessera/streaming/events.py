"""Streams of events: hourly windows, change-only progress and the ring buffer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream(df_like: DataFrame, folder: str, files_per_trigger: int = 4) -> DataFrame:
    """The Parquet files of a folder as a stream, with the schema of a batch read of it. So many files at most in a batch."""
    return df_like.sparkSession.readStream.schema(df_like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def tumbling(events: DataFrame, length: str, late: str) -> DataFrame:
    """(begin, n, mean) of each window; events later than ``late`` behind the newest are dropped."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    counted = timed.withWatermark("at", late).groupBy(F.window("at", length)).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("mean"))
    return counted.select(F.col("window.start").alias("begin"), "n", "mean")


def progress(events: DataFrame, key: str) -> DataFrame:
    """(key, done): run in update mode, a row whenever the count of a key's events has changed in a batch."""
    return events.groupBy(key).agg(F.count("*").alias("done"))


def run_to_end(streamed: DataFrame, folder: str, mode: str) -> DataFrame:
    """All that is there goes through, batch by batch, into Parquet files in a new ``folder``.

    A batch that is run again after a failure replaces its own files, so each row is there once.
    """

    done = []

    def store(rows: DataFrame, batch: int) -> None:
        done.append(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/rows/of={batch}")

    query = streamed.writeStream.foreachBatch(store).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return streamed.sparkSession.read.schema(streamed.schema).parquet(f"{folder}/rows/*") if done else streamed.sparkSession.createDataFrame([], streamed.schema)


def since(events: DataFrame, clients: DataFrame, key: str, seq: str, buffer: int) -> DataFrame:
    """What each client (key, last) missed of its key's events, and ``kind``.

    Of each key the ``buffer`` newest events are held. Without a last number, or with one that is none, a client
    gets all that is held; else what comes after it. If events right after it are held no more, a row of kind
    ``state`` with its last number goes before.
    """
    from ..operators.windows import first_per_group

    held = first_per_group(events, [key], [F.desc(seq)], buffer)
    last = F.col("last").try_cast("long")
    rows = held.join(clients, key).filter(last.isNull() | (F.col(seq) > last)).drop("last").withColumn("kind", F.lit("event"))
    oldest = held.groupBy(key).agg(F.min(seq).alias("_oldest"))
    pruned = clients.join(oldest, key).filter(last < F.col("_oldest") - 1).select(key, last.alias(seq), F.lit("state").alias("kind"))
    return rows.unionByName(pruned, allowMissingColumns=True)


def until_terminal(jobs: DataFrame, job: str, order: list[str], status: str, terminal: tuple[str, ...]) -> DataFrame:
    """The states of each job up to the first terminal one."""
    ends = jobs.filter(F.col(status).isin(*terminal)).groupBy(job).agg(F.min(F.struct(*order)).alias("_end"))
    return jobs.join(ends, job, "left").filter(F.col("_end").isNull() | (F.struct(*order) <= F.col("_end"))).drop("_end")
