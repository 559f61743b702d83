"""Structured Streaming: running counts of sessions, windows with watermarks, and bounded retrieval rounds.

Every stream here runs the same on files, sockets or a queue; state is keyed
and bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def read_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_counts(stream: DataFrame, key: str = "user_id") -> DataFrame:
    """Samples of each session so far; for the update or complete mode."""
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("samples"))


def with_watermark(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events by time; rows later than ``late`` behind the newest are dropped by what follows."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed(stream: DataFrame, length: str = "1 day", step: str | None = None) -> DataFrame:
    """Counts and sums of events by type and tumbling or sliding window."""
    w = F.window("ts", length, step) if step else F.window("ts", length)
    return with_watermark(stream).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessionized(stream: DataFrame, gap: str = "6 hours") -> DataFrame:
    """Events of a user that follow each other within a gap, as one session."""
    return with_watermark(stream).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(out: DataFrame, path: str, checkpoint: str) -> None:
    """Append finished windows to a table, exactly once, restartable from the checkpoint."""
    q = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_to_folder(out: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Process all that is there and give the result, of any size, from ``path``: each batch writes what its mode gives, the last complete one counts.

    In complete mode a batch replaces the one before; in append mode it adds
    to it, under its own number, so a batch that is run again writes the same
    folder.
    """
    spark = out.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{'all' if mode == 'complete' else 'part'}={0 if mode == 'complete' else number}")

    q = out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}_checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(path).select(*out.columns)


def rounds(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], done: Callable[[DataFrame], bool], most: int = 5) -> DataFrame:
    """A bounded loop of DataFrame steps on the driver, each materialised in the checkpoint folder: retrieve, append, test, stop."""
    shared_folder(state.sparkSession)
    for i in range(most):
        state = step(state, i).checkpoint()
        if done(state):
            break
    return state
