"""Incremental runs by Structured Streaming: everything that is there, once, with a checkpoint to go on from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.versioned import VersionedTable


def stream_files(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    """A stream of a folder's files, oldest first; a bound of files a batch keeps memory and latency in check."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.format(fmt).load(path)


def windowed(events: DataFrame, ts: str, seconds: int, late: str, group: list[str], **aggs: str) -> DataFrame:
    """Aggregates over tumbling windows of event time. Rows later than the watermark are dropped; the batch counterpart
    keeps them, so feed rows in about the order of time."""
    at = F.window(F.col(ts), f"{seconds} seconds")
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    return rows.groupBy(at.alias("w"), *group).agg(*[F.expr(v).alias(k) for k, v in aggs.items()]).select(F.col("w.start").alias("window_start"), *group, *aggs)


def once_by(messages: DataFrame, key: list[str], ts: str | None = None, late: str | None = None) -> DataFrame:
    """Each message once, though it is delivered more often. With a watermark the state that is kept is bounded."""
    if ts is None:
        return messages.dropDuplicates(key)
    rows = messages.withColumn(ts, F.col(ts).cast("timestamp"))
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(key) if rows.isStreaming else rows.dropDuplicates(key)


def run_available(df: DataFrame, checkpoint: str, path: str | None = None, fmt: str = "parquet", each: Callable[[DataFrame, int], None] | None = None, mode: str = "append") -> dict:
    """Processes what is there, then stops; a later call with the same checkpoint goes on from there. Files are written
    exactly once; a function of batch and number must write the same for the same number."""
    writer = df.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode(mode)
    query = writer.foreachBatch(each).start() if each else writer.format(fmt).start(path)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    done = [p for p in query.recentProgress if p["numInputRows"]]
    return {"batches": len(done), "rows": sum(p["numInputRows"] for p in done)}


def replace_batch(path: str) -> Callable[[DataFrame, int], None]:
    """A batch writer that is idempotent: a batch's folder is named by its number and replaced if it comes again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def commit_batches(path: str, stream: str) -> Callable[[DataFrame, int], None]:
    """A batch writer in two phases: a batch's files, then the manifest of a version that tells the batch. Whenever the
    writer fails or comes again, readers see each batch of a stream once."""

    def write(batch: DataFrame, number: int) -> None:
        VersionedTable(batch.sparkSession, path).write(batch, batch=(stream, number))

    return write
