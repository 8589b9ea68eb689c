"""Structured Streaming: files as they land, each batch through the same functions as in batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int = 4, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(fmt).load(path)


def tumbling_counts(rows: DataFrame, ts: str, minutes: int, *keys: str, late: str | None = None) -> DataFrame:
    """Rows per window and keys, for a batch or a stream; `late` is how long a stream waits for late rows."""
    if late:
        rows = rows.withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, f"{minutes} minutes"), *keys).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "rows")


def run_available(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Work off all files that are there, batch by batch, and stop: a poll whose position survives in the checkpoint."""
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_polling(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 minutes") -> StreamingQuery:
    return stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def drained(read: Callable[[], int], most: int = 10) -> int:
    """Repeat a bounded batch until it does nothing or has run `most` times; how much was done."""
    total = 0
    for _ in range(most):
        n = read()
        if not n:
            break
        total += n
    return total


def late_rows(rows: DataFrame, ts: Column, watermark: Column) -> DataFrame:
    """Rows whose time is past the upper bound of a snapshot: a filter, not an event-time watermark."""
    return rows.where(ts > watermark)
