"""Streaming counterparts of batch-by-batch processing: bounded triggers, restart from a checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery


def file_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 1, **options: str) -> DataFrame:
    """New files of a folder, at most so many per trigger."""
    return spark.readStream.format(fmt).schema(schema).options(**options).option("maxFilesPerTrigger", files_per_trigger).load(path)


def run_to_parquet(stream: DataFrame, path: str, checkpoint: str, pause: str | None = None) -> StreamingQuery:
    """Appends to Parquet; without a pause it ends when all present files are done, and goes on from there when run again."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(processingTime=pause) if pause else writer.trigger(availableNow=True)).start()


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Calls `each` with every micro-batch and its number; a batch is repeated after a failure, so it should be idempotent."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_per_key_stream(stream: DataFrame, key: str, time: str, delay: str = "10 minutes", span: str = "1 day") -> DataFrame:
    """window_start, key and the latest row of the key in each window of `span`.

    A window's state is dropped once the watermark, `delay` behind the latest
    event, has passed it; a state by key alone would be kept for ever.
    """
    rest = [c for c in stream.columns if c != key]
    latest = F.max_by(F.struct(*rest), F.col(time)).alias("_latest")
    found = stream.withWatermark(time, delay).groupBy(F.window(time, span).alias("_window"), key).agg(latest)
    return found.select(F.col("_window.start").alias("window_start"), key, "_latest.*")
