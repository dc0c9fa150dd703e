"""Streams as micro-batches: count-based buffers, running totals and keyed counters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rootflow.operators.external import UNKNOWN_STREAM_BATCH


def read_stream(spark: SparkSession, directory: str, schema, glob: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(directory)


def rate_stream(spark: SparkSession, rows_per_batch: int = UNKNOWN_STREAM_BATCH) -> DataFrame:
    """A generated stream that brings as many rows each batch."""
    return spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).load()


def for_each_buffer(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Hands each micro-batch to a function; the checkpoint makes a restart go on after the last finished batch."""
    w = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def running_totals(stream: DataFrame, value: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Rows and sum so far, for output mode complete or update."""
    return stream.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"), F.sum(F.col(value).cast("decimal(18,2)")).alias("revenue"))


def visitor_counts(stream: DataFrame, key: str) -> DataFrame:
    return stream.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def windowed_counts(stream: DataFrame, time: str, window: str, late: str, *keys: str) -> DataFrame:
    """Counts per time window with a watermark; timestamps without a zone are taken as the session's."""
    t = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return t.groupBy(F.window(time, window), *keys).agg(F.count(F.lit(1)).alias("n"))
