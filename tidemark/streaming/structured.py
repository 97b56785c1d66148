"""The same patterns on Structured Streaming, for inputs whose arrival order does not matter.

Spark's file source keeps its own log of files, ordered by modification time, and
checkpoints its own state, so these need no batch planner.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.fs import local_path
from tidemark.streaming.state import JobState


def stream_files(spark: SparkSession, path: Any, schema: T.StructType, file_format: str = "parquet", max_files_per_trigger: int | None = None, **options: str) -> DataFrame:
    """A stream of the rows of a folder's files."""
    reader = spark.readStream.format({"ndjson": "json"}.get(file_format, file_format)).schema(schema).options(**options)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(local_path(path))


def run_available(stream: DataFrame, checkpoint_dir: Any, handler: Callable[[DataFrame, int, JobState], None]) -> None:
    """Hand each micro-batch of what is there to a handler, with the job's state as that batch sees it."""
    root = local_path(checkpoint_dir).rstrip("/")
    state = JobState(f"{root}/state")
    query = stream.writeStream.foreachBatch(lambda df, epoch: handler(df, epoch, state.at(epoch))).option("checkpointLocation", f"{root}/stream").trigger(availableNow=True).start()
    query.awaitTermination()


def write_available(stream: DataFrame, checkpoint_dir: Any, target: Any) -> None:
    """Append what is there to Parquet files, exactly once by the sink's own log."""
    query = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{local_path(checkpoint_dir).rstrip('/')}/stream").option("path", local_path(target)).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(stream: DataFrame, time_column: str, every: str, delay: str, measures: list[Column], slide: str | None = None, keys: tuple = ()) -> DataFrame:
    """Aggregates on tumbling or sliding windows, final once the watermark has passed them."""
    rows = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    window = F.window(time_column, every, slide) if slide else F.window(time_column, every)
    return rows.groupBy(window.alias("window"), *keys).agg(*measures).select(F.col("window.start").alias("window_start"), *keys, *(F.col(f"`{c}`") for c in _names(measures)))


def sessions(stream: DataFrame, time_column: str, gap: str, delay: str, measures: list[Column], keys: tuple) -> DataFrame:
    """Aggregates on sessions of a key: runs of rows with no gap as long as ``gap``."""
    rows = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    grouped = rows.groupBy(F.session_window(time_column, gap).alias("session"), *keys).agg(*measures)
    return grouped.select(F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"), *keys, *(F.col(f"`{c}`") for c in _names(measures)))


def deduplicated(stream: DataFrame, keys: list[str], time_column: str, delay: str) -> DataFrame:
    """The first row of each key; a key is remembered until the watermark passes it."""
    rows = stream.withColumn(time_column, F.col(time_column).cast("timestamp")).withWatermark(time_column, delay)
    return rows.dropDuplicatesWithinWatermark(keys)


def _names(measures: list[Column]) -> list[str]:
    return [m._jc.toString().rsplit(" AS ", 1)[-1].strip("`") for m in measures]
