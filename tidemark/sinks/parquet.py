"""Parquet, one folder for each batch."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame

from tidemark.fs import local_path


def write_parquet_batch(df: DataFrame, target: Any, batch_id: int, collect_kwargs: dict[str, Any] | None = None) -> dict[str, str]:
    """Write ``<target>/batch_<id>.parquet``, replaced when a batch is run again.

    What Spark writes is a folder; read all batches with
    ``spark.read.parquet(f"{target}/batch_*.parquet")``.
    """
    path = f"{local_path(target).rstrip('/')}/batch_{batch_id}.parquet"
    df.write.mode("overwrite").parquet(path)
    return {"path": path}
