"""Sinks: where a batch's rows go."""

from tidemark.sinks.parquet import write_parquet_batch
from tidemark.sinks.table import apply_cdc_delta, write_delta

__all__ = ["apply_cdc_delta", "write_delta", "write_parquet_batch"]
