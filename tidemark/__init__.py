"""Incremental analytics on Spark: new input as ordered batches, schema rules, change merges, state and tables."""

from tidemark.catalog import Catalog, DatasetSpec, LocalCatalog
from tidemark.errors import (
    ChangeDataFeedError,
    CommitError,
    MissingOptionError,
    PipelineError,
    PlanningError,
    ReaderError,
    SchemaEvolutionError,
    TidemarkError,
    TransformError,
    UnsupportedFormatError,
    WriterError,
)
from tidemark.maintenance import (
    CheckpointInfo,
    CleanupResult,
    TruncateResult,
    cleanup_checkpoint,
    cleanup_snapshot_cache,
    inspect_checkpoint,
    optimize_delta_table,
    reset_checkpoint_schema,
    reset_checkpoint_start_offset,
    truncate_checkpoint,
    vacuum_delta_table,
)
from tidemark.operators.cdc import apply_cdc
from tidemark.operators.incremental import IncrementalAggregate, LatestByKey, Measure, SeenKeys, TumblingWindow, WatermarkGate
from tidemark.operators.schema import SchemaEvolution, SchemaPolicy
from tidemark.plans.files import FileStreamCheckpoint
from tidemark.plans.log import BatchInfo, DeltaBatch, DeltaFileEntry, DeltaOffset
from tidemark.plans.table import DeltaTableCheckpoint
from tidemark.sinks import apply_cdc_delta, write_delta, write_parquet_batch
from tidemark.sources import AutoSource, DeltaSource, FilesSource, Source, SourceConfig, SourceSpec, read_cdf_batch, read_files
from tidemark.streaming import JobState, LoggingObserver, Pipeline, PipelineObserver, RunResult
from tidemark.table import DeltaTable

__version__ = "0.1.0"

__all__ = [name for name in dir() if not name.startswith("_") and name not in ("catalog", "errors", "fs", "functions", "maintenance", "operators", "plans", "sinks", "sources", "streaming", "table")] + ["__version__"]
