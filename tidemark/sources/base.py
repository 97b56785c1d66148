"""Source configurations and the sources they make for a checkpoint folder."""

from __future__ import annotations

import logging
import os
from dataclasses import asdict, dataclass, field
from typing import Any, Protocol
from urllib.parse import quote

from pyspark.sql import DataFrame

from tidemark.errors import UnsupportedFormatError
from tidemark.fs import fs_for, local_path
from tidemark.plans.files import FileStreamCheckpoint
from tidemark.plans.log import BatchInfo, DeltaBatch
from tidemark.plans.table import DeltaTableCheckpoint
from tidemark.sources.readers import DEFAULT_GLOBS, format_of, read_cdf_batch, read_files

logger = logging.getLogger("tidemark")
CLEANING = ("off", "delete", "archive")


class Source(Protocol):
    """What a pipeline needs: plan a batch (logging its offset), read it, commit it."""

    checkpoint: Any

    def plan_batch(self) -> Any: ...

    def read_batch(self, batch: Any) -> DataFrame: ...

    def commit_batch(self, batch: Any, metadata: dict | None = None) -> None: ...


class SourceConfig(Protocol):
    def to_spec(self) -> SourceSpec: ...


@dataclass(frozen=True)
class SourceSpec:
    """A source by format name, path and options."""

    format: str
    path: Any
    options: dict[str, Any] = field(default_factory=dict)

    def with_checkpoint(self, checkpoint_dir: Any) -> Source:
        kind, options = self.format.lower(), dict(self.options)
        if kind == "auto":
            kind = infer_format(self.path, options)
        if kind == "delta":
            return TableSource(self.path, checkpoint_dir, options)
        if kind in ("files", "file"):
            kind = format_of(options.get("file_format")) if options.get("file_format") is not None else infer_format(self.path, options)
        if kind is None or format_of(kind) is None:
            raise UnsupportedFormatError(f"unsupported source format: {options.get('file_format') or self.format}")
        return FileSource(self.path, checkpoint_dir, format_of(kind), options)


def infer_format(path: Any, options: dict[str, Any]) -> str:
    """The ``file_format`` option, else the pattern's suffix, else a table log, else the path's suffix, else parquet."""
    if options.get("file_format") is not None:
        kind = "delta" if str(options["file_format"]).lower() == "delta" else format_of(options["file_format"])
        if kind is None:
            raise UnsupportedFormatError(f"unsupported file format: {options['file_format']!r}")
        return kind
    by_suffix = lambda text: next((k for part in reversed(str(text).rsplit("/", 1)[-1].split(".")[1:]) if (k := format_of(part.strip("*?[]")))), None)
    if options.get("pattern") and by_suffix(options["pattern"]):
        return by_suffix(options["pattern"])
    root = local_path(path).rstrip("/")
    if fs_for(root).is_dir(f"{root}/_delta_log"):
        return "delta"
    return by_suffix(root) or "parquet"


def _given(config: Any) -> dict[str, Any]:
    return {k: v for k, v in asdict(config).items() if k != "path" and v is not None}


@dataclass(frozen=True)
class FilesSource:
    """The files of a folder."""

    path: Any
    file_format: str | None = None
    pattern: str | None = None
    recursive: bool = False
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int | None = None
    max_file_age: float | None = None
    start_offset: str | None = None
    start_timestamp: Any = None
    allow_overwrites: bool = False
    clean_source: str | None = None
    clean_source_archive_dir: Any = None

    def to_spec(self) -> SourceSpec:
        return SourceSpec("files", self.path, _given(self))


@dataclass(frozen=True)
class DeltaSource:
    """The snapshot, log or change feed of a table."""

    path: Any
    start_offset: str | None = None
    starting_version: int | None = None
    starting_timestamp: Any = None
    max_files_per_trigger: int | None = 1000
    max_bytes_per_trigger: int | None = None
    ignore_deletes: bool = False
    ignore_changes: bool = False
    read_change_feed: bool = False

    def to_spec(self) -> SourceSpec:
        return SourceSpec("delta", self.path, _given(self))


@dataclass(frozen=True)
class AutoSource:
    """A folder or table whose format is found out."""

    path: Any
    file_format: str | None = None
    pattern: str | None = None

    def to_spec(self) -> SourceSpec:
        return SourceSpec("auto", self.path, _given(self))


class FileSource:
    def __init__(self, path: Any, checkpoint_dir: Any, file_format: str, options: dict[str, Any]):
        self.path, self.file_format, self.options = local_path(path), file_format, options
        self.cleaning = str(options.get("clean_source") or "off").lower()
        if self.cleaning not in CLEANING:
            raise ValueError(f"clean_source must be one of {', '.join(CLEANING)}: {self.cleaning!r}")
        self.checkpoint = FileStreamCheckpoint(checkpoint_dir)
        self.pattern = options.get("pattern") or DEFAULT_GLOBS[file_format]
        self.archive = local_path(options.get("clean_source_archive_dir") or f"{self.path.rstrip('/')}/_archive")

    def plan_batch(self) -> BatchInfo | None:
        o = self.options
        batch = self.checkpoint.plan_batch(
            self.path, self.pattern, recursive=bool(o.get("recursive")), max_files=o.get("max_files_per_trigger"), max_bytes=o.get("max_bytes_per_trigger"), max_file_age=o.get("max_file_age"),
            start_offset=o.get("start_offset"), start_timestamp=o.get("start_timestamp"), allow_overwrites=bool(o.get("allow_overwrites")), exclude=[self.archive] if self.cleaning == "archive" else [],
        )
        if batch is not None:
            self.checkpoint.write_offset(batch)
        return batch

    def read_batch(self, batch: BatchInfo) -> DataFrame:
        return read_files(batch.files, self.file_format)

    def commit_batch(self, batch: BatchInfo, metadata: dict | None = None) -> None:
        self.checkpoint.write_commit(batch, metadata)
        if self.cleaning != "off":
            for path in batch.files:
                try:
                    self._clean(path)
                except OSError as e:  # the file stays, and stays in the index
                    logger.warning("could not clean %s: %s", path, e)

    def _clean(self, path: str) -> None:
        fs = fs_for(path)
        if self.cleaning == "delete":
            fs.delete(path)
            return
        name = os.path.basename(path)
        stem, dot, suffix = name.partition(".")
        target, n = f"{self.archive}/{name}", 0
        while fs.exists(target):
            n += 1
            target = f"{self.archive}/{stem}_{n}{dot}{suffix}"
        fs.rename(path, target)


class TableSource:
    def __init__(self, path: Any, checkpoint_dir: Any, options: dict[str, Any]):
        self.path, self.options = local_path(path), options
        self.checkpoint = DeltaTableCheckpoint(checkpoint_dir, path)

    def plan_batch(self) -> DeltaBatch | None:
        o = self.options
        batch = self.checkpoint.plan_batch(
            max_files=o.get("max_files_per_trigger", 1000), max_bytes=o.get("max_bytes_per_trigger"), start_offset=o.get("start_offset"), starting_version=o.get("starting_version"),
            starting_timestamp=o.get("starting_timestamp"), ignore_deletes=bool(o.get("ignore_deletes")), ignore_changes=bool(o.get("ignore_changes")), read_change_feed=bool(o.get("read_change_feed")),
        )
        if batch is not None:
            self.checkpoint.write_offset(batch)
        return batch

    def read_batch(self, batch: DeltaBatch) -> DataFrame:
        if self.options.get("read_change_feed"):
            return read_cdf_batch(batch)
        from tidemark.sources.readers import session
        from tidemark.table import DeltaTable

        table = DeltaTable(session(), self.path)
        adds = [{"path": quote(e.path, safe="/=-_.~:"), "partitionValues": e.partition} for e in batch.file_entries or ()]
        snap = table.snapshot()
        return table.read_adds(adds, snap) if snap.schema is not None else read_files(batch.files, "parquet")

    def commit_batch(self, batch: DeltaBatch, metadata: dict | None = None) -> None:
        self.checkpoint.write_commit(batch, metadata)
