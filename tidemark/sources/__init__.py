"""Sources: what a stream reads, and how its batches become DataFrames."""

from tidemark.sources.base import AutoSource, DeltaSource, FilesSource, Source, SourceConfig, SourceSpec
from tidemark.sources.readers import read_cdf_batch, read_files

__all__ = ["AutoSource", "DeltaSource", "FilesSource", "Source", "SourceConfig", "SourceSpec", "read_cdf_batch", "read_files"]
