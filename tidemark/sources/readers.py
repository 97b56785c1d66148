"""Files to DataFrames.

Every reader yields plain Spark scans, so projections and filters reach the files.
``with_order=True`` adds ``__file`` (position in the list) and ``__row`` (order inside
the file) for operators that need the order of arrival.
"""

from __future__ import annotations

from collections import defaultdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import UnsupportedFormatError
from tidemark.fs import escape_glob, is_local, local_path
from tidemark.operators.union import relaxed_union, vertical
from tidemark.session import ship

FILE, ROW = "__file", "__row"
FORMATS = {"xlsx": "excel", "xls": "excel", "jsonl": "ndjson", "parq": "parquet"}
DEFAULT_GLOBS = {"parquet": "*.parquet", "csv": "*.csv", "excel": "*.xlsx", "json": "*.json", "ndjson": "*.ndjson", "avro": "*.avro"}


def session(spark: SparkSession | None = None) -> SparkSession:
    return spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def format_of(name: Any) -> str | None:
    """A canonical format name, or None."""
    text = str(name).lower().lstrip(".") if name is not None else ""
    text = FORMATS.get(text, text)
    return text if text in DEFAULT_GLOBS else None


def _ordered(df: DataFrame, files: list[str], exact_rows: bool) -> DataFrame:
    place = F.create_map(*(x for i, f in enumerate(files) for x in (F.lit(local_path(f)), F.lit(i))))
    name = F.regexp_replace(F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))"), r"^file:(//)?(?=/)", "")
    row = F.col("_metadata.row_index") if exact_rows else F.monotonically_increasing_id()
    return df.withColumns({FILE: place[name], ROW: row})


def read_files(files: list[str], file_format: str = "parquet", *, spark: SparkSession | None = None, schema: T.StructType | None = None, with_order: bool = False, options: dict[str, Any] | None = None, relaxed: bool = False) -> DataFrame:
    """The rows of some files.

    ``schema`` saves inference; it is also what an empty list reads as.  Files of
    unlike Parquet schemas are read group by group and must have the same columns;
    with ``relaxed`` they are united to common columns and wider types.
    """
    spark, kind = session(spark), format_of(file_format)
    if kind is None:
        raise UnsupportedFormatError(f"unsupported file format: {file_format!r}")
    if not files:
        return spark.createDataFrame([], schema or T.StructType([]))
    paths = [escape_glob(f) for f in files]
    reader = spark.read.options(**{k: str(v) for k, v in (options or {}).items()})
    if schema is not None and kind != "excel":
        reader = reader.schema(schema)
    if kind == "parquet":
        out = reader.parquet(*paths) if schema is not None else _parquet(spark, files, with_order, relaxed, options or {})
        if schema is None:
            return out
    elif kind == "csv":
        out = (reader if schema is not None else reader.option("inferSchema", True)).option("header", (options or {}).get("header", True)).csv(paths)
    elif kind == "json":
        if paths == files or with_order:
            out = reader.option("multiLine", True).json(paths)
        else:  # Spark infers the schema of documents by a listing that takes escaped names for others
            out = reader.json(spark.read.text(paths, wholetext=True).rdd.map(lambda r: r.value))
    elif kind == "ndjson":
        out = reader.json(paths)
    elif kind == "avro":
        from tidemark.sources.avro import read_avro

        return read_avro(spark, files)
    else:
        from tidemark.sources.excel import read_excel

        return read_excel(spark, files, schema)
    return _ordered(out, files, kind == "parquet") if with_order else out


def _parquet(spark: SparkSession, files: list[str], with_order: bool, relaxed: bool, options: dict[str, Any]) -> DataFrame:
    groups = _by_schema(spark, files)
    frames = []
    for group in groups:
        df = spark.read.options(**{k: str(v) for k, v in options.items()}).parquet(*map(escape_glob, group))
        frames.append(_ordered(df, files, True) if with_order else df)
    return frames[0] if len(frames) == 1 else relaxed_union(frames) if relaxed else vertical(frames)


#: Footers that the driver reads itself; more are read by tasks.
FOOTERS = 64


def footer_schema(path: str) -> str:
    """The columns and types in a local Parquet file's footer, or in that of a folder's first file."""
    import os

    import pyarrow.parquet as pq

    if os.path.isdir(path):
        parts = sorted(p for p in os.listdir(path) if p.endswith(".parquet"))
        if not parts:
            return ""
        path = os.path.join(path, parts[0])
    return str(pq.read_schema(path).remove_metadata())


def _remote_schemas(spark: SparkSession, files: list[str]) -> list[str]:
    """The same of files that only Spark can open: its own inference, asked file by file, reads a footer and no rows."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(16) as pool:
        return list(pool.map(lambda f: spark.read.parquet(escape_glob(f)).schema.json(), files))


def _by_schema(spark: SparkSession, files: list[str]) -> list[list[str]]:
    """The files grouped by the columns and types in their footers."""
    if len(files) == 1:
        return [files]
    if not all(is_local(f) for f in files):
        found = _remote_schemas(spark, files)
    elif len(files) <= FOOTERS:
        found = list(map(footer_schema, files))
    else:
        ship(spark)

        def footers(parts):
            import pyarrow as pa

            for part in parts:
                paths = part.column("path").to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(map(footer_schema, paths), pa.string())], ["path", "schema"])

        listed = spark.createDataFrame([(f,) for f in files], "path string").repartition(max(1, min(len(files) // 16, 10_000)))
        by_path = {r.path: r.schema for r in listed.mapInArrow(footers, "path string, schema string").collect()}
        found = [by_path[f] for f in files]
    groups: dict[str, list[str]] = defaultdict(list)
    for path, schema in zip(files, found, strict=True):
        groups[schema].append(path)
    return list(groups.values())


def read_entries(spark: SparkSession, entries: list, schema: T.StructType | None = None) -> DataFrame:
    """Change rows: one scan for each version and kind, with the change columns that the files themselves lack."""
    columns = T.StructType([*(schema.fields if schema else ()), T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.LongType())])
    if not entries:
        return spark.createDataFrame([], columns)
    groups: dict[tuple, list] = defaultdict(list)
    for e in entries:
        groups[e.commit_version, e.commit_timestamp, e.change_type, tuple(sorted(e.partition.items()))].append(e.path)
    frames = []
    for (version, stamp, kind, partition), paths in groups.items():
        df = spark.read.parquet(*map(escape_glob, paths))
        kinds = {f.name: f.dataType for f in schema.fields} if schema else {}
        for name, value in partition:
            if name not in df.columns:
                df = df.withColumn(name, F.lit(value).cast(kinds.get(name, T.StringType())))
        for name, value, t in (("_change_type", kind, "string"), ("_commit_version", version, "long"), ("_commit_timestamp", stamp, "long")):
            if name not in df.columns:
                df = df.withColumn(name, F.lit(value).cast(t))
        frames.append(df)
    return frames[0] if len(frames) == 1 else vertical(frames)


def read_cdf_batch(batch: Any, spark: SparkSession | None = None) -> DataFrame:
    """The change rows of a table's batch; without entries its files as they are."""
    if batch.file_entries is None:
        return read_files(batch.files, "parquet", spark=spark)
    return read_entries(session(spark), batch.file_entries)
