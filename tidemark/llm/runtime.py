"""What all operators of this subpackage share: shipped code, durable tables, sizes."""

from __future__ import annotations

import gc
import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidemark.session import scratch, ship

__all__ = ["BROADCAST_BYTES", "BROADCAST_ROWS", "Durable", "fresh", "map_batches", "seen", "ship", "shuffle_partitions", "sizes", "small"]

#: Rows, and bytes, that may be broadcast; larger tables are shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 1_000_000


#: Seconds beyond which a write is taken to have shuffled much; writes after which broadcast tables are let go.
LONG_S, MANY = 1.0, 2


class Durable:
    """Tables written as Parquet in the shared folder, so that a lost executor costs no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = scratch(spark, name)
        self.count = 0

    def write(self, df: DataFrame, name: str, **measures: Column) -> DataFrame:
        """The table, written and to be read; ``measures`` (aggregates) are taken while it is written, see ``seen``."""
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        found = Observation() if measures else None
        began = time.monotonic()
        rows = df.observe(found, *(c.alias(k) for k, c in measures.items())) if measures else df
        rows.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path, out._tidemark_seen = path, found.get if measures else {}
        if time.monotonic() - began > LONG_S or self.count % MANY == 0:
            # What the shuffles behind a written table left on disk, and what was broadcast, goes once nothing refers to it.
            del df, rows
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
        return out

    def small(self, df: DataFrame, name: str, rows: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
        """As ``small`` of the written table, counted while it is written."""
        return small(self.write(df, name, **sizes(df, lists)), rows, lists)

    def drop(self, df: DataFrame) -> None:
        """Remove a table that nothing reads any more."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._tidemark_path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sizes(df: DataFrame, lists: str | None = None) -> dict[str, Column]:
    """Rows and bytes as aggregates, strings by their length; elements of a column of ``lists`` count as rows."""
    n = F.lit(1) if lists is None else F.size(lists) + 1
    bytes_of = [F.coalesce(F.octet_length(f.name), F.lit(0)) if f.dataType.typeName() in ("string", "binary") else F.lit(8) for f in df.schema.fields if f.name != lists]
    return {"n": F.coalesce(F.sum(n), F.lit(0)), "bytes": F.coalesce(F.sum(sum(bytes_of, 16 * n)), F.lit(0))}


def seen(df: DataFrame) -> dict[str, object]:
    """What was measured of a table while it was written."""
    return getattr(df, "_tidemark_seen", {})


def small(df: DataFrame, rows: int = BROADCAST_ROWS, lists: str | None = None) -> DataFrame:
    """The same table, to be broadcast if it was measured (now, where it was not when it was written) and is small; else joined by shuffle."""
    found = seen(df)
    if "bytes" not in found:
        found = df.agg(*(c.alias(k) for k, c in sizes(df, lists).items())).first()
    return F.broadcast(df) if found["n"] <= rows and found["bytes"] <= BROADCAST_BYTES else df.hint("merge")


def fresh(name: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_batches(df: DataFrame, function, schema: StructType) -> DataFrame:
    """As mapInArrow, for columns of any names (mapInArrow takes a dot for a field of a struct)."""
    names, given = df.columns, [f"c{i}" for i in range(len(df.columns))]
    made = [f"c{i}" for i in range(len(schema.fields))]

    def batches(parts):
        import pyarrow as pa

        for out in function(pa.RecordBatch.from_arrays(p.columns, names) for p in parts):
            yield pa.RecordBatch.from_arrays(out.columns, made)

    plain = StructType([StructField(c, f.dataType, True) for c, f in zip(made, schema.fields, strict=True)])
    return df.toDF(*given).mapInArrow(batches, plain).toDF(*schema.names)
