"""Avro container files.

With Spark's Avro module on the class path that is used.  Without it each file is
one task that decodes it in Python: null and deflate codecs, all Avro types, and
the logical types that Spark has.
"""

from __future__ import annotations

import io
import json
import struct
import zlib
from collections.abc import Callable, Iterator
from datetime import date, datetime, timedelta, timezone
from decimal import Decimal
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import UnsupportedFormatError
from tidemark.fs import escape_glob
from tidemark.session import ship

_PRIMITIVES = {"null": T.NullType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "long": T.LongType(), "float": T.FloatType(), "double": T.DoubleType(), "bytes": T.BinaryType(), "string": T.StringType()}


class _Reader:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise ValueError("the Avro file ends early")
        self.at += n
        return out

    def long(self) -> int:
        out = shift = 0
        while True:
            b = self.data[self.at]
            self.at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return (out >> 1) ^ -(out & 1)
            shift += 7

    def bytes(self) -> bytes:
        return self.take(self.long())


def _blocks(r: _Reader) -> Iterator[None]:
    while n := r.long():
        if n < 0:
            n = -n
            r.long()
        for _ in range(n):
            yield


def decoder(schema: Any, named: dict[str, Any]) -> Callable[[_Reader], Any]:
    """A function that reads one value of a schema."""
    if isinstance(schema, str) and schema in named:
        return lambda r: named[schema](r)
    if isinstance(schema, list):
        options = [decoder(s, named) for s in schema]
        return lambda r: options[r.long()](r)
    if isinstance(schema, str):
        return {
            "null": lambda r: None, "boolean": lambda r: r.take(1) == b"\1", "int": _Reader.long, "long": _Reader.long, "float": lambda r: struct.unpack("<f", r.take(4))[0],
            "double": lambda r: struct.unpack("<d", r.take(8))[0], "bytes": _Reader.bytes, "string": lambda r: r.bytes().decode(),
        }[schema]
    kind, logical = schema["type"], schema.get("logicalType")
    if kind == "record":
        fields: list[tuple[str, Callable]] = []
        read = lambda r: {n: d(r) for n, d in fields}
        named[schema["name"]] = read
        fields += [(f["name"], decoder(f["type"], named)) for f in schema["fields"]]
        return read
    if kind == "enum":
        symbols = schema["symbols"]
        named[schema["name"]] = lambda r: symbols[r.long()]
        return named[schema["name"]]
    if kind == "fixed":
        size, scale = schema["size"], schema.get("scale", 0)
        named[schema["name"]] = (lambda r: Decimal(int.from_bytes(r.take(size), "big", signed=True)).scaleb(-scale)) if logical == "decimal" else lambda r: r.take(size)
        return named[schema["name"]]
    if kind == "array":
        item = decoder(schema["items"], named)
        return lambda r: [item(r) for _ in _blocks(r)]
    if kind == "map":
        value = decoder(schema["values"], named)
        return lambda r: {r.bytes().decode(): value(r) for _ in _blocks(r)}
    base = decoder(kind, named)
    if logical == "date":
        return lambda r: date(1970, 1, 1) + timedelta(days=base(r))
    if logical in ("timestamp-millis", "timestamp-micros"):
        unit = 1000 if logical.endswith("millis") else 1
        return lambda r: datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=base(r) * unit)
    if logical in ("local-timestamp-millis", "local-timestamp-micros"):
        unit = 1000 if logical.endswith("millis") else 1
        return lambda r: datetime(1970, 1, 1) + timedelta(microseconds=base(r) * unit)
    if logical == "decimal":
        scale = schema.get("scale", 0)
        return lambda r: Decimal(int.from_bytes(base(r), "big", signed=True)).scaleb(-scale)
    return base


def spark_type(schema: Any, named: dict[str, T.DataType]) -> T.DataType:
    if isinstance(schema, str):
        return named.get(schema) or _PRIMITIVES[schema]
    if isinstance(schema, list):
        kinds = [spark_type(s, named) for s in schema if s != "null"]
        if len(kinds) != 1:
            raise UnsupportedFormatError("unions of several types are not supported without Spark's Avro module")
        return kinds[0]
    kind, logical = schema["type"], schema.get("logicalType")
    if logical == "decimal":
        return T.DecimalType(schema["precision"], schema.get("scale", 0))
    if kind == "record":
        out = T.StructType([T.StructField(f["name"], spark_type(f["type"], named)) for f in schema["fields"]])
    elif kind in ("enum", "fixed"):
        out = T.StringType() if kind == "enum" else T.BinaryType()
    elif kind == "array":
        return T.ArrayType(spark_type(schema["items"], named))
    elif kind == "map":
        return T.MapType(T.StringType(), spark_type(schema["values"], named))
    elif logical == "date":
        return T.DateType()
    elif logical in ("timestamp-millis", "timestamp-micros"):
        return T.TimestampType()
    elif logical in ("local-timestamp-millis", "local-timestamp-micros"):
        return T.TimestampNTZType()
    else:
        return spark_type(kind, named)
    named[schema["name"]] = out
    return out


def _header(r: _Reader) -> tuple[dict[str, bytes], bytes]:
    if r.take(4) != b"Obj\x01":
        raise ValueError("not an Avro container file")
    meta = {r.bytes().decode(): r.bytes() for _ in _blocks(r)}
    return meta, r.take(16)


def rows(data: bytes) -> Iterator[list[dict]]:
    """The records of a container file, block by block."""
    r = _Reader(data)
    meta, sync = _header(r)
    codec = meta.get("avro.codec", b"null").decode()
    if codec not in ("null", "deflate"):
        raise UnsupportedFormatError(f"Avro codec {codec!r} is not supported without Spark's Avro module")
    read = decoder(json.loads(meta["avro.schema"]), {})
    while r.at < len(data):
        n, block = r.long(), r.bytes()
        inner = _Reader(zlib.decompress(block, -15) if codec == "deflate" else block)
        yield [read(inner) for _ in range(n)]
        if r.take(16) != sync:
            raise ValueError("the Avro file is damaged")


def read_avro(spark: SparkSession, files: list[str]) -> DataFrame:
    paths = [escape_glob(f) for f in files]
    try:
        spark.sparkContext._jvm.java.lang.Class.forName("org.apache.spark.sql.avro.AvroFileFormat")
        return spark.read.format("avro").load(paths)
    except Exception:  # the module is not there
        pass
    ship(spark)
    head = spark.read.format("binaryFile").load(paths[0]).selectExpr("substring(content, 1, 1048576) AS head").first().head
    schema = spark_type(json.loads(_header(_Reader(bytes(head)))[0]["avro.schema"]), {})
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField("value", schema)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, record = to_arrow_schema(schema), schema.names != ["value"]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                for block in rows(io.BytesIO(content.as_py()).getvalue()):
                    records = block if record else [b if isinstance(b, dict) else {"value": b} for b in block]
                    yield pa.RecordBatch.from_pylist(records, schema=arrow)

    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(batches, schema)
