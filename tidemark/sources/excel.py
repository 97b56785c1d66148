"""XLSX workbooks: the first sheet of each file, its first row naming the columns.

Spark has no reader for them, so each workbook is one task: its bytes come through
the ``binaryFile`` source and its XML is parsed with the standard library.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.errors import UnsupportedFormatError
from tidemark.fs import escape_glob
from tidemark.session import ship

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
#: Number formats that show dates or times.
_DATE_FORMATS = {*range(14, 23), *range(45, 48)}
#: The most bytes of a sheet's XML; a workbook is small by nature, a bomb is not.
LIMIT = 1 << 30


def _part(book: zipfile.ZipFile, name: str) -> ElementTree.Element | None:
    if name not in book.namelist():
        return None
    if book.getinfo(name).file_size > LIMIT:
        raise ValueError(f"{name} is larger than {LIMIT} bytes")
    data = book.read(name)
    if b"<!DOCTYPE" in data[:4096] or b"<!ENTITY" in data:
        raise ValueError("workbooks with entity definitions are not read")
    return ElementTree.fromstring(data)


def _column(place: str) -> int:
    out = 0
    for c in re.match(r"[A-Z]+", place)[0]:
        out = out * 26 + ord(c) - 64
    return out - 1


def parse(data: bytes) -> tuple[list[str], list[list[Any]]]:
    """Column names and rows; numbers are int or float, dates datetime, the rest str, bool or None."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        shared = _part(book, "xl/sharedStrings.xml")
        strings = [("".join(t.text or "" for t in s.iter(f"{_MAIN}t"))) for s in (shared if shared is not None else ())]
        styles = _part(book, "xl/styles.xml")
        dated: list[bool] = []
        if styles is not None:
            own = {f.get("numFmtId"): f.get("formatCode", "") for f in styles.iter(f"{_MAIN}numFmt")}
            for xf in styles.find(f"{_MAIN}cellXfs") if styles.find(f"{_MAIN}cellXfs") is not None else ():
                number = xf.get("numFmtId", "0")
                code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", own.get(number, ""))
                dated.append(int(number) in _DATE_FORMATS or bool(re.search(r"[ymdhs]", code, re.I)))
        workbook = _part(book, "xl/workbook.xml")
        first = workbook.find(f"{_MAIN}sheets")[0].get(f"{_REL}id")
        links = {r.get("Id"): r.get("Target") for r in _part(book, "xl/_rels/workbook.xml.rels")}
        target = links[first].lstrip("/")
        properties = workbook.find(f"{_MAIN}workbookPr")
        epoch = datetime(1904, 1, 1) if properties is not None and properties.get("date1904") in ("1", "true") else datetime(1899, 12, 30)
        sheet = _part(book, target if target.startswith("xl/") else f"xl/{target}")
        rows = []
        for row in sheet.iter(f"{_MAIN}row"):
            cells: list[Any] = []
            for i, cell in enumerate(row.findall(f"{_MAIN}c")):
                at = _column(cell.get("r")) if cell.get("r") else i
                cells += [None] * (at + 1 - len(cells))
                cells[at] = _value(cell, strings, dated, epoch)
            rows.append(cells)
    if not rows:
        return [], []
    names = [str(n) if n is not None else f"column_{i + 1}" for i, n in enumerate(rows[0])]
    return names, [(r + [None] * len(names))[: len(names)] for r in rows[1:] if any(c is not None for c in r)]


def _value(cell: ElementTree.Element, strings: list[str], dated: list[bool], epoch: datetime) -> Any:
    kind, v = cell.get("t"), cell.find(f"{_MAIN}v")
    if kind == "inlineStr":
        return "".join(t.text or "" for t in cell.iter(f"{_MAIN}t"))
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    style = int(cell.get("s", "0"))
    if style < len(dated) and dated[style]:
        return epoch + timedelta(days=number)
    return int(number) if number.is_integer() and "." not in v.text and "E" not in v.text.upper() else number


def _kind(values: list[Any]) -> T.DataType:
    kinds = {type(v) for v in values if v is not None}
    if kinds and kinds <= {int}:
        return T.LongType()
    if kinds and kinds <= {int, float}:
        return T.DoubleType()
    if kinds == {bool}:
        return T.BooleanType()
    return T.TimestampNTZType() if kinds == {datetime} else T.StringType()


def read_excel(spark: SparkSession, files: list[str], schema: T.StructType | None = None) -> DataFrame:
    """The rows of workbooks with the same columns; types from the first workbook unless a schema is given."""
    if any(f.lower().endswith(".xls") for f in files):
        raise UnsupportedFormatError("the old binary .xls format is not supported; save as .xlsx")
    ship(spark)
    scan = spark.read.format("binaryFile").load([escape_glob(f) for f in files]).select("content")
    if schema is None:
        names, rows = parse(bytes(spark.read.format("binaryFile").load(escape_glob(files[0])).select("content").first().content))
        schema = T.StructType([T.StructField(n, _kind([r[i] for r in rows])) for i, n in enumerate(names)])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)
    texts = [isinstance(f.dataType, T.StringType) for f in schema.fields]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column("content"):
                names, rows = parse(content.as_py())
                if set(names) != set(arrow.names):
                    raise ValueError(f"workbooks have different columns: {sorted(set(names) ^ set(arrow.names))}")
                columns = [[r[names.index(n)] for r in rows] for n in arrow.names]
                columns = [[None if v is None else str(v) for v in c] if text else c for c, text in zip(columns, texts, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return scan.mapInArrow(batches, schema)
