"""Logical type names, their Spark types, and the widening rules between them.

Spark has no unsigned types: a declared ``UInt32`` is a ``bigint`` whose logical name
is kept in the field's metadata, so that widening can tell it from a signed one.
"""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import types as T

from tidemark.errors import SchemaEvolutionError

LOGICAL = "logical"

# Short type names and the Spark types that hold them.
NAMES: dict[str, T.DataType] = {
    "Int8": T.ByteType(), "Int16": T.ShortType(), "Int32": T.IntegerType(), "Int64": T.LongType(),
    "UInt8": T.ShortType(), "UInt16": T.IntegerType(), "UInt32": T.LongType(), "UInt64": T.DecimalType(20, 0),
    "Float32": T.FloatType(), "Float64": T.DoubleType(), "Boolean": T.BooleanType(),
    "String": T.StringType(), "Utf8": T.StringType(), "Utf8View": T.StringType(), "Categorical": T.StringType(),
    "Binary": T.BinaryType(), "BinaryView": T.BinaryType(), "Date": T.DateType(), "Time": T.LongType(),
}
_SIGNED, _UNSIGNED, _FLOAT = ("Int8", "Int16", "Int32", "Int64"), ("UInt8", "UInt16", "UInt32", "UInt64"), ("Float32", "Float64")
_BY_TYPE = {type(NAMES[n]): n for n in (*_SIGNED, *_FLOAT, "Boolean", "String", "Binary", "Date")}


def _arguments(text: str) -> list[str]:
    """The parts of a list that are divided by top-level commas."""
    out, depth, begin, quote = [], 0, 0, ""
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[begin:i])
            begin = i + 1
    return [p.strip() for p in [*out, text[begin:]] if p.strip()]


def parse_field(name: str, spec: Any) -> T.StructField:
    """A column of a type, a short name such as ``List(Int64)``, a Spark DDL type or a Spark JSON type."""
    if isinstance(spec, T.DataType):
        return T.StructField(name, spec, True)
    if isinstance(spec, dict):
        return T.StructField(name, T.StructType.fromJson({"type": "struct", "fields": [{"name": name, "type": spec, "nullable": True, "metadata": {}}]})[0].dataType, True)
    if isinstance(spec, type) and issubclass(spec, T.DataType):
        return T.StructField(name, spec(), True)
    text = str(spec).strip()
    if text in NAMES:
        kept = {LOGICAL: text} if text in _UNSIGNED or text == "Time" else {}
        return T.StructField(name, NAMES[text], True, kept)
    found = re.fullmatch(r"(\w+)\((.*)\)", text, re.S)
    if found and found[1] in ("List", "Struct", "Enum", "Datetime", "Duration", "Decimal"):
        return _parametric(name, found[1], _arguments(found[2]))
    if text in ("Datetime", "Duration"):
        return _parametric(name, text, [])
    try:
        return T.StructField(name, T.DataType.fromDDL(text), True)
    except Exception as e:
        raise SchemaEvolutionError(f"unknown type of column {name!r}: {spec!r}") from e


def _parametric(name: str, kind: str, args: list[str]) -> T.StructField:
    value = lambda a: a.partition("=")[2].strip().strip("'\"") if "=" in a else a.strip("'\"")
    if kind == "List":
        return T.StructField(name, T.ArrayType(parse_field("element", args[0]).dataType), True)
    if kind == "Struct":
        inner = _arguments(args[0].strip()[1:-1])
        pairs = [(p.partition(":")[0].strip().strip("'\""), p.partition(":")[2].strip()) for p in inner]
        return T.StructField(name, T.StructType([parse_field(n, t) for n, t in pairs]), True)
    if kind == "Enum":
        listed = re.findall(r"'([^']*)'|\"([^\"]*)\"", args[0] if args else "")
        return T.StructField(name, T.StringType(), True, {"enum": [a or b for a, b in listed]})
    if kind == "Decimal":
        return T.StructField(name, T.DecimalType(*(int(value(a)) for a in args)), True)
    if kind == "Duration":
        return T.StructField(name, T.DayTimeIntervalType(), True)
    zone = next((value(a) for a in args if "zone" in a), value(args[1]) if len(args) > 1 else "None")
    return T.StructField(name, T.TimestampNTZType(), True) if zone in ("None", "") else T.StructField(name, T.TimestampType(), True, {"time_zone": zone})


def logical_name(field: T.StructField) -> str | None:
    """The short name of a simple column's type; None of others."""
    return field.metadata.get(LOGICAL) or _BY_TYPE.get(type(field.dataType))


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Whether two types are equal but for what may be null."""
    return a.simpleString() == b.simpleString()


def widened(a: T.StructField, b: T.StructField) -> T.StructField | None:
    """The column that holds both, or None where no rule applies."""
    x, y = logical_name(a), logical_name(b)
    if same_type(a.dataType, b.dataType) and (x == y or x is None or y is None):
        return a
    if x is None or y is None:
        return None
    names = {x, y}
    if "String" in names:
        other = (names - {"String"}).pop() if len(names) > 1 else "String"
        return _named(a.name, "String") if other in (*_SIGNED, *_UNSIGNED, *_FLOAT, "Boolean", "String") else None
    if "Boolean" in names:
        other = (names - {"Boolean"}).pop() if len(names) > 1 else "Boolean"
        return _named(a.name, other if other in (*_SIGNED, *_UNSIGNED) else "Float64") if other in (*_SIGNED, *_UNSIGNED, *_FLOAT) else None
    for family in (_SIGNED, _UNSIGNED, _FLOAT):
        if names <= set(family):
            return _named(a.name, max(names, key=family.index))
    return _named(a.name, "Float64") if names <= {*_SIGNED, *_UNSIGNED, *_FLOAT} else None


def _named(column: str, name: str) -> T.StructField:
    return parse_field(column, name)
