"""Unions by name that never change a type silently."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import SchemaEvolutionError
from tidemark.functions.logical import same_type, widened


def _check_types(frames: list[DataFrame]) -> None:
    seen = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name in seen and not same_type(seen[f.name], f.dataType):
                raise SchemaEvolutionError(f"column {f.name!r} is {seen[f.name].simpleString()} and {f.dataType.simpleString()}")
            seen.setdefault(f.name, f.dataType)


def diagonal(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null.  A column has one type in all frames."""
    _check_types(frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def vertical(frames: list[DataFrame]) -> DataFrame:
    """All rows of frames with the same columns and types."""
    _check_types(frames)
    for df in frames[1:]:
        if set(df.columns) != set(frames[0].columns):
            raise SchemaEvolutionError(f"columns differ: {sorted(set(df.columns) ^ set(frames[0].columns))}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def relaxed_union(frames: list[DataFrame]) -> DataFrame:
    """All rows; columns that a frame lacks are null, and columns of unlike types get the type that holds both."""
    fields = {}
    for df in frames:
        for f in df.schema.fields:
            if f.name not in fields:
                fields[f.name] = f
                continue
            wide = widened(fields[f.name], f)
            if wide is None:
                raise SchemaEvolutionError(f"no common type of column {f.name!r}: {fields[f.name].dataType.simpleString()} and {f.dataType.simpleString()}")
            fields[f.name] = wide
    cast = lambda df: df.select(*((F.col(f"`{n}`") if n in df.columns else F.lit(None)).cast(f.dataType).alias(n) for n, f in fields.items()))
    return reduce(lambda a, b: a.unionByName(b), map(cast, frames))
