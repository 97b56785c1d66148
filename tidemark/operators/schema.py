"""Schema rules of a stream: strict, add_new_columns, coerce and type_widen.

``SchemaEvolution.apply`` compares a batch's columns with the stream's and returns
the batch in the stream's columns, as one projection: nothing is computed until
the batch is written.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.errors import SchemaEvolutionError
from tidemark.functions.logical import parse_field, same_type, widened

MODES = ("strict", "add_new_columns", "coerce", "type_widen")
RESCUE_MODES = ("none", "column")


@dataclass(frozen=True)
class SchemaPolicy:
    mode: str = "strict"
    rescue_mode: str = "none"
    rescue_column: str = "_rescued"

    def __post_init__(self):
        if self.mode not in MODES:
            raise SchemaEvolutionError(f"unknown schema mode: {self.mode!r}")
        if self.rescue_mode not in RESCUE_MODES:
            raise SchemaEvolutionError(f"unknown rescue mode: {self.rescue_mode!r}")


def schema_fields(schema: Any) -> list[T.StructField]:
    """Fields of a StructType, a mapping, a list of (name, type) or of stored dicts."""
    if schema is None:
        return []
    if isinstance(schema, T.StructType):
        return list(schema.fields)
    if isinstance(schema, dict):
        return [parse_field(str(n), t) for n, t in schema.items()]
    out = []
    try:
        for item in schema:
            if isinstance(item, T.StructField):
                out.append(item)
            elif isinstance(item, dict) and "dtype" in item:
                out.append(parse_field(item["name"], item["dtype"]))
            elif isinstance(item, dict):
                out.append(T.StructField.fromJson({"nullable": True, "metadata": {}} | item))
            else:
                name, kind = item
                out.append(parse_field(str(name), kind))
    except (TypeError, ValueError, KeyError) as e:
        raise SchemaEvolutionError(f"not a schema: {schema!r}") from e
    return out


def stored(fields: list[T.StructField]) -> list[dict]:
    return [{"name": f.name, "type": f.dataType.jsonValue(), "nullable": True, "metadata": f.metadata or {}} for f in fields]


def _try_cast(column: Column, field: T.StructField, df: DataFrame, name: str) -> Column:
    """The value as the type; null where it does not fit, or where the types cannot meet."""
    out = column.try_cast(field.dataType)
    try:
        df.select(out)
    except AnalysisException:
        out = F.lit(None).cast(field.dataType)
    if field.metadata.get("enum"):
        out = F.when(out.isin(*field.metadata["enum"]), out)
    return out


def evolve(df: DataFrame, fields: list[T.StructField], policy: SchemaPolicy, stable_rescue: bool = False) -> tuple[DataFrame, list[T.StructField]]:
    """The batch in the stream's columns, and the stream's columns after it."""
    batch = {f.name: f for f in df.schema.fields}
    known = {f.name for f in fields}
    new = [f for n, f in batch.items() if n not in known and n != policy.rescue_column]
    missing = [f.name for f in fields if f.name not in batch]
    unlike = [f.name for f in fields if f.name in batch and not same_type(f.dataType, batch[f.name].dataType)]
    if policy.mode == "strict" and (new or missing or unlike):
        raise SchemaEvolutionError(f"strict schema: new columns {[f.name for f in new]}, missing {missing}, other types {unlike}")
    if policy.mode == "add_new_columns" and unlike:
        raise SchemaEvolutionError(f"columns of another type: {unlike}")
    target = []
    for f in fields:
        if policy.mode == "type_widen" and f.name in batch and (f.name in unlike or f.metadata):
            wide = widened(f, batch[f.name])
            if wide is None:
                raise SchemaEvolutionError(f"column {f.name!r} cannot widen from {f.dataType.simpleString()} to hold {batch[f.name].dataType.simpleString()}")
            target.append(wide)
        else:
            target.append(f)
    target += new
    out, rescued = [], []
    for f in target:
        column = F.col(f"`{f.name}`")
        if f.name not in batch:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        checked = bool(f.metadata.get("enum"))
        if same_type(f.dataType, batch[f.name].dataType) and not checked:
            out.append(column)
            cast = None
        else:
            cast = _try_cast(column, f, df, f.name)
            out.append(cast.alias(f.name))
        if policy.rescue_mode == "column" and (cast is not None or stable_rescue):
            text = F.when(column.isNotNull() & cast.isNull(), column.cast("string")) if cast is not None else F.lit(None).cast("string")
            rescued.append(text.alias(f.name))
    if rescued:
        out.append(F.struct(*rescued).alias(policy.rescue_column))
    return df.select(*out), target


@dataclass(frozen=True)
class SchemaEvolution:
    """Schema rules; an explicit schema outranks the stored one, which outranks the first batch's."""

    mode: str = "strict"
    rescue_mode: str = "none"
    rescue_column: str = "_rescued"
    schema: Any = None
    stable_rescue: bool = False

    def __post_init__(self):
        self.policy  # noqa: B018  modes are checked at once

    @property
    def policy(self) -> SchemaPolicy:
        return SchemaPolicy(self.mode, self.rescue_mode, self.rescue_column)

    def plan(self, data: DataFrame, checkpoint: Any) -> tuple[DataFrame, list[dict] | None]:
        """The batch in the stream's columns, and the schema to store once it is committed (None: unchanged)."""
        if not isinstance(data, DataFrame):
            return data, None
        held = checkpoint.schema() if checkpoint is not None and hasattr(checkpoint, "schema") else None
        fields = schema_fields(self.schema) if self.schema is not None else schema_fields(held)
        if not fields:
            return data, stored(list(data.schema.fields))
        out, after = evolve(data, fields, self.policy, self.stable_rescue)
        payload = stored(after)
        return out, payload if payload != held else None

    def apply(self, data: Any, checkpoint: Any = None) -> Any:
        """As ``plan``, storing the schema at once; what is no DataFrame passes untouched."""
        out, payload = self.plan(data, checkpoint)
        if payload is not None and checkpoint is not None and hasattr(checkpoint, "save_schema"):
            checkpoint.save_schema(payload)
        return out

    @classmethod
    def from_options(cls, options: dict[str, Any]) -> tuple[SchemaEvolution | None, dict[str, Any]]:
        """The rules that options name, and the other options."""
        names = {"schema_mode": "mode", "rescue_mode": "rescue_mode", "rescue_column": "rescue_column", "schema": "schema"}
        given = {names[k]: v for k, v in options.items() if k in names and v is not None}
        rest = {k: v for k, v in options.items() if k not in names}
        return (cls(**given) if given else None), rest
