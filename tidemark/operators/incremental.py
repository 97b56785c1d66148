"""Patterns that carry state from batch to batch.

Each reads the newest state before its batch and writes the state of its batch (see
``streaming.state``), so a batch that is run again gives the same state.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.union import diagonal


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be merged: how a batch makes it, how two merge, how it is shown."""

    name: str
    kind: str
    column: str | Column | None = None

    KINDS: ClassVar[tuple[str, ...]] = ("sum", "count", "min", "max", "avg", "approx_distinct")

    def __post_init__(self):
        if self.kind not in self.KINDS:
            raise ValueError(f"unknown aggregate: {self.kind!r}")

    def _value(self) -> Column:
        return F.lit(1) if self.column is None else F.col(self.column) if isinstance(self.column, str) else self.column

    def partial(self) -> list[Column]:
        v = self._value()
        return {
            "sum": lambda: [F.sum(v).alias(self.name)],
            "count": lambda: [F.count(v).alias(self.name)],
            "min": lambda: [F.min(v).alias(self.name)],
            "max": lambda: [F.max(v).alias(self.name)],
            "avg": lambda: [F.sum(v.cast("double")).alias(f"{self.name}__sum"), F.count(v).alias(f"{self.name}__n")],
            "approx_distinct": lambda: [F.hll_sketch_agg(v).alias(self.name)],
        }[self.kind]()

    def merge(self, like: dict[str, Any]) -> list[Column]:
        keep = lambda c, out: out.cast(like[c]).alias(c)
        if self.kind == "avg":
            return [keep(f"{self.name}__sum", F.sum(f"{self.name}__sum")), keep(f"{self.name}__n", F.sum(f"{self.name}__n"))]
        if self.kind == "approx_distinct":
            return [F.hll_union_agg(self.name).alias(self.name)]
        function = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}[self.kind]
        return [keep(self.name, function(self.name))]

    def final(self) -> Column:
        if self.kind == "avg":
            return (F.col(f"{self.name}__sum") / F.nullif(F.col(f"{self.name}__n"), F.lit(0))).alias(self.name)
        if self.kind == "approx_distinct":
            return F.hll_sketch_estimate(self.name).alias(self.name)
        return F.col(self.name)


@dataclass(frozen=True)
class IncrementalAggregate:
    """A cumulative group-by: the batch's partial aggregates are merged into the state's."""

    name: str
    keys: list[Any]
    measures: list[Measure] = field(default_factory=list)

    def _key_names(self, df: DataFrame) -> list[str]:
        return df.columns[: len(self.keys)]

    def update(self, batch: DataFrame, state: Any) -> DataFrame:
        """Merge a batch into the state and return all groups."""
        partial = batch.groupBy(*self.keys).agg(*(c for m in self.measures for c in m.partial()))
        names, before = self._key_names(partial), state.load_parquet(self.name)
        if before is not None:
            like = {f.name: f.dataType for f in partial.schema.fields}
            partial = diagonal([before, partial]).groupBy(*names).agg(*(c for m in self.measures for c in m.merge(like)))
        state.save_parquet(self.name, partial)
        return self.result(state)

    def result(self, state: Any) -> DataFrame | None:
        held = state.load_parquet(self.name, current=True)
        return None if held is None else held.select(*self._key_names(held), *(m.final() for m in self.measures))


@dataclass(frozen=True)
class TumblingWindow(IncrementalAggregate):
    """A cumulative group-by on windows of event time, merged across batches."""

    @classmethod
    def of(cls, name: str, time_column: str, every: str, measures: list[Measure], keys: tuple = ()) -> TumblingWindow:
        start = F.window(F.col(time_column), every)["start"].alias("window_start")
        return cls(name, [start, *keys], measures)


@dataclass(frozen=True)
class WatermarkGate:
    """Rows that are not too late: their event time is at least the greatest one of earlier batches less the lateness."""

    name: str
    time_column: str
    lateness: str  # a Spark interval, such as "5 minutes"

    def split(self, batch: DataFrame, state: Any) -> tuple[DataFrame, DataFrame]:
        """Rows in time and late rows (null times are late once there is a watermark); the batch moves the watermark for the next one."""
        time = F.col(self.time_column)
        held = state.load_json(self.name, None)
        seen = batch.agg(F.max(time).cast("string").alias("m")).first()["m"]
        kind = batch.schema[self.time_column].dataType
        marks = [x for x in (held, seen) if x is not None]
        state.save_json(self.name, max(marks) if marks else None)
        if held is None:
            return batch, batch.filter(F.lit(False))
        in_time = F.coalesce(time >= F.lit(held).cast(kind) - F.expr(f"INTERVAL {self.lateness}"), F.lit(False))
        return batch.filter(in_time), batch.filter(~in_time)


@dataclass(frozen=True)
class SeenKeys:
    """Rows whose key no earlier batch had; inside a batch the latest of each key."""

    name: str
    keys: list[str]
    order: list[Any]  # the last in this order stays
    expire: tuple[str, str] | None = None  # (event time column, interval): keys older than the newest by more are forgotten

    def fresh(self, batch: DataFrame, state: Any) -> DataFrame:
        """The rows, computed once and read back; their keys are added to the seen ones, which are not rewritten."""
        rank = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*_descending(self.order)))
        rows = batch.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")
        seen = state.load_parts(self.name)
        if seen is not None:
            seen = self._remembered(seen)
            match = [rows[k].eqNullSafe(seen[k]) for k in self.keys]
            rows = rows.join(seen, match, "left_anti")
        state.save_parquet(f"{self.name}-fresh", rows)
        rows = state.load_parquet(f"{self.name}-fresh", current=True)
        state.add_part(self.name, rows.select(*self.keys, *([self.expire[0]] if self.expire else [])), self._remembered)
        return rows

    def _remembered(self, seen: DataFrame) -> DataFrame:
        """The seen keys that are not older than the newest by more than the interval."""
        if not self.expire:
            return seen
        time, interval = self.expire
        newest = seen.agg(F.max(time).alias("__newest"))  # one row
        return seen.join(F.broadcast(newest)).filter(F.col(time) >= F.col("__newest") - F.expr(f"INTERVAL {interval}")).drop("__newest")


@dataclass(frozen=True)
class LatestByKey:
    """A table of the last row of each key."""

    name: str
    keys: list[str]
    order: list[Any]

    def update(self, batch: DataFrame, state: Any) -> DataFrame:
        held = state.load_parquet(self.name)
        both = batch if held is None else diagonal([held, batch])
        last = F.max_by(F.struct(*both.columns), F.struct(*self.order)).alias("row")  # aggregates map-side, unlike a window
        rows = both.groupBy(*self.keys).agg(last).select("row.*")
        state.save_parquet(self.name, rows)
        return state.load_parquet(self.name, current=True)


def _descending(order: list[Any]) -> list[Column]:
    return [F.desc_nulls_last(c) if isinstance(c, str) else c.desc_nulls_last() for c in order]
