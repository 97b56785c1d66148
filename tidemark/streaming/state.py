"""State of a job, kept beside its checkpoint.

Every save belongs to a batch: ``state/<name>.json/<batch>`` or
``state/<name>.parquet/v<batch>``.  A batch reads the newest version of an earlier
batch and writes its own, so running it again reads and writes the same.  Outside
of a batch (``batch_id`` None) saves go to one more version than there is.

A table that only grows is kept in parts, ``state/<name>.parts/v<batch>``, one a
batch.  After ``MANY_PARTS`` of them, or where a type gets wider, a batch first puts all earlier ones together as
``base<batch before>``; a reader takes the newest base and the parts since.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fs import fs_for, local_path
from tidemark.sources.readers import session

_KINDS = ("json", "parquet", "parts")
#: Parts of a growing table that are read beside its base.
MANY_PARTS = 64


class JobState:
    def __init__(self, root: Any, batch_id: int | None = None, keep: int = 2):
        self.root, self.batch_id, self.keep = local_path(root).rstrip("/"), batch_id, max(2, keep)
        self.fs = fs_for(self.root)
        self.fs.mkdirs(self.root)

    def at(self, batch_id: int | None) -> JobState:
        """The state as a batch sees it."""
        return JobState(self.root, batch_id, self.keep)

    def _folder(self, name: str, kind: str) -> str:
        if not re.fullmatch(r"[\w.-]+", name):
            raise ValueError(f"not a state name: {name!r}")
        return f"{self.root}/{name}.{kind}"

    def _versions(self, name: str, kind: str) -> list[int]:
        found = (re.fullmatch(r"v(-?\d+)(\.json)?", n) for n in self.fs.names(self._folder(name, kind)))
        done = [int(m[1]) for m in found if m]
        if kind != "json":  # a version is there once its marker is
            done = [v for v in done if self.fs.exists(f"{self._folder(name, kind)}/v{v}/_SUCCESS")]
        return sorted(done)

    def _newest(self, name: str, kind: str, current: bool) -> int | None:
        versions = self._versions(name, kind)
        if self.batch_id is not None:
            versions = [v for v in versions if v < self.batch_id or current and v == self.batch_id]
        return versions[-1] if versions else None

    def _next(self, name: str, kind: str) -> int:
        return self.batch_id if self.batch_id is not None else max([-1, *self._versions(name, kind)]) + 1

    def _prune(self, name: str, kind: str, written: int) -> None:
        suffix = ".json" if kind == "json" else ""
        for v in [v for v in self._versions(name, kind) if v <= written][: -self.keep]:
            self.fs.delete(f"{self._folder(name, kind)}/v{v}{suffix}")

    def load_json(self, name: str, default: Any = None, current: bool = False) -> Any:
        v = self._newest(name, "json", current)
        return default if v is None else json.loads(self.fs.read(f"{self._folder(name, 'json')}/v{v}.json"))

    def save_json(self, name: str, obj: Any) -> None:
        v = self._next(name, "json")
        self.fs.write(f"{self._folder(name, 'json')}/v{v}.json", json.dumps(obj, sort_keys=True).encode())
        self._prune(name, "json", v)

    def load_parquet(self, name: str, current: bool = False) -> DataFrame | None:
        v = self._newest(name, "parquet", current)
        return None if v is None else session().read.parquet(f"{self._folder(name, 'parquet')}/v{v}")

    def save_parquet(self, name: str, df: DataFrame) -> None:
        v = self._next(name, "parquet")
        df.write.mode("overwrite").parquet(f"{self._folder(name, 'parquet')}/v{v}")
        self._prune(name, "parquet", v)

    def _bases(self, name: str) -> list[int]:
        folder = self._folder(name, "parts")
        found = [int(m[1]) for m in (re.fullmatch(r"base(-?\d+)", n) for n in self.fs.names(folder)) if m]
        return sorted(v for v in found if self.fs.exists(f"{folder}/base{v}/_SUCCESS"))

    def _parts(self, name: str) -> list[str]:
        """The folders that earlier batches' rows are in."""
        earlier = lambda vs: [v for v in vs if self.batch_id is None or v < self.batch_id]
        base = earlier(self._bases(name))[-1:]
        since = [v for v in earlier(self._versions(name, "parts")) if not base or v > base[0]]
        return [f"{self._folder(name, 'parts')}/{n}" for n in [*(f"base{v}" for v in base), *(f"v{v}" for v in since)]]

    def load_parts(self, name: str) -> DataFrame | None:
        """All rows that earlier batches added to a growing table."""
        folders = self._parts(name)
        return session().read.parquet(*folders) if folders else None

    def add_part(self, name: str, df: DataFrame, remembered: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Add a batch's rows; where earlier parts are put together, only the remembered rows of them stay."""
        folder, v, held = self._folder(name, "parts"), self._next(name, "parts"), self.load_parts(name)
        if held is not None:
            wide = held.unionByName(df).schema  # all parts that are read together have the same types
            fitted = lambda df: df.select(*(F.col(f"`{f.name}`").cast(f.dataType) for f in wide.fields))
            df = fitted(df)
            if len(self._parts(name)) > MANY_PARTS or [f.dataType for f in held.schema] != [f.dataType for f in wide]:
                old = [b for b in self._bases(name) if b < v - 1]
                fitted(remembered(held)).write.mode("overwrite").parquet(f"{folder}/base{v - 1}")
                # What the base before this one replaced is read by no batch that can still run again.
                for n in [*(f"base{b}" for b in old[:-1]), *(f"v{p}" for p in self._versions(name, "parts") if old and p <= old[-1])]:
                    self.fs.delete(f"{folder}/{n}")
        df.write.mode("overwrite").parquet(f"{folder}/v{v}")

    def exists(self, name: str, *, kind: str | None = None) -> bool:
        return any(self._newest(name, k, True) is not None for k in self._kinds(kind))

    def delete(self, name: str, *, kind: str | None = None) -> bool:
        found = [k for k in self._kinds(kind) if self.fs.exists(self._folder(name, k))]
        for k in found:
            self.fs.delete(self._folder(name, k))
        return bool(found)

    def _kinds(self, kind: str | None) -> tuple[str, ...]:
        if kind is not None and kind not in _KINDS:
            raise ValueError(f"unknown state kind: {kind!r}")
        return (kind,) if kind else _KINDS
