"""The log of a checkpoint folder: metadata, offsets (what a batch reads) and commits (that it was written).

    metadata.json         format version, start offset, schema, ...
    offsets/<id>.json     written before a batch is read, never overwritten
    commits/<id>.json     written once its results are safe
"""

from __future__ import annotations

import os
import socket
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from tidemark.fs import fs_for, local_path, read_json, write_json

FORMAT_VERSION = 1


@dataclass(frozen=True)
class BatchInfo:
    """A batch of files."""

    batch_id: int
    files: list[str]
    created_at: float


@dataclass(frozen=True)
class DeltaOffset:
    """A position in a table's log, or in its sorted snapshot."""

    table_id: str | None
    version: int
    index: int
    is_initial_snapshot: bool


@dataclass(frozen=True)
class DeltaFileEntry:
    """Where a file of a batch comes from."""

    path: str
    commit_version: int
    commit_timestamp: int | None
    change_type: str | None
    size: int | None
    partition: dict[str, str | None] = field(default_factory=dict)


@dataclass(frozen=True)
class DeltaBatch:
    """A batch of a table's files."""

    batch_id: int
    offset: DeltaOffset
    files: list[str]
    created_at: float
    file_entries: list[DeltaFileEntry] | None = None


class CheckpointLog:
    def __init__(self, root: Any):
        self.root = local_path(root).rstrip("/")
        self.fs = fs_for(self.root)
        self._ids: dict[str, list[int]] = {}
        for kind in ("offsets", "commits"):
            self.fs.mkdirs(f"{self.root}/{kind}")
        if self.metadata() is None:
            self.save_metadata({"format_version": FORMAT_VERSION, "created_at": time.time()})

    def metadata(self) -> dict | None:
        return read_json(self.fs, f"{self.root}/metadata.json")

    def save_metadata(self, payload: dict) -> None:
        write_json(self.fs, f"{self.root}/metadata.json", payload)

    def update_metadata(self, **changes: Any) -> None:
        """Set keys; None removes one."""
        now = (self.metadata() or {}) | changes
        self.save_metadata({k: v for k, v in now.items() if v is not None})

    def ids(self, kind: str) -> list[int]:
        """Batch ids, listed once and then kept."""
        if kind not in self._ids:
            names = (n.removesuffix(".json") for n in self.fs.names(f"{self.root}/{kind}") if n.endswith(".json"))
            self._ids[kind] = sorted(int(n) for n in names if n.isdigit())
        return self._ids[kind]

    def latest(self, kind: str) -> int | None:
        return self.ids(kind)[-1] if self.ids(kind) else None

    def read(self, kind: str, batch_id: int) -> dict | None:
        return read_json(self.fs, f"{self.root}/{kind}/{batch_id}.json")

    def write(self, kind: str, batch_id: int, payload: dict) -> None:
        write_json(self.fs, f"{self.root}/{kind}/{batch_id}.json", payload)
        if batch_id not in self.ids(kind):
            self._ids[kind] = sorted([*self.ids(kind), batch_id])

    def write_once(self, kind: str, batch_id: int, payload: dict) -> None:
        if batch_id not in self.ids(kind):
            self.write(kind, batch_id, payload)

    def open_batch(self) -> int | None:
        """The id of a batch that was planned and not committed."""
        last, done = self.latest("offsets"), self.latest("commits")
        return last if last is not None and (done is None or last > done) else None

    def next_id(self) -> int:
        return max([-1, *self.ids("offsets")[-1:], *self.ids("commits")[-1:]]) + 1

    def pending(self) -> list[int]:
        done = self.latest("commits")
        return [i for i in self.ids("offsets") if done is None or i > done]

    # the schema of the stream

    def schema(self) -> list[dict] | None:
        found = (self.metadata() or {}).get("schema")
        return found if isinstance(found, list) else None

    def save_schema(self, payload: list[dict] | None) -> None:
        self.update_metadata(schema=payload)


@contextmanager
def job_lock(root: Any, timeout: float | None = None, stale: float | None = None):
    """One writer for a checkpoint folder.

    The lock is a file created exclusively with its owner and time.  A lock whose
    owner is a dead process of this host, or that is older than ``stale`` seconds,
    is taken over.  ``timeout`` 0 fails at once; both default to the environment:
    TIDEMARK_LOCK_TIMEOUT (default 0) and TIDEMARK_LOCK_STALE_SECONDS (default
    none); TIDEMARK_DISABLE_LOCK=1 turns locking off.
    """
    if os.environ.get("TIDEMARK_DISABLE_LOCK") == "1":
        yield
        return
    timeout = _seconds("TIDEMARK_LOCK_TIMEOUT", 0.0) if timeout is None else timeout
    stale = _seconds("TIDEMARK_LOCK_STALE_SECONDS", None) if stale is None else stale
    root = local_path(root).rstrip("/")
    fs, path, began = fs_for(root), f"{root}/.pipeline.lock", time.monotonic()
    payload = f"host={socket.gethostname()}\npid={os.getpid()}\nacquired_at={time.time()}\n".encode()
    while not fs.create(path, payload):
        if _abandoned(fs, path, stale):
            fs.delete(path)
        elif time.monotonic() - began >= timeout:
            raise RuntimeError(f"pipeline lock already held: {path}")
        else:
            time.sleep(min(0.1, max(0.01, timeout / 10)))
    try:
        yield
    finally:
        fs.delete(path)


def _seconds(name: str, default: float | None) -> float | None:
    try:
        return float(os.environ[name])
    except (KeyError, ValueError):
        return default


def _abandoned(fs, path: str, stale: float | None) -> bool:
    try:
        held = dict(line.split("=", 1) for line in fs.read(path).decode(errors="replace").splitlines() if "=" in line)
    except OSError:
        return False  # just released: the next attempt tells
    if held.get("host") == socket.gethostname() and held.get("pid", "").isdigit():
        try:
            os.kill(int(held["pid"]), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
    try:
        since = float(held["acquired_at"])
    except (KeyError, ValueError):
        found = fs.stat(path)
        since = found.mtime if found else time.time()
    return stale is not None and stale > 0 and time.time() - since > stale
