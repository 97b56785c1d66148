"""Care of checkpoint folders and tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from pathlib import Path
from typing import Any

from tidemark.fs import fs_for, local_path, read_json, write_json
from tidemark.plans.files import FileIndex
from tidemark.plans.log import CheckpointLog, job_lock
from tidemark.sources.readers import session
from tidemark.table import DeltaTable


@dataclass(frozen=True)
class CleanupResult:
    removed_offsets: int
    removed_commits: int
    kept_offsets: int
    kept_commits: int


@dataclass(frozen=True)
class TruncateResult:
    removed_offsets: int
    removed_commits: int
    kept_offsets: int
    kept_commits: int


@dataclass(frozen=True)
class CheckpointInfo:
    checkpoint_dir: Path
    offsets: int
    commits: int
    latest_offset: int | None
    latest_commit: int | None
    pending: int
    start_offset: dict | None
    schema: list[dict] | None
    snapshot_cache_snapshots: int
    snapshot_cache_deltas: int


def _open(checkpoint_dir: Any) -> CheckpointLog:
    root = local_path(checkpoint_dir)
    if not fs_for(root).exists(f"{root}/metadata.json"):
        fs_for(root).mkdirs(root)
    return CheckpointLog(root)


def _remove(log: CheckpointLog, kind: str, ids: set[int], dry_run: bool) -> int:
    present = [i for i in log.ids(kind) if i in ids]
    for i in () if dry_run else present:
        log.fs.delete(f"{log.root}/{kind}/{i}.json")
    return len(present)


def cleanup_checkpoint(checkpoint_dir: Any, *, keep_last_n: int | None = None, older_than_seconds: float | None = None, dry_run: bool = False) -> CleanupResult:
    """Remove old batches' logs: those that are neither among the newest N nor younger than the age.

    A batch's offset and commit go together, and the newest committed batch and open
    batches never go.  The file index remembers what they read.
    """
    if keep_last_n is None and older_than_seconds is None:
        raise ValueError("give keep_last_n, older_than_seconds or both")
    if keep_last_n is not None and keep_last_n < 0 or older_than_seconds is not None and older_than_seconds < 0:
        raise ValueError("limits must not be negative")
    with job_lock(checkpoint_dir):
        log = _open(checkpoint_dir)
        every = sorted({*log.ids("offsets"), *log.ids("commits")})
        last = log.latest("commits")
        keep = {i for i in every if last is None or i >= last}
        if keep_last_n:
            keep |= set(every[-keep_last_n:])
        if older_than_seconds is not None:
            limit = time.time() - older_than_seconds
            for i in every:
                stats = [log.fs.stat(f"{log.root}/{k}/{i}.json") for k in ("offsets", "commits")]
                if any(s is not None and s.mtime > limit for s in stats):
                    keep.add(i)
        gone = set(every) - keep
        offsets, commits = len(log.ids("offsets")), len(log.ids("commits"))
        a, b = _remove(log, "offsets", gone, dry_run), _remove(log, "commits", gone, dry_run)
        return CleanupResult(a, b, offsets - a, commits - b)


def truncate_checkpoint(checkpoint_dir: Any, *, keep_through_batch_id: int, dry_run: bool = False) -> TruncateResult:
    """Forget the batches after one; their files become new again."""
    with job_lock(checkpoint_dir):
        log = _open(checkpoint_dir)
        gone = {i for k in ("offsets", "commits") for i in log.ids(k) if i > keep_through_batch_id}
        offsets, commits = len(log.ids("offsets")), len(log.ids("commits"))
        files = {f for i in gone for f in (log.read("offsets", i) or {}).get("files", ())}
        kept = {f for i in log.ids("offsets") if i not in gone for f in (log.read("offsets", i) or {}).get("files", ())} if files else set()
        a, b = _remove(log, "offsets", gone, dry_run), _remove(log, "commits", gone, dry_run)
        if not dry_run and files:
            FileIndex(log).remove(files - kept)
        return TruncateResult(a, b, offsets - a, commits - b)


def _reset(checkpoint_dir: Any, key: str) -> Any:
    root = local_path(checkpoint_dir).rstrip("/")
    fs, path = fs_for(root), f"{root}/metadata.json"
    payload = read_json(fs, path)
    if not payload or key not in payload:
        return None
    old = payload.pop(key)
    write_json(fs, path, payload)
    return old


def reset_checkpoint_start_offset(checkpoint_dir: Any) -> dict | None:
    """Forget where the stream started; the old start."""
    return _reset(checkpoint_dir, "start_offset")


def reset_checkpoint_schema(checkpoint_dir: Any) -> list[dict] | None:
    """Forget the stream's schema; the old one."""
    return _reset(checkpoint_dir, "schema")


def _cache(root: str, kind: str) -> list[int]:
    names = fs_for(root).names(f"{root}/snapshot_cache/{kind}")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def inspect_checkpoint(checkpoint_dir: Any) -> CheckpointInfo:
    root = local_path(checkpoint_dir).rstrip("/")
    fs = fs_for(root)
    ids = {k: sorted(int(n[:-5]) for n in fs.names(f"{root}/{k}") if n.endswith(".json") and n[:-5].isdigit()) for k in ("offsets", "commits")}
    meta = read_json(fs, f"{root}/metadata.json") or {}
    of_kind = lambda key, kind: meta.get(key) if isinstance(meta.get(key), kind) else None
    return CheckpointInfo(
        Path(root), len(ids["offsets"]), len(ids["commits"]), ids["offsets"][-1] if ids["offsets"] else None, ids["commits"][-1] if ids["commits"] else None,
        len(set(ids["offsets"]) - set(ids["commits"])), of_kind("start_offset", dict), of_kind("schema", list), len(_cache(root, "snapshots")), len(_cache(root, "deltas")),
    )


def cleanup_snapshot_cache(checkpoint_dir: Any, *, keep_snapshots: int | None = 1, keep_deltas_since_snapshot: int | None = 0, dry_run: bool = False) -> CleanupResult:
    """Remove cached snapshots but for the newest ones, and cached deltas older than the newest kept snapshot by more than a number of versions.

    Counts of snapshots are in the fields of offsets, those of deltas in the fields of commits.
    """
    root = local_path(checkpoint_dir).rstrip("/")
    fs, held = fs_for(root), {k: _cache(root, k) for k in ("snapshots", "deltas")}
    kept = held["snapshots"][-keep_snapshots:] if keep_snapshots else []
    anchor = max(kept or held["snapshots"], default=None)
    if keep_deltas_since_snapshot is None:
        deltas = []
    else:
        deltas = [v for v in held["deltas"] if anchor is None or v >= anchor - keep_deltas_since_snapshot]
    gone = {"snapshots": set(held["snapshots"]) - set(kept), "deltas": set(held["deltas"]) - set(deltas)}
    for kind, versions in gone.items():
        for v in () if dry_run else versions:
            for name in (f"{v:020d}.json", f"{v}.json"):
                fs.delete(f"{root}/snapshot_cache/{kind}/{name}")
    return CleanupResult(len(gone["snapshots"]), len(gone["deltas"]), len(kept), len(deltas))


def vacuum_delta_table(table_path: Any, *, retention_hours: float = 168.0, dry_run: bool = False, enforce_retention: bool | None = None) -> list[str]:
    """Delete files that no version within the retention needs; the files."""
    return DeltaTable(session(), table_path).vacuum(retention_hours, dry_run, True if enforce_retention is None else enforce_retention)


def optimize_delta_table(
    table_path: Any, *, mode: str = "compact", z_order_columns: list[str] | None = None, partition_filters: list[tuple] | None = None, target_size: int | None = None,
    max_concurrent_tasks: int | None = None, max_spill_size: int | None = None,
) -> dict[str, int]:
    """Compact a table's files or cluster them by columns.

    ``max_concurrent_tasks`` and ``max_spill_size`` are known and change nothing, as Spark schedules
    tasks and spilling; any other keyword is an error.
    """
    return DeltaTable(session(), table_path).optimize(mode, z_order_columns, partition_filters, target_size)
