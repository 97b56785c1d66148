"""Tables: append, overwrite, and the merge of change rows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.cdc import CHANGE_TYPE, COMMIT_TIMESTAMP, COMMIT_VERSION, DELETE, UPSERTS, apply_cdc, check_changes, latest, normalised, prepared, without_change_columns
from tidemark.sources.readers import session
from tidemark.table import DeltaTable


def write_delta(df: DataFrame, target: Any, mode: str = "append", schema_mode: str | None = None, collect_kwargs: dict[str, Any] | None = None, partition_by: list[str] | None = None) -> str:
    """Write rows to a table and return the engine's name."""
    DeltaTable(df.sparkSession, target).write(df, mode, schema_mode, partition_by)
    return "spark"


def apply_cdc_delta(
    df: DataFrame, target: Any, *, keys: list[str] | str, change_type_col: str = CHANGE_TYPE, change_type_map: dict[str, str] | None = None, mode: str = "merge", ignore_delete: bool = False,
    ignore_update_preimage: bool = True, dedupe_by_latest_commit: bool = True, commit_version_col: str = COMMIT_VERSION, commit_timestamp_col: str = COMMIT_TIMESTAMP, schema_mode: str | None = None,
    collect_kwargs: dict[str, Any] | None = None, change_feed: bool = False,
) -> dict[str, Any]:
    """Merge change rows into a table; what was done, as a dict.

    Only files that hold a changed key are rewritten: one scan of the key columns
    finds them.  ``append_only`` on a table just appends.  ``change_feed`` writes the
    version's change data, so that streams can follow the merges.
    """
    keys = [keys] if isinstance(keys, str) else list(keys or ())
    check_changes(df, keys, change_type_col, mode)
    options = {"keys": keys, "change_type_col": change_type_col, "dedupe_by_latest_commit": dedupe_by_latest_commit, "commit_version_col": commit_version_col, "commit_timestamp_col": commit_timestamp_col, "ignore_update_preimage": ignore_update_preimage}
    changes = prepared(normalised(df, change_type_col, change_type_map), change_type_col, mode, ignore_delete, ignore_update_preimage).persist()
    try:
        counts = {r[0]: r[1] for r in changes.groupBy(F.col(f"`{change_type_col}`")).count().collect()}
        rows_in = sum(counts.values())
        if not rows_in:
            return {"rows_in": 0, "rows_out": 0, "action": "noop"}
        table = DeltaTable(session(df.sparkSession), target)
        if mode == "append_only":
            rows = apply_cdc(changes, None, mode=mode, **options).persist()
            try:
                rows_out = rows.count()
                table.write(rows, "append", schema_mode)
                return {"rows_in": rows_in, "rows_out": rows_out, "action": "append_only"}
            finally:
                rows.unpersist()
        if not table.exists():
            rows = apply_cdc(changes, None, mode=mode, **options).persist()
            try:
                rows_out = rows.count()
                if not rows_out:
                    return {"rows_in": rows_in, "rows_out": 0, "action": "noop"}
                table.write(rows, "append", schema_mode)
                return {"rows_in": rows_in, "rows_out": rows_out, "action": "merge"}
            finally:
                rows.unpersist()
        snap = table.snapshot()
        effective = changes.filter(F.col(f"`{change_type_col}`").isin(*UPSERTS, DELETE))
        touched = table.files_holding(effective, keys, snap)
        held = table.read_adds(touched, snap)
        rows = apply_cdc(changes, held, mode=mode, **options)
        feed = None
        if change_feed and dedupe_by_latest_commit:
            feed = _latest_change_rows(held, changes, keys, change_type_col, commit_version_col, commit_timestamp_col)
        elif change_feed:
            feed = _change_rows(held, rows, keys)
        table.replace_files(touched, rows, snap, feed, schema_mode=schema_mode)
        return {"rows_in": rows_in, "rows_out": table.read().count(), "action": "merge", "change_types": sorted(k for k in counts if k is not None), "files_rewritten": len(touched)}
    finally:
        changes.unpersist()


def _change_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """The change feed of a merge without deduplication: rows that came, went or changed, told apart by their keys."""
    columns = [c for c in before.columns if c in after.columns]
    old, new = before.select(*columns), after.select(*columns)
    gone, came = old.exceptAll(new), new.exceptAll(old)
    had, has = gone.select(*keys).distinct(), came.select(*keys).distinct()
    return _labelled(gone.join(has, keys, "left_anti").select(*columns), gone.join(has, keys, "left_semi").select(*columns), came.join(had, keys, "left_semi").select(*columns), came.join(had, keys, "left_anti").select(*columns))


def _latest_change_rows(before: DataFrame, changes: DataFrame, keys: list[str], change_type_col: str, version_col: str, timestamp_col: str) -> DataFrame:
    """The change feed of a merge of each key's last change: only rows of changed keys are looked at."""
    last = latest(changes, keys, version_col, timestamp_col)
    kind = F.col(f"`{change_type_col}`")
    written = without_change_columns(last.filter(kind.isin(*UPSERTS)), change_type_col, version_col, timestamp_col)
    columns = [c for c in before.columns if c in written.columns]
    old, new, deleted = before.select(*columns), written.select(*columns), last.filter(kind == DELETE).select(*keys)
    had = old.select(*keys).distinct()
    return _labelled(old.join(deleted, keys, "left_semi").select(*columns), old.join(new.select(*keys), keys, "left_semi").select(*columns), new.join(had, keys, "left_semi").select(*columns), new.join(had, keys, "left_anti").select(*columns))


def _labelled(deleted: DataFrame, preimages: DataFrame, postimages: DataFrame, inserted: DataFrame) -> DataFrame:
    label = lambda df, kind: df.withColumn(CHANGE_TYPE, F.lit(kind))
    return label(deleted, "delete").unionByName(label(preimages, "update_preimage")).unionByName(label(postimages, "update_postimage")).unionByName(label(inserted, "insert"))
