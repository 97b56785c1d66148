"""Change rows merged into a table.

A change row has keys, a change type and perhaps a commit version or timestamp.
Deduplicated, the latest change of a key decides; a key's order is its commit
version, else its commit timestamp, else arrival.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.union import diagonal
from tidemark.sources.readers import FILE, ROW

# The change types that feeds use.
INSERT, DELETE, PREIMAGE = "insert", "delete", "update_preimage"
UPSERTS = ("insert", "update", "update_postimage")
MODES = ("merge", "append_only")
CHANGE_TYPE, COMMIT_VERSION, COMMIT_TIMESTAMP = "_change_type", "_commit_version", "_commit_timestamp"


def check_changes(changes: DataFrame, keys: list[str], change_type_col: str, mode: str) -> None:
    if not keys:
        raise ValueError("keys must name at least one column")
    lacking = [k for k in keys if k not in changes.columns]
    if lacking:
        raise ValueError(f"changes lack key columns: {lacking}")
    if change_type_col not in changes.columns:
        raise ValueError(f"changes lack the change type column: {change_type_col!r}")
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}: {mode!r}")


def normalised(changes: DataFrame, change_type_col: str, change_type_map: dict[str, str] | None) -> DataFrame:
    """Change types renamed by a map; others stay."""
    if not change_type_map:
        return changes
    pairs = F.create_map(*(F.lit(x) for kv in change_type_map.items() for x in kv))
    kind = F.col(f"`{change_type_col}`")
    return changes.withColumn(change_type_col, F.coalesce(pairs[kind], kind))


def prepared(changes: DataFrame, change_type_col: str, mode: str, ignore_delete: bool, ignore_update_preimage: bool) -> DataFrame:
    """The change rows that can have an effect."""
    kind = F.col(f"`{change_type_col}`")
    if ignore_update_preimage:
        changes = changes.filter(kind != PREIMAGE)
    if ignore_delete:
        changes = changes.filter(kind != DELETE)
    return changes.filter(kind == INSERT) if mode == "append_only" else changes


def latest(changes: DataFrame, keys: list[str], version_col: str = COMMIT_VERSION, timestamp_col: str = COMMIT_TIMESTAMP) -> DataFrame:
    """The last change of each key; null keys count as equal.  Aggregates map-side, so a hot key is one row a task in the shuffle."""
    given = changes.columns
    ordered = FILE in given and ROW in given
    numbered = changes if ordered else changes.withColumn("__arrival", F.monotonically_increasing_id())
    by = [c for c in (version_col, timestamp_col) if c in given][:1]  # a null is less than any other
    row = F.struct(*(F.col(f"`{c}`") for c in given))
    last = F.max_by(row, F.struct(*(F.col(f"`{c}`") for c in [*by, *((FILE, ROW) if ordered else ("__arrival",))])))
    return numbered.groupBy(*(F.col(f"`{k}`").alias(f"__key{i}") for i, k in enumerate(keys))).agg(last.alias("__row")).select("__row.*")


def without_change_columns(df: DataFrame, change_type_col: str, version_col: str, timestamp_col: str) -> DataFrame:
    return df.drop(change_type_col, version_col, timestamp_col, FILE, ROW)


def apply_cdc(
    changes: DataFrame, existing: DataFrame | None = None, *, keys: list[str] | str, change_type_col: str = CHANGE_TYPE, change_type_map: dict[str, str] | None = None, mode: str = "merge",
    ignore_delete: bool = False, ignore_update_preimage: bool = True, dedupe_by_latest_commit: bool = True, commit_version_col: str = COMMIT_VERSION, commit_timestamp_col: str = COMMIT_TIMESTAMP,
    collect_kwargs: dict[str, Any] | None = None,
) -> DataFrame:
    """The table after the changes.

    ``merge`` removes the keys that are deleted or written and appends the written
    rows.  ``append_only`` appends inserts and never looks at existing keys.  Without
    deduplication all upserts are appended; a delete of the same key then undoes
    them only where there is no existing table.  ``collect_kwargs`` is accepted for
    compatibility: the result is a plan, nothing is collected.
    """
    keys = [keys] if isinstance(keys, str) else list(keys or ())
    check_changes(changes, keys, change_type_col, mode)
    changes = prepared(normalised(changes, change_type_col, change_type_map), change_type_col, mode, ignore_delete, ignore_update_preimage)
    if dedupe_by_latest_commit:
        changes = latest(changes, keys, commit_version_col, commit_timestamp_col)
    kind = F.col(f"`{change_type_col}`")
    strip = lambda df: without_change_columns(df, change_type_col, commit_version_col, commit_timestamp_col)
    if mode == "append_only":
        rows = strip(changes)
        return rows if existing is None else diagonal([existing, rows])
    upserts, deletes = strip(changes.filter(kind.isin(*UPSERTS))), changes.filter(kind == DELETE)
    if existing is None:
        return upserts if dedupe_by_latest_commit else upserts.join(deletes.select(*keys).distinct(), keys, "left_anti")
    touched = changes.filter(kind.isin(*UPSERTS, DELETE)).select(*keys).distinct()
    # an anti-join: null keys never match, so rows with null keys stay; AQE broadcasts a small side
    kept = existing.join(touched, keys, "left_anti").select(*existing.columns)
    return diagonal([kept, upserts])
