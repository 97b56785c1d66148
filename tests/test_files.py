"""Batches of files: what is new, in which order, within which caps."""

import json
import os

import pytest

from tidemark import FilesSource, FileStreamCheckpoint, SourceSpec, UnsupportedFormatError
from tidemark.plans.files import parse_timestamp, take_capped
from tidemark.sources.base import infer_format


def put(folder, name, size=1, mtime=None):
    folder.mkdir(parents=True, exist_ok=True)
    path = folder / name
    path.write_bytes(b"x" * size)
    if mtime is not None:
        os.utime(path, (mtime, mtime))
    return str(path)


def drain(checkpoint, folder, **options):
    out = []
    while (batch := checkpoint.plan_batch(folder, "*.parquet", **options)) is not None:
        checkpoint.write_offset(batch)
        checkpoint.write_commit(batch)
        out.append([os.path.basename(f) for f in batch.files])
    return out


def test_path_order_and_file_cap(tmp_path):
    for name in "cab":
        put(tmp_path / "in", f"{name}.parquet")
    assert drain(FileStreamCheckpoint(tmp_path / "cp"), tmp_path / "in", max_files=2) == [["a.parquet", "b.parquet"], ["c.parquet"]]


def test_byte_cap_always_takes_one(tmp_path):
    for name, size in (("a", 3), ("b", 5), ("c", 5)):
        put(tmp_path / "in", f"{name}.parquet", size)
    assert drain(FileStreamCheckpoint(tmp_path / "cp"), tmp_path / "in", max_bytes=7) == [["a.parquet"], ["b.parquet"], ["c.parquet"]]
    assert take_capped([9, 1, 1], None, 2, lambda x: x) == [9]


def test_open_batch_is_planned_again(tmp_path):
    put(tmp_path / "in", "a.parquet")
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    first = checkpoint.plan_batch(tmp_path / "in")
    checkpoint.write_offset(first)
    put(tmp_path / "in", "b.parquet")
    again = FileStreamCheckpoint(tmp_path / "cp").plan_batch(tmp_path / "in")
    assert (again.batch_id, again.files) == (first.batch_id, first.files)
    assert [b.batch_id for b in checkpoint.list_pending_batches()] == [0]


def test_offset_is_written_once(tmp_path):
    put(tmp_path / "in", "a.parquet")
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    batch = checkpoint.plan_batch(tmp_path / "in")
    checkpoint.write_offset(batch)
    before = (tmp_path / "cp/offsets/0.json").read_text()
    checkpoint.write_offset(type(batch)(0, ["other"], 1.0))
    assert (tmp_path / "cp/offsets/0.json").read_text() == before


def test_iter_new_files_repeats_until_committed(tmp_path):
    put(tmp_path / "in", "a.parquet")
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    assert checkpoint.iter_new_files(tmp_path / "in") == checkpoint.iter_new_files(tmp_path / "in") != []


@pytest.mark.parametrize("options", [{"start_timestamp": 1005}, {"start_timestamp": "1970-01-01T00:16:45Z"}, {"start_offset": "timestamp", "start_timestamp": "1005"}])
def test_start_timestamp_holds_for_all_batches(tmp_path, options):
    for name, mtime in (("a", 1000), ("b", 1010), ("c", 1020)):
        put(tmp_path / "in", f"{name}.parquet", mtime=mtime)
    assert drain(FileStreamCheckpoint(tmp_path / "cp"), tmp_path / "in", max_files=1, **options) == [["b.parquet"], ["c.parquet"]]
    assert drain(FileStreamCheckpoint(tmp_path / "cp"), tmp_path / "in") == []


def test_start_latest(tmp_path):
    put(tmp_path / "in", "a.parquet", mtime=1000)
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    assert drain(checkpoint, tmp_path / "in", start_offset="latest") == []
    put(tmp_path / "in", "b.parquet", mtime=parse_timestamp("2100-01-01"))
    assert drain(checkpoint, tmp_path / "in", start_offset="latest") == [["b.parquet"]]


def test_start_mode_is_checked_and_stored_one_wins(tmp_path, caplog):
    put(tmp_path / "in", "a.parquet", mtime=1000)
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    with pytest.raises(ValueError):
        checkpoint.plan_batch(tmp_path / "in", start_offset="soon")
    with pytest.raises(ValueError):
        checkpoint.plan_batch(tmp_path / "in", start_offset="timestamp")
    checkpoint.plan_batch(tmp_path / "in", start_timestamp=500)
    with caplog.at_level("WARNING", logger="tidemark"):
        assert checkpoint.plan_batch(tmp_path / "in", start_timestamp=2000) is not None
    assert "ignored" in caplog.text


def test_max_file_age_is_relative_to_the_newest(tmp_path):
    put(tmp_path / "in", "old.parquet", mtime=10_000)
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    assert drain(checkpoint, tmp_path / "in", max_file_age=300) == [["old.parquet"]]
    put(tmp_path / "in", "new.parquet", mtime=20_000)
    put(tmp_path / "in", "older.parquet", mtime=9_000)
    assert drain(checkpoint, tmp_path / "in", max_file_age=300) == [["new.parquet"]]


def test_overwrites(tmp_path):
    put(tmp_path / "in", "a.parquet", 1, 1000)
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    assert drain(checkpoint, tmp_path / "in", allow_overwrites=True) == [["a.parquet"]]
    put(tmp_path / "in", "a.parquet", 2, 1001)
    assert drain(checkpoint, tmp_path / "in") == []
    assert drain(checkpoint, tmp_path / "in", allow_overwrites=True) == [["a.parquet"]]
    assert drain(checkpoint, tmp_path / "in", allow_overwrites=True) == []


def test_crash_between_commit_and_index(tmp_path):
    put(tmp_path / "in", "a.parquet")
    checkpoint = FileStreamCheckpoint(tmp_path / "cp")
    drain(checkpoint, tmp_path / "in")
    put(tmp_path / "in", "b.parquet")
    batch = checkpoint.plan_batch(tmp_path / "in")
    checkpoint.write_offset(batch)
    checkpoint.write("commits", batch.batch_id, {"batch_id": batch.batch_id})
    assert FileStreamCheckpoint(tmp_path / "cp").plan_batch(tmp_path / "in") is None


def test_recursive_and_archive_is_not_read(tmp_path):
    put(tmp_path / "in/sub", "a.parquet")
    spec = FilesSource(tmp_path / "in", recursive=True, clean_source="archive").to_spec()
    source = spec.with_checkpoint(tmp_path / "cp")
    batch = source.plan_batch()
    source.commit_batch(batch)
    assert (tmp_path / "in/_archive/a.parquet").exists()
    put(tmp_path / "in/sub", "a.parquet", 2)
    source2 = FilesSource(tmp_path / "in", recursive=True, clean_source="archive", allow_overwrites=True).to_spec().with_checkpoint(tmp_path / "cp")
    batch = source2.plan_batch()
    source2.commit_batch(batch)
    assert (tmp_path / "in/_archive/a_1.parquet").exists()


def test_delete_cleaning_tolerates_missing(tmp_path):
    path = put(tmp_path / "in", "a.parquet")
    source = FilesSource(tmp_path / "in", clean_source="delete").to_spec().with_checkpoint(tmp_path / "cp")
    batch = source.plan_batch()
    os.unlink(path)
    source.commit_batch(batch)
    assert source.plan_batch() is None
    with pytest.raises(ValueError):
        FilesSource(tmp_path, clean_source="burn").to_spec().with_checkpoint(tmp_path / "cp2")


def test_formats(tmp_path):
    assert infer_format(tmp_path, {}) == "parquet"
    assert infer_format(tmp_path, {"pattern": "*.jsonl"}) == "ndjson"
    assert infer_format("x/y.csv.gz", {}) == "csv"
    assert infer_format(tmp_path, {"file_format": "xlsx"}) == "excel"
    (tmp_path / "t/_delta_log").mkdir(parents=True)
    assert infer_format(tmp_path / "t", {}) == "delta"
    for spec in (SourceSpec("orc", tmp_path), SourceSpec("files", tmp_path, {"file_format": "orc"}), SourceSpec("auto", tmp_path, {"file_format": "orc"})):
        with pytest.raises(UnsupportedFormatError):
            spec.with_checkpoint(tmp_path / "cp")


def test_index_is_sharded(tmp_path):
    for i in range(40):
        put(tmp_path / "in", f"{i}.parquet")
    drain(FileStreamCheckpoint(tmp_path / "cp"), tmp_path / "in")
    shards = list((tmp_path / "cp/file_index").glob("*.json"))
    assert len(shards) > 10 and sum(len(json.loads(s.read_text())) for s in shards) == 40


@pytest.mark.parametrize("scheme", ["", "file:"])
def test_unlike_files_keep_their_columns_off_local_disks(spark, tmp_path, monkeypatch, scheme):
    from tidemark.errors import SchemaEvolutionError
    from tidemark.sources import readers

    spark.range(2).toDF("id").coalesce(1).write.parquet(str(tmp_path / "a"))
    spark.range(2, 4).selectExpr("id", "'x' AS extra").coalesce(1).write.parquet(str(tmp_path / "b"))
    if scheme:
        monkeypatch.setattr(readers, "is_local", lambda path: False)  # as on a store that only Spark reads
    files = [f"{scheme}{tmp_path}/{d}" for d in "ab"]
    rows = readers.read_files(files, relaxed=True)
    assert set(rows.columns) == {"id", "extra"} and sorted((r.id, r.extra) for r in rows.collect()) == [(0, None), (1, None), (2, "x"), (3, "x")]
    with pytest.raises((SchemaEvolutionError, ValueError)):
        readers.read_files(files).count()
