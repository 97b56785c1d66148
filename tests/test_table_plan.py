"""Batches of a table's log, on logs written by hand."""

import json

import pytest

from tidemark import ChangeDataFeedError, DeltaTableCheckpoint
from tidemark.maintenance import cleanup_snapshot_cache, inspect_checkpoint


def log(folder, version, *actions, timestamp=None):
    path = folder / "_delta_log"
    path.mkdir(parents=True, exist_ok=True)
    head = [{"commitInfo": {"timestamp": timestamp}}] if timestamp is not None else []
    (path / f"{version:020d}.json").write_text("\n".join(json.dumps(a) for a in [*head, *actions]))


def add(name, size=1, **more):
    return {"add": {"path": name, "size": size, **more}}


def remove(name, **more):
    return {"remove": {"path": name, **more}}


META = {"metaData": {"id": "t"}}


def step(checkpoint, **options):
    batch = checkpoint.plan_batch(**options)
    if batch is not None:
        checkpoint.write_offset(batch)
        checkpoint.write_commit(batch)
    return batch


def names(batch):
    return [f.rsplit("/", 1)[-1] for f in batch.files]


def test_snapshot_in_parts_then_log(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"), add("p1"))
    log(tmp_path / "t", 1, add("p2"), remove("p0"))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    first, second = step(cp, max_files=1), step(cp, max_files=1)
    assert (names(first), names(second)) == (["p1"], ["p2"])
    assert first.offset.is_initial_snapshot and first.offset.version == 1
    assert step(cp) is None
    log(tmp_path / "t", 2, add("p3"))
    third = step(cp)
    assert names(third) == ["p3"] and not third.offset.is_initial_snapshot


def test_starting_version(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    log(tmp_path / "t", 1, add("p1"))
    batch = step(DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t"), starting_version=1)
    assert names(batch) == ["p1"] and batch.offset.version == 1


def test_removes_need_leave(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    log(tmp_path / "t", 1, add("p1"), remove("p0"))
    for i, options in enumerate(({}, {"ignore_deletes": True})):
        with pytest.raises(RuntimeError):
            cp = DeltaTableCheckpoint(tmp_path / f"cp{i}", tmp_path / "t")
            cp.plan_batch(starting_version=1, **options)
    assert names(step(DeltaTableCheckpoint(tmp_path / "cp9", tmp_path / "t"), starting_version=1, ignore_changes=True)) == ["p1"]


def test_what_precedes_a_remove_is_read(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    log(tmp_path / "t", 1, remove("p0"))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    assert names(step(cp, starting_version=0)) == ["p0"]
    with pytest.raises(RuntimeError):
        cp.plan_batch()


def test_delete_only_version_moves_on(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    log(tmp_path / "t", 1, remove("p0"))
    for i, options in enumerate(({"ignore_deletes": True}, {"ignore_changes": True})):
        cp = DeltaTableCheckpoint(tmp_path / f"cp{i}", tmp_path / "t")
        assert step(cp, starting_version=1, **options).files == []
        assert step(cp, **options) is None


def test_no_data_change(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    log(tmp_path / "t", 1, add("p1", dataChange=False), remove("p0", dataChange=False))
    for i, feed in enumerate((False, True)):
        cp = DeltaTableCheckpoint(tmp_path / f"cp{i}", tmp_path / "t")
        assert step(cp, starting_version=1, read_change_feed=feed).files == []
        assert step(cp, read_change_feed=feed) is None


def test_add_with_a_remove_without_data(tmp_path):
    log(tmp_path / "t", 0, META, add("p1", dataChange=True), remove("p0", dataChange=False))
    assert names(step(DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t"), starting_version=0)) == ["p1"]


def test_latest(tmp_path):
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    assert cp.plan_batch(start_offset="latest") is None
    assert "start_offset" not in cp.metadata()
    log(tmp_path / "t", 0, META, add("p0"))
    assert cp.plan_batch(start_offset="latest") is None
    log(tmp_path / "t", 1, add("p1"))
    assert names(step(cp, start_offset="latest")) == ["p1"]


def test_starting_timestamp(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"), timestamp=1000)
    log(tmp_path / "t", 1, add("p1"), timestamp=2000)
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    assert names(step(cp, starting_timestamp="1970-01-01T00:00:02Z")) == ["p1"]
    assert cp.metadata()["start_offset"] == {"mode": "timestamp", "timestamp": 2.0, "version": 1}
    assert DeltaTableCheckpoint(tmp_path / "cp2", tmp_path / "t").plan_batch(starting_timestamp=9) is None


def test_another_table(tmp_path):
    log(tmp_path / "t", 0, META, add("p0"))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    step(cp)
    log(tmp_path / "t", 0, {"metaData": {"id": "other"}}, add("p0"))
    with pytest.raises(RuntimeError):
        cp.plan_batch()


def test_byte_cap(tmp_path):
    log(tmp_path / "t", 0, META, add("a", 100), add("b", 100))
    assert len(step(DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t"), max_bytes=10).files) == 1


def test_log_caps_resume_in_a_version(tmp_path):
    log(tmp_path / "t", 0, META, add("a"), add("b"), add("c"))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    got = [names(step(cp, starting_version=0, max_files=2)), names(step(cp, max_files=2))]
    assert got == [["a", "b"], ["c"]] and step(cp) is None


def test_feed_takes_whole_versions(tmp_path):
    log(tmp_path / "t", 0, META, {"cdc": {"path": "c0", "size": 1}}, {"cdc": {"path": "c1", "size": 1}}, add("p"), timestamp=5)
    log(tmp_path / "t", 1, add("p1"))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    first, second = step(cp, starting_version=0, read_change_feed=True, max_files=1), step(cp, read_change_feed=True, max_files=1)
    assert (names(first), names(second)) == (["c0", "c1"], ["p1"])
    assert [(e.change_type, e.commit_timestamp) for e in first.file_entries] == [(None, 5), (None, 5)]
    assert second.file_entries[0].change_type == "insert"
    assert step(cp, read_change_feed=True) is None


def test_feed_without_change_data(tmp_path):
    log(tmp_path / "t", 0, META, remove("p"))
    with pytest.raises(ChangeDataFeedError):
        DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t").plan_batch(starting_version=0, read_change_feed=True)


def test_retry_keeps_entries(tmp_path):
    log(tmp_path / "t", 0, META, add("p", partitionValues={"d": "1"}))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t")
    batch = cp.plan_batch()
    cp.write_offset(batch)
    assert DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t").plan_batch() == batch


def test_gap_and_deletion_vector(tmp_path):
    log(tmp_path / "t", 0, META, add("a"))
    log(tmp_path / "t", 2, add("b"))
    with pytest.raises(ValueError):
        DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t").plan_batch()
    log(tmp_path / "u", 0, META, add("a", deletionVector={"storageType": "u"}))
    with pytest.raises(NotImplementedError):
        DeltaTableCheckpoint(tmp_path / "cp2", tmp_path / "u").plan_batch()


def test_snapshot_cache(tmp_path):
    for v in range(25):
        log(tmp_path / "t", v, *([META] if v == 0 else []), add(f"p{v:02d}"), *([remove(f"p{v - 3:02d}")] if v > 3 else []))
    cp = DeltaTableCheckpoint(tmp_path / "cp", tmp_path / "t", snapshot_every=5, snapshots_kept=2)
    for v in (6, 12, 18, 24):
        assert sorted(cp.cache.at(cp.table, v).files) == sorted(cp.table.snapshot(v).files)
    assert inspect_checkpoint(tmp_path / "cp").snapshot_cache_snapshots == 2
    assert cleanup_snapshot_cache(tmp_path / "cp", keep_snapshots=1).removed_offsets == 1
    assert cp.cache.versions() == [24]
