"""The batch loop: order of stages, what callables get, retries, errors, observers, the lock."""

import logging
import os

import pytest

from tidemark import (
    CommitError, FilesSource, LoggingObserver, MissingOptionError, Pipeline, PlanningError, ReaderError, SchemaEvolution, SchemaEvolutionError, SourceSpec, TransformError, WriterError, read_files,
)
from tidemark.plans.log import job_lock
from tidemark.streaming.pipeline import call_with_context


def touch(folder, *names):
    folder.mkdir(parents=True, exist_ok=True)
    for n in names:
        (folder / f"{n}.parquet").write_bytes(b"x")
    return FilesSource(folder, max_files_per_trigger=1)


def job(tmp_path, source, **options):
    options = {"reader": lambda files: files, "writer": lambda data: None} | options
    return Pipeline(source, tmp_path / "cp", options.pop("reader"), options.pop("writer"), **options)


def test_once_and_all(tmp_path):
    source, seen = touch(tmp_path / "in", "a", "b", "c"), []
    pipeline = job(tmp_path, source, writer=lambda data, batch_id: seen.append((batch_id, len(data))))
    assert pipeline.run().batches == 1
    assert pipeline.run(once=False, sleep=0, max_batches=1).batches == 1
    assert pipeline.run(once=False, sleep=0, max_idle_loops=1).batches == 1
    assert pipeline.run().batches == 0
    assert seen == [(0, 1), (1, 1), (2, 1)]


def test_failed_write_is_run_again_with_the_same_files(tmp_path):
    source, tries = touch(tmp_path / "in", "a"), []

    def writer(data, batch_id):
        tries.append((batch_id, tuple(data)))
        if len(tries) == 1:
            raise ValueError("disk full")
        return {"rows": 1}

    pipeline = job(tmp_path, source, writer=writer)
    with pytest.raises(WriterError) as e:
        pipeline.run()
    assert isinstance(e.value.__cause__, ValueError) and "batch_id=0" in str(e.value)
    touch(tmp_path / "in", "b")
    assert pipeline.run().batches == 1 and tries[0] == tries[1]
    commits = list((tmp_path / "cp/commits").glob("*.json"))
    assert [c.name for c in commits] == ["0.json"] and '"rows": 1' in commits[0].read_text()


@pytest.mark.parametrize(("stage", "error"), [("reader", ReaderError), ("transform", TransformError), ("writer", WriterError)])
def test_stage_errors(tmp_path, stage, error):
    def fail(data):
        raise KeyError("x")

    with pytest.raises(error):
        job(tmp_path, touch(tmp_path / "in", "a"), **{stage: fail}).run()


def test_own_errors_pass(tmp_path):
    def fail(data):
        raise SchemaEvolutionError("x")

    with pytest.raises(SchemaEvolutionError):
        job(tmp_path, touch(tmp_path / "in", "a"), transform=fail).run()


def test_planning_and_commit_errors(tmp_path, monkeypatch):
    with pytest.raises(PlanningError):
        job(tmp_path, FilesSource(tmp_path, start_offset="soon")).run()
    from tidemark.plans.files import FileStreamCheckpoint

    monkeypatch.setattr(FileStreamCheckpoint, "write_commit", lambda *a: 1 / 0)
    with pytest.raises(CommitError):
        job(tmp_path, touch(tmp_path / "in", "a")).run()


def test_missing_callables_and_wrong_source(tmp_path):
    with pytest.raises(MissingOptionError):
        Pipeline(FilesSource(tmp_path), tmp_path / "cp", None, print).run()
    with pytest.raises(TypeError):
        Pipeline("path", tmp_path / "cp", print, print).run()


CONTEXT = {"batch": "B", "batch_id": 7, "files": ["f"], "state": "S"}


def test_context_by_signature():
    assert call_with_context(lambda data: data, "d", CONTEXT) == "d"
    assert call_with_context(lambda data, batch: (data, batch), "d", CONTEXT) == ("d", "B")
    assert call_with_context(lambda data, _batch_id: (data, _batch_id), "d", CONTEXT) == ("d", 7)
    assert call_with_context(lambda data, *, state, files: (data, state, files), "d", CONTEXT) == ("d", "S", ["f"])
    assert call_with_context(lambda *, data, batch_id: (data, batch_id), "d", CONTEXT) == ("d", 7)
    assert call_with_context(lambda data, **kw: sorted(kw), "d", CONTEXT) == ["batch", "batch_id", "files", "state"]
    assert call_with_context(len, "abc", CONTEXT) == 3
    reader = {k: v for k, v in CONTEXT.items() if k != "files"}
    assert call_with_context(lambda files, batch_id: (files, batch_id), ["f"], reader) == (["f"], 7)
    assert call_with_context(lambda *, files: files, ["f"], reader) == ["f"]
    with pytest.raises(TypeError):
        call_with_context(lambda data, other: other, "d", CONTEXT)


class Events:
    def __init__(self):
        self.seen = []

    def __getattr__(self, name):
        return lambda *args: self.seen.append((name, *args))


def test_observer_sees_every_stage(tmp_path):
    events = Events()
    job(tmp_path, touch(tmp_path / "in", "a"), observer=events, transform=lambda d: d, writer=lambda d: {"n": 1}).run()
    starts = [e[1] for e in events.seen if e[0] == "on_stage_start"]
    ends = {e[1]: e[4] for e in events.seen if e[0] == "on_stage_end"}
    assert starts == ["plan", "reader", "transform", "writer", "commit"]
    assert ends["plan"] == {"has_batch": True} and ends["reader"] == {"file_count": 1} and ends["writer"] == {"n": 1}
    assert events.seen[-1] == ("on_batch_committed", 0, {"n": 1})


def test_observer_sees_errors_and_logs(tmp_path, caplog):
    with caplog.at_level(logging.INFO, logger="tidemark"), pytest.raises(ReaderError):
        job(tmp_path, touch(tmp_path / "in", "a"), observer=LoggingObserver(), reader=lambda f: 1 / 0).run()
    assert "event=stage_start stage=plan" in caplog.text and "event=error stage=reader" in caplog.text


def test_lock(tmp_path, monkeypatch):
    with job_lock(tmp_path):
        monkeypatch.setattr(os, "getpid", lambda: 1)
        with pytest.raises(RuntimeError), job_lock(tmp_path):
            pass
        with pytest.raises(RuntimeError), job_lock(tmp_path, timeout=0.05):
            pass
        monkeypatch.setenv("TIDEMARK_DISABLE_LOCK", "1")
        with job_lock(tmp_path):
            pass
    assert not (tmp_path / ".pipeline.lock").exists()


def test_abandoned_locks_are_taken(tmp_path):
    lock = tmp_path / ".pipeline.lock"
    lock.write_text("host=elsewhere\npid=1\nacquired_at=1\n")
    with pytest.raises(RuntimeError), job_lock(tmp_path):
        pass
    with job_lock(tmp_path, stale=60):
        assert "elsewhere" not in lock.read_text()
    import socket

    lock.write_text(f"host={socket.gethostname()}\npid=99999999\nacquired_at=99999999999\n")
    with job_lock(tmp_path):
        pass


def test_schema_is_stored_with_the_commit(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "stage"))
    (tmp_path / "in").mkdir()
    os.rename(next((tmp_path / "stage").glob("*.parquet")), tmp_path / "in/a.parquet")
    source, fail = FilesSource(tmp_path / "in"), [True]

    def writer(df):
        if fail.pop() if fail else False:
            raise ValueError("x")

    pipeline = Pipeline(source, tmp_path / "cp", read_files, writer, schema_evolution=SchemaEvolution("strict"))
    with pytest.raises(WriterError):
        pipeline.run()
    assert "schema" not in (tmp_path / "cp/metadata.json").read_text()
    assert pipeline.run().batches == 1
    assert "schema" in (tmp_path / "cp/metadata.json").read_text()


def test_a_source_without_reader_support_is_named(tmp_path):
    with pytest.raises(Exception, match="orc"):
        Pipeline(SourceSpec("orc", tmp_path), tmp_path / "cp", print, print).run()
