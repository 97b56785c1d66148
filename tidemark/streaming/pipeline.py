"""The batch loop: plan, read, fit the schema, transform, write, commit.

A batch's offset is logged before it is read and its commit after it is written; a
batch that fails in between is run again with the same inputs (at least once).
The schema that a batch taught is stored with its commit.
"""

from __future__ import annotations

import inspect
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tidemark.errors import CommitError, MissingOptionError, PlanningError, ReaderError, TidemarkError, TransformError, WriterError
from tidemark.fs import local_path
from tidemark.operators.schema import SchemaEvolution
from tidemark.plans.log import job_lock
from tidemark.sources.base import Source, SourceConfig, SourceSpec
from tidemark.streaming.observe import PipelineObserver
from tidemark.streaming.state import JobState


@dataclass(frozen=True)
class RunResult:
    batches: int


_STAGE_ERRORS = {"plan": PlanningError, "reader": ReaderError, "schema": None, "transform": TransformError, "writer": WriterError, "commit": CommitError}


def call_with_context(function: Callable[..., Any], payload: Any, context: dict[str, Any]) -> Any:
    """Call with the payload and what the signature asks for of the context.

    Context goes by keyword to parameters of its names (all of it to ``**kwargs``).
    A second positional parameter named ``batch`` or ``batch_id`` (leading underscores
    allowed) gets that.  A function of keyword-only parameters gets the payload in
    its only parameter that is no context, else as ``files`` if it is the reader's.
    """
    try:
        parameters = list(inspect.signature(function).parameters.values())
    except (TypeError, ValueError):
        return function(payload)
    kinds = inspect.Parameter
    any_keyword = any(p.kind is kinds.VAR_KEYWORD for p in parameters)
    positional = [p for p in parameters if p.kind in (kinds.POSITIONAL_ONLY, kinds.POSITIONAL_OR_KEYWORD)]
    by_name = {p.name for p in parameters if p.kind in (kinds.POSITIONAL_OR_KEYWORD, kinds.KEYWORD_ONLY)}
    first = positional[0].name if positional else None
    wanted = {k: v for k, v in context.items() if (any_keyword or k in by_name) and k != first}
    if positional or any(p.kind is kinds.VAR_POSITIONAL for p in parameters):
        if not wanted and len(positional) > 1 and (name := positional[1].name.lstrip("_")) in ("batch", "batch_id"):
            return function(payload, context[name])
        return function(payload, **wanted)
    free = [n for n in by_name if n not in ("batch", "batch_id", "files", "state")]
    if "files" in by_name and "files" not in context:
        wanted["files"] = payload
    elif len(free) == 1:
        wanted[free[0]] = payload
    return function(**wanted)


@dataclass(frozen=True)
class Pipeline:
    """A stream from a source through callables; see ``run``."""

    source: SourceSpec | SourceConfig
    checkpoint_dir: Any
    reader: Callable[..., Any] | None
    writer: Callable[..., Any] | None
    transform: Callable[..., Any] | None = None
    schema_evolution: SchemaEvolution | None = None
    observer: PipelineObserver | None = None
    skip_empty: bool = False

    def run(self, *, once: bool = True, sleep: float = 1.0, max_batches: int | None = None, sleep_when_idle: float | None = None, max_idle_loops: int | None = None) -> RunResult:
        """Run one batch, or with ``once=False`` batch after batch until a limit is reached.

        ``skip_empty`` commits batches without files without calling anything.
        """
        if self.reader is None or self.writer is None:
            raise MissingOptionError("a pipeline needs a reader and a writer")
        spec = self.source.to_spec() if hasattr(self.source, "to_spec") else self.source
        if not isinstance(spec, SourceSpec):
            raise TypeError("source must be a SourceSpec or have to_spec()")
        source = spec.with_checkpoint(self.checkpoint_dir)
        root = local_path(self.checkpoint_dir).rstrip("/")
        state = JobState(f"{root}/state")
        with job_lock(root):
            done = idle = 0
            while True:
                if self._one(source, state):
                    done, idle = done + 1, 0
                    if once or max_batches is not None and done >= max_batches:
                        break
                    pause = sleep
                else:
                    idle += 1
                    if once or max_idle_loops is not None and idle >= max_idle_loops:
                        break
                    pause = sleep if sleep_when_idle is None else sleep_when_idle
                if pause > 0:
                    time.sleep(pause)
        return RunResult(done)

    def _one(self, source: Source, state: JobState) -> bool:
        batch = self._stage("plan", None, source.plan_batch, lambda b: {"has_batch": b is not None})
        if batch is None:
            return False
        files, batch_id = list(batch.files), batch.batch_id
        self._tell("on_batch_planned", batch, files)
        metadata: Any = {}
        schema = None
        if files or not self.skip_empty:
            context = {"batch": batch, "batch_id": batch_id, "state": state.at(batch_id)}
            data = self._stage("reader", batch_id, lambda: call_with_context(self.reader, files, context), lambda _: {"file_count": len(files)})
            context["files"] = files
            if self.schema_evolution is not None:
                data, schema = self._stage("schema", batch_id, lambda: self.schema_evolution.plan(data, source.checkpoint))
            if self.transform is not None:
                data = self._stage("transform", batch_id, lambda: call_with_context(self.transform, data, context))
            result = self._stage("writer", batch_id, lambda: call_with_context(self.writer, data, context), lambda r: r if isinstance(r, dict) else None)
            metadata = result if isinstance(result, dict) else None
        self._stage("commit", batch_id, lambda: self._commit(source, batch, metadata or None, schema), lambda _: metadata or None)
        self._tell("on_batch_committed", batch_id, metadata or None)
        return True

    @staticmethod
    def _commit(source: Source, batch: Any, metadata: dict | None, schema: list[dict] | None) -> None:
        if schema is not None:
            source.checkpoint.save_schema(schema)
        source.commit_batch(batch, metadata)

    def _tell(self, event: str, *args: Any) -> None:
        if self.observer is not None:
            getattr(self.observer, event)(*args)

    def _stage(self, name: str, batch_id: int | None, work: Callable[[], Any], describe: Callable[[Any], dict | None] = lambda _: None) -> Any:
        self._tell("on_stage_start", name, batch_id)
        began = time.monotonic()
        try:
            out = work()
        except Exception as e:
            self._tell("on_error", name, batch_id, e)
            kind = _STAGE_ERRORS[name]
            if kind is None or isinstance(e, TidemarkError):
                raise
            raise kind(f"{name} failed for batch_id={batch_id}") from e
        self._tell("on_stage_end", name, batch_id if name != "plan" or out is None else out.batch_id, time.monotonic() - began, describe(out))
        return out
