"""What a pipeline tells of its batches."""

from __future__ import annotations

import logging
from typing import Any, Protocol


class PipelineObserver(Protocol):
    def on_batch_planned(self, batch: Any, files: list[str]) -> None: ...

    def on_stage_start(self, stage: str, batch_id: int | None) -> None: ...

    def on_stage_end(self, stage: str, batch_id: int | None, duration_s: float, metadata: dict[str, Any] | None = None) -> None: ...

    def on_batch_committed(self, batch_id: int | None, metadata: dict[str, Any] | None = None) -> None: ...

    def on_error(self, stage: str, batch_id: int | None, exc: Exception) -> None: ...


class LoggingObserver:
    """Writes each event as one line of key=value pairs."""

    def __init__(self, logger: logging.Logger | None = None):
        self.logger = logger or logging.getLogger("tidemark")

    def _line(self, **fields: Any) -> str:
        return " ".join(f"{k}={v}" for k, v in fields.items() if k != "metadata" or v)

    def on_batch_planned(self, batch, files):
        self.logger.info(self._line(event="batch_planned", batch_id=getattr(batch, "batch_id", None), file_count=len(files)))

    def on_stage_start(self, stage, batch_id):
        self.logger.info(self._line(event="stage_start", stage=stage, batch_id=batch_id))

    def on_stage_end(self, stage, batch_id, duration_s, metadata=None):
        self.logger.info(self._line(event="stage_end", stage=stage, batch_id=batch_id, duration_s=duration_s, metadata=metadata))

    def on_batch_committed(self, batch_id, metadata=None):
        self.logger.info(self._line(event="batch_committed", batch_id=batch_id, metadata=metadata))

    def on_error(self, stage, batch_id, exc):
        self.logger.error(self._line(event="error", stage=stage, batch_id=batch_id, error=exc), exc_info=exc)
