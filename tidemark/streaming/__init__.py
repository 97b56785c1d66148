"""Running a stream: the batch loop, its state, its observers, and Structured Streaming forms."""

from tidemark.streaming.observe import LoggingObserver, PipelineObserver
from tidemark.streaming.pipeline import Pipeline, RunResult
from tidemark.streaming.state import JobState

__all__ = ["JobState", "LoggingObserver", "Pipeline", "PipelineObserver", "RunResult"]
