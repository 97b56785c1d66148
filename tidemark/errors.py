"""Errors, by what failed."""


class TidemarkError(Exception):
    """Any error of this package's own."""


class PipelineError(TidemarkError):
    """A stage of a pipeline failed; ``__cause__`` is what it raised."""


class PlanningError(PipelineError):
    """No batch could be planned."""


class ReaderError(PipelineError):
    """The reader failed."""


class TransformError(PipelineError):
    """The transform failed."""


class WriterError(PipelineError):
    """The writer failed."""


class CommitError(PipelineError):
    """The batch was written but could not be committed."""


class UnsupportedFormatError(TidemarkError):
    """A format that is not known, or whose reader is not installed."""


class MissingOptionError(TidemarkError):
    """An option that is needed is not given."""


class ChangeDataFeedError(TidemarkError):
    """A table has no change feed for a version that needs one."""


class SchemaEvolutionError(TidemarkError):
    """A batch breaks the schema rules."""
