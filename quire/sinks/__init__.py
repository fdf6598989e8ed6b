"""Writing artifacts and reject reports."""

from quire.sinks.artifact import artifact_parts, write_artifacts
from quire.sinks.reports import write_decisions

__all__ = ["artifact_parts", "write_artifacts", "write_decisions"]
