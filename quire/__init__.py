"""Quire: clean, size-accounted Markdown context from tables of source files, on Spark."""

from quire.operators.change_lists import read_change_lists
from quire.operators.stored_artifacts import unpack_stored
from quire.options import ExportOptions
from quire.plans.export import (
    Export,
    export_changes,
    export_files,
    export_snapshots,
    unpack_files,
)

__all__ = [
    "Export", "ExportOptions", "export_changes", "export_files", "export_snapshots",
    "read_change_lists", "unpack_files", "unpack_stored",
]
