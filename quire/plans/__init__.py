"""Whole jobs: scan or selection to artifact, and back."""

from quire.plans.export import Export, export_changes, export_files, export_snapshots, unpack_files

__all__ = ["Export", "export_changes", "export_files", "export_snapshots", "unpack_files"]
