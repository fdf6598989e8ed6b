"""Whole export jobs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from quire.operators import changes as change_ops
from quire.operators import delta, hunks as hunk_ops
from quire.operators.decisions import decisions, describe, entries, skip_counters
from quire.operators.ignore_files import compile_ignore_files, with_own_rules
from quire.operators.metrics import artifact_metrics, require_budget, within_budget
from quire.operators.render import block_sizes, blocks, frame_blocks
from quire.operators.scale import narrow_by_keys, stored, without_keys
from quire.operators.selection import distinct_changes, one_per_path, select_files, shown_paths
from quire.operators.unpack import STATUS_OK, unpack
from quire.options import ExportOptions
from quire.sinks.artifact import artifact_parts, write_artifacts


@dataclass(frozen=True)
class Export:
    """Results of one export: what was looked at, and everything derived from it.

    The first use of ``blocks`` runs a job that stores the shown paths.
    """

    options: ExportOptions
    repos: DataFrame
    chosen: DataFrame
    entries: DataFrame
    changes: DataFrame | None = None
    #: ``(repo, rule_error)`` of repositories left out because their ignore file cannot be used.
    rule_errors: DataFrame | None = None

    @cached_property
    def decisions(self) -> DataFrame:
        return decisions(self.chosen, self.options)

    @cached_property
    def frame(self) -> DataFrame:
        """All blocks but those of files."""
        return frame_blocks(self.repos, self.entries, self.options, self.changes)

    @cached_property
    def blocks(self) -> DataFrame:
        return blocks(self.frame, self.entries, self.options)

    @cached_property
    def sizes(self) -> DataFrame:
        """Place and size of every block; files are measured, not printed."""
        return block_sizes(self.frame, self.entries, self.options)

    @property
    def counters(self) -> DataFrame:
        return skip_counters(self.decisions)

    @cached_property
    def metrics(self) -> DataFrame:
        return artifact_metrics(self.sizes, self.options)

    def parts(self, part_bytes: int | None = None) -> DataFrame:
        extra = {} if part_bytes is None else {"part_bytes": part_bytes}
        return artifact_parts(self.blocks, self.options, sizes=self.sizes, **extra)

    def write(self, location: str, by_repo: bool = True, mode: str = "errorifexists",
              strict: bool = False, partitions: int | None = None) -> None:
        """Write the artifacts within the token budget.

        ``strict`` writes nothing at all when any artifact is over it. Sizes are only summed
        up beforehand when there is a budget.
        """
        chosen = self.blocks
        if self.options.max_tokens:
            measured = stored(self.metrics)
            if strict:
                require_budget(measured)
            chosen = within_budget(chosen, measured)
        write_artifacts(chosen, location, by_repo, mode, partitions, self.sizes)


def export_files(
    files: DataFrame,
    options: ExportOptions,
    selected: DataFrame | None = None,
    ignore_files: DataFrame | None = None,
) -> Export:
    """Export scanned files, or those named by ``selected`` ``(repo, path)``.

    ``ignore_files`` ``(repo, text)`` adds each repository's own ignore file to a scan;
    :func:`quire.operators.ignore_files.root_ignore_files` takes them from ``files``.
    A repository whose ignore file has an invalid rule gets no artifact, as files meant to stay out
    could not be told; ``rule_errors`` names it. A path that occurs several times counts once, as
    :func:`quire.operators.selection.one_per_path` chooses.
    """
    if options.is_delta:
        raise ValueError("use export_changes or export_snapshots for delta modes")
    if options.scans == (selected is not None):
        raise ValueError(f"mode {options.mode} {'takes no' if options.scans else 'needs'} paths")
    if ignore_files is not None and not options.scans:
        raise ValueError("ignore files apply to a scan only")
    compiled = errors = None
    if ignore_files is not None:
        compiled = stored(compile_ignore_files(ignore_files, options))
        errors = compiled.filter("rule_error IS NOT NULL").select("repo", "rule_error")
        files = without_keys(files, errors, ["repo"])
    files = one_per_path(files)
    repos = files.select("repo").distinct()
    chosen = files if selected is None else select_files(files, selected)
    if ignore_files is not None:
        chosen = with_own_rules(chosen, ignore_files, options, compiled=compiled)
    accepted = entries(chosen, options)
    return Export(options, repos, chosen, accepted, rule_errors=errors)


def export_changes(
    files: DataFrame,
    changes: DataFrame,
    options: ExportOptions,
    hunks: DataFrame | None = None,
) -> Export:
    """Export changed files, whole or, with ``options.hunks``, as changed lines.

    ``files`` is the state to print. Change records of rejected files are left out; those of
    files without a visible range stay listed. A leading ``./`` does not matter on any side, and a path
    that occurs several times counts once.
    """
    if options.hunks and hunks is None:
        raise ValueError("hunks are switched on but not given")
    wanted = stored(change_ops.export_changes(distinct_changes(shown_paths(changes))))
    return _export_wanted(one_per_path(files), wanted, options, lambda *_: shown_paths(hunks))


def _export_wanted(
    files: DataFrame, wanted: DataFrame, options: ExportOptions,
    hunks_of: Callable[[DataFrame, DataFrame], DataFrame],
) -> Export:
    """``wanted`` holds distinct change records and is stored.

    ``hunks_of`` gets the accepted files and their change records, so no body is judged a second time for its hunks.
    """
    key = ["repo", "path"]
    repos = files.select("repo").distinct()
    chosen = narrow_by_keys(files, wanted, key)
    listed = stored(change_ops.surviving_changes(wanted, entries(chosen, options)))
    # From here on the accepted files are known by path.
    accepted = describe(narrow_by_keys(files, listed, key))
    if options.hunks:
        ranges = stored(hunk_ops.file_ranges(hunks_of(accepted, listed), accepted, options.hunk_context))
        accepted = hunk_ops.with_render_mode(accepted, listed, ranges)
    return Export(options, repos, chosen, accepted, listed)


def export_snapshots(base: DataFrame, head: DataFrame, options: ExportOptions) -> Export:
    """Export what changed from ``base`` to ``head``, both ``files`` tables."""
    if not options.is_delta:
        raise ValueError("comparing snapshots needs one of the modes staged, unstaged and diff")
    base, head = one_per_path(base), one_per_path(head)
    changes = stored(delta.snapshot_changes(base, head))

    def hunks_of(accepted: DataFrame, listed: DataFrame) -> DataFrame:
        modified = listed.filter("change_type <> 'A'")
        after = narrow_by_keys(accepted, modified, ["repo", "path"])
        old_paths = modified.selectExpr("repo", "coalesce(previous_path, path) AS path")
        before = narrow_by_keys(base, old_paths, ["repo", "path"])
        return delta.line_hunks(delta.changed_pairs(before, after, modified))

    return _export_wanted(head, changes, options, hunks_of)


def unpack_files(artifacts: DataFrame, options: ExportOptions | None = None) -> DataFrame:
    """Readable files of artifacts as ``(repo, path, text)`` with contained paths."""
    markers = options or ExportOptions()
    rows = unpack(artifacts, markers.files_begin, markers.files_end)
    return rows.filter(rows.status == STATUS_OK).selectExpr("repo", "safe_path AS path", "text")
