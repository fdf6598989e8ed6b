"""Run options, with the same conflict checks for every entry point."""

from __future__ import annotations

from dataclasses import dataclass, field

from quire import constants as C
from quire.functions.ignore import IgnoreRules
from quire.functions.sensitive import SecretRule, default_secret_rules


@dataclass(frozen=True)
class ExportOptions:
    """What to select, reject and print.

    ``mode`` names the selection: ``recursive`` scans everything below ignore rules,
    ``worktree`` and ``stdin`` take given paths, ``staged``, ``unstaged`` and ``diff`` take
    change records. ``generated_at`` is text so that equal inputs give equal artifacts.
    """

    mode: str = "recursive"
    generated_at: str = "1970-01-01T00:00:00Z"
    max_file_bytes: int = C.DEFAULT_MAX_FILE_BYTES
    allow_sensitive: bool = False
    secret_rules: tuple[SecretRule, ...] = field(default_factory=default_secret_rules)
    ignore_lines: tuple[str, ...] = ()
    default_ignore: bool = True
    line_numbers: bool = False
    hunks: bool = False
    hunk_context: int = C.DEFAULT_HUNK_CONTEXT
    unpackable: bool = False
    show_tree: bool = True
    tree_depth: int | None = None
    diff_range: str | None = None
    warn_tokens: int = C.DEFAULT_WARN_TOKENS
    max_tokens: int = 0
    files_begin: str = C.FILES_BEGIN
    files_end: str = C.FILES_END

    def __post_init__(self) -> None:
        if self.mode not in C.MODE_DESCRIPTIONS:
            raise ValueError(f"unknown mode {self.mode!r}")
        if self.hunks and not self.is_delta:
            raise ValueError("hunks need one of the modes staged, unstaged and diff")
        if self.hunks and self.unpackable:
            raise ValueError("an unpackable artifact holds whole files, so it excludes hunks")
        if not self.scans and (self.ignore_lines or not self.default_ignore):
            raise ValueError("ignore rules apply to a scan only")
        if self.diff_range and self.mode != "diff":
            raise ValueError("diff_range belongs to mode diff")
        if self.max_file_bytes <= 0:
            raise ValueError("max_file_bytes must be positive")
        if self.tree_depth is not None and self.tree_depth <= 0:
            raise ValueError("tree_depth must be positive")
        if min(self.hunk_context, self.warn_tokens, self.max_tokens) < 0:
            raise ValueError("hunk_context, warn_tokens and max_tokens must not be negative")

    @property
    def is_delta(self) -> bool:
        return self.mode in C.DELTA_MODES

    @property
    def scans(self) -> bool:
        return self.mode in ("recursive", "auto")

    def ignore_rules(self) -> IgnoreRules:
        return IgnoreRules(self.ignore_lines, self.default_ignore)
