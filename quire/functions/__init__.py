"""Column functions. All are row-local, so they also work on streaming DataFrames."""

from quire.functions.core import bind
from quire.functions.ignore import IgnoreRuleError, IgnoreRules, RuleColumn
from quire.functions.language import language_of, shebang_language
from quire.functions.paths import (
    basename,
    contained_path,
    decode_heading,
    display_path,
    escape_markdown,
    normalize_path,
    path_segments,
    scope_path,
    visible_text,
)
from quire.functions.sensitive import (
    SecretRule,
    default_secret_rules,
    finding_counts,
    first_secret_rule,
    is_sensitive_name,
)
from quire.functions.text import (
    estimate_tokens,
    fence_length,
    is_binary,
    line_count,
    longest_backtick_run,
    number_lines,
    split_lines,
    strip_line_numbers,
    with_final_newline,
)

__all__ = [
    "IgnoreRuleError", "IgnoreRules", "RuleColumn", "SecretRule", "basename", "bind", "contained_path",
    "decode_heading", "default_secret_rules", "display_path", "escape_markdown",
    "estimate_tokens", "fence_length", "finding_counts", "first_secret_rule", "is_binary",
    "is_sensitive_name", "language_of", "line_count", "longest_backtick_run",
    "normalize_path", "number_lines", "path_segments", "scope_path", "shebang_language",
    "split_lines", "strip_line_numbers", "visible_text", "with_final_newline",
]
