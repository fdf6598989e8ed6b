"""Accept or reject every file, with the reason.

Everything here is row-local. A file's body is read once, never shuffled, and only looked
at when its name, size and path have passed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.core import bind
from quire.functions.ignore import RuleColumn
from quire.functions.language import language_of
from quire.functions.paths import basename, display_path
from quire.functions.sensitive import first_secret_rule, has_secret, is_sensitive_name
from quire.functions.text import fence_length, is_binary, line_count
from quire.options import ExportOptions

#: Column that holds a row's own compiled ignore rules.
OWN_RULES = "_own_rules"


def _rules(options: ExportOptions, own_rules: Column | None):
    return options.ignore_rules() if own_rules is None else RuleColumn(own_rules)


def skip_reason(options: ExportOptions, own_rules: Column | None = None) -> Column:
    """First reason to reject a row of ``files``; null for a file to export.

    The order decides which reason is counted: an oversized ignored file is oversized, but
    nothing is ever looked at below a directory that a walk would not enter. Each costly
    part occurs once in the expression and runs only for rows that got that far. ``own_rules``
    is a column of compiled rules that takes the place of the shared ones.
    """
    content, size, kind, path = F.col("content"), F.col("size"), F.col("kind"), F.col("path")
    at_sight = (
        F.when(kind == "symlink", C.SKIP_SYMLINK)
        .when(kind == "other", C.SKIP_NOT_REGULAR)
        .when(size > options.max_file_bytes, C.SKIP_TOO_LARGE)
    )
    seen = F.col("kind").isin("symlink", "other") | (size > options.max_file_bytes)
    reason = F.when(kind == "unreadable_dir", C.SKIP_UNREADABLE_DIR).when(
        kind == "pruned_dir", C.SKIP_IGNORED
    )
    if options.scans:
        rules = _rules(options, own_rules)
        hidden = rules.pruned_directory(path).isNotNull()
        reason = reason.when(seen, F.when(hidden, C.SKIP_IGNORED).otherwise(at_sight)).when(
            rules.ignored(path), C.SKIP_IGNORED
        )
    else:
        reason = reason.when(seen, at_sight)
    if not options.allow_sensitive:
        reason = reason.when(is_sensitive_name(basename(path)), C.SKIP_SENSITIVE_NAME)

    def of_body(body: Column) -> Column:
        found = (
            F.when(body.isNull(), C.SKIP_UNREADABLE)
            .when(F.octet_length(body) > options.max_file_bytes, C.SKIP_TOO_LARGE)
            .when(F.octet_length(body) == 0, C.SKIP_EMPTY)
            .when(is_binary(body), C.SKIP_BINARY)
        )
        if options.allow_sensitive:
            return found
        return found.when(has_secret(body.cast("string"), options.secret_rules), C.SKIP_SENSITIVE_CONTENT)

    # Bound: a filter on the reason would take a derived body anew for every rule that looks at it.
    return (
        reason.when(kind == "changed", C.SKIP_CHANGED)
        .when(kind == "unreadable", C.SKIP_UNREADABLE)
        .otherwise(bind(content, of_body))
    )


def decide(files: DataFrame, options: ExportOptions) -> DataFrame:
    """``files`` with ``skip_reason``; bodies stay in place.

    Rules attached by :func:`quire.operators.ignore_files.with_own_rules` are used.
    """
    return files.withColumn("skip_reason", skip_reason(options, _own_rules(files)))


def _own_rules(files: DataFrame) -> Column | None:
    return F.col(OWN_RULES) if OWN_RULES in files.columns else None


def decisions(files: DataFrame, options: ExportOptions) -> DataFrame:
    """One row per input file: why it is out, or null, and the rule that found a secret."""
    rule = F.lit(None).cast("string")
    if not options.allow_sensitive:
        rule = F.when(
            F.col("skip_reason") == C.SKIP_SENSITIVE_CONTENT,
            first_secret_rule(F.col("content").cast("string"), options.secret_rules),
        )
    pruned = F.lit(None).cast("string")
    if options.scans:
        pruned = F.when(
            F.col("skip_reason") == C.SKIP_IGNORED,
            _rules(options, _own_rules(files)).pruned_directory(F.col("path")),
        )
    return decide(files, options).select(
        "repo", "path", "size", "skip_reason",
        rule.alias("matched_rule"), pruned.alias("pruned_directory"),
    )


def entries(files: DataFrame, options: ExportOptions) -> DataFrame:
    """Accepted files with everything the artifact prints about them."""
    kept = decide(files, options).filter(F.col("skip_reason").isNull())
    return describe(kept)


def describe(files: DataFrame) -> DataFrame:
    """Language, sizes and fence of text files."""
    text = F.col("content").cast("string")
    return files.select(
        "repo",
        display_path(F.col("path")).alias("path"),
        text.alias("text"),
        F.octet_length(F.col("content")).cast("bigint").alias("n_bytes"),
        language_of(F.col("path"), F.col("content")).alias("lang"),
        line_count(text).alias("total_lines"),
        fence_length(text).alias("fence_len"),
        F.lit("FULL").alias("mode"),
    )


def skip_summary(decided: DataFrame) -> DataFrame:
    """Files per repository and reason; accepted files count as ``accepted``."""
    return decided.groupBy(
        "repo", F.coalesce("skip_reason", F.lit("accepted")).alias("reason")
    ).agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("n_bytes"))


def skip_counters(decided: DataFrame) -> DataFrame:
    """The six counters of a run, per repository.

    A directory that a walk would not enter counts once as ignored, whatever it holds.
    """
    reason = F.col("skip_reason")
    # First collapse each skipped directory to one row; a plain sum then suffices.
    unit = F.when(reason == C.SKIP_IGNORED, F.col("pruned_directory"))
    per_unit = decided.groupBy("repo", unit.alias("_unit"), reason.alias("_reason")).agg(
        F.count(F.lit(1)).alias("_n")
    )

    def total(*reasons: str) -> Column:
        weight = F.when(F.col("_unit").isNotNull(), 1).otherwise(F.col("_n"))
        return F.sum(F.when(F.col("_reason").isin(*reasons), weight).otherwise(0)).cast("bigint")

    return per_unit.groupBy("repo").agg(
        total(C.SKIP_EMPTY, C.SKIP_BINARY).alias("binary_or_empty"),
        total(C.SKIP_TOO_LARGE).alias("too_large"),
        total(C.SKIP_IGNORED).alias("ignored"),
        total(C.SKIP_SYMLINK).alias("symlink"),
        total(C.SKIP_SENSITIVE_NAME, C.SKIP_SENSITIVE_CONTENT).alias("sensitive"),
        total(C.SKIP_UNREADABLE_DIR).alias("unreadable_dirs"),
    )
