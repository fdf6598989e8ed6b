"""Ignore rules that each repository brings along in its own ignore file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.ignore import RULE_LIST, IgnoreRuleError, compiled_rules
from quire.functions.paths import display_path
from quire.operators.decisions import OWN_RULES
from quire.operators.scale import HOT_KEY_ROWS, hot_key_join, hot_keys, stored
from quire.options import ExportOptions

#: Rule texts up to this size in total are broadcast; beyond it they are joined by shuffle.
BROADCAST_RULE_BYTES = 32 * 1024 * 1024


def root_ignore_files(files: DataFrame, name: str = ".gitignore") -> DataFrame:
    """``(repo, text)`` of the ignore file at the root of each repository.

    Only the root file counts. The path filter reaches the scan.
    """
    return files.filter(display_path(F.col("path")) == name).filter(F.col("kind") == "file").select(
        "repo", F.col("content").cast("string").alias("text")
    )


def compile_ignore_files(ignore_files: DataFrame, options: ExportOptions) -> DataFrame:
    """``(repo, text)`` to ``(repo, rules, rule_error)``, one row per repository.

    The shared rules of ``options`` come first. A file with an empty rule is not used in part:
    its repository gets the shared rules only, and ``rule_error`` names the rule.
    """
    lines, use_defaults = options.ignore_lines, options.default_ignore

    def compiled(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            try:
                rows.append((compiled_rules(text, lines, use_defaults), None))
            except IgnoreRuleError as error:
                rows.append((compiled_rules(None, lines, use_defaults), str(error)))
        return pd.DataFrame(rows, columns=["rules", "rule_error"])

    compile_text = F.pandas_udf(compiled, f"struct<rules:{RULE_LIST},rule_error:string>")
    return ignore_files.select("repo", compile_text(F.col("text")).alias("c")).select("repo", "c.*")


def with_own_rules(
    files: DataFrame,
    ignore_files: DataFrame,
    options: ExportOptions,
    broadcast_bytes: int = BROADCAST_RULE_BYTES,
    min_hot_rows: int = HOT_KEY_ROWS,
    compiled: DataFrame | None = None,
) -> DataFrame:
    """``files`` with the compiled rules of their repository.

    Repositories without an ignore file get the shared rules. The rule texts are measured
    first: a small table is broadcast and file bodies do not move; a large one is joined by
    repository, with repositories of a million files or more split over many tasks. ``compiled``
    is the stored result of :func:`compile_ignore_files` where the caller has it already.
    """
    if compiled is None:
        compiled = stored(compile_ignore_files(ignore_files, options))
    rules = compiled.select(
        "repo", F.col("rules").alias(OWN_RULES)
    )
    size = rules.select(
        F.sum(F.aggregate(OWN_RULES, F.lit(64), lambda n, r: n + 64 + 2 * F.octet_length(r["match"])))
    ).head()[0] or 0
    if size <= broadcast_bytes:
        joined = files.join(F.broadcast(rules), ["repo"], "left")
    else:
        hot = hot_keys(files, ["repo"], files.count(), min_hot_rows)
        joined = hot_key_join(files, rules, ["repo"], hot, F.col("path"), "left")
    shared = F.from_json(F.lit(_shared_json(options)), RULE_LIST)
    return joined.withColumn(OWN_RULES, F.coalesce(OWN_RULES, shared))


def _shared_json(options: ExportOptions) -> str:
    names = ("negated", "dir_only", "path_match", "match", "below")
    rules = compiled_rules(None, options.ignore_lines, options.default_ignore)
    return pd.Series([dict(zip(names, rule, strict=True)) for rule in rules], dtype=object).to_json(
        orient="values"
    )
