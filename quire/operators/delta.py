"""Comparing two snapshots: changed files, renames and changed lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from quire.functions.lines import changed_ranges
from quire.operators.renames import similar_renames
from quire.operators.scale import running, stored


def _digests(files: DataFrame, name: str) -> DataFrame:
    # The digest is taken where the body is read; only 64 bytes per file are shuffled.
    return files.select("repo", "path", F.sha2("content", 256).alias(name))


def path_delta(base: DataFrame, head: DataFrame) -> DataFrame:
    """Paths that differ: ``A`` added, ``M`` modified, ``D`` deleted, with both digests."""
    old, new = F.col("base_sha"), F.col("head_sha")
    return (
        _digests(base, "base_sha")
        .join(_digests(head, "head_sha"), ["repo", "path"], "full_outer")
        .filter(~old.eqNullSafe(new))
        .withColumn(
            "change_type", F.when(old.isNull(), "A").when(new.isNull(), "D").otherwise("M")
        )
    )


def exact_renames(delta: DataFrame) -> DataFrame:
    """Deleted and added paths with equal content, paired in path order.

    ``delta`` comes from :func:`path_delta` and should be stored, as it is read twice.

    The n-th deleted copy of a content goes with the n-th added copy, so a content with
    millions of copies yields as many pairs as there are copies, not their product. The
    positions come from a distributed count.
    """

    kind = F.col("change_type")
    moved = delta.filter(kind.isin("A", "D")).select(
        "repo", F.coalesce("base_sha", "head_sha").alias("sha"), "change_type", "path"
    )
    placed = running(moved, ["repo", "sha", "change_type"], ["path"], row_no="_n")
    deleted = placed.filter(kind == "D").withColumnRenamed("path", "previous_path")
    added = placed.filter(kind == "A")
    return added.drop("change_type").join(
        deleted.drop("change_type"), ["repo", "sha", "_n"]
    ).select("repo", "path", F.lit("R").alias("change_type"), "previous_path")


def snapshot_changes(base: DataFrame, head: DataFrame, renames: bool = True, similar: bool = True) -> DataFrame:
    """Change records from ``base`` to ``head``; deletions are not exported.

    With ``renames``, deleted and added paths of equal content are one record each, and with ``similar`` also those
    that share at least half of their lines.
    """
    # Stored: renames read it twice more, and only paths and digests are in it.
    delta = stored(path_delta(base, head)) if renames else path_delta(base, head)
    plain = delta.filter(F.col("change_type").isin("A", "M")).select(
        "repo", "path", "change_type", F.lit(None).cast("string").alias("previous_path")
    )
    if not renames:
        return plain
    renamed = exact_renames(delta)
    if similar:
        renamed = stored(renamed)
        renamed = renamed.unionByName(similar_renames(base, head, delta, renamed).drop("score"))
    return plain.join(renamed.select("repo", "path"), ["repo", "path"], "left_anti").unionByName(
        renamed
    )


@F.pandas_udf(ArrayType(ArrayType(LongType())))
def _changed_ranges(base: pd.Series, head: pd.Series) -> pd.Series:
    return pd.Series([changed_ranges(b, h) for b, h in zip(base, head, strict=True)])


def line_hunks(pairs: DataFrame) -> DataFrame:
    """Changed line ranges of modified files, on the new side.

    ``pairs`` is ``(repo, path, base_text, head_text)``. The lines that stay are a longest common subsequence of
    both texts, so the ranges hold as few lines as any diff can, moved and repeated lines included; which one is chosen
    is stated in :func:`quire.functions.lines.kept_lines`. Runs of new lines become ``(start, count)``; a pure deletion
    becomes ``(line before it, 0)``. A last line without a newline differs from one with it.

    Both sides of a file travel in one row and are compared within it, so nothing is shuffled. No column
    expression finds a longest common subsequence, so this runs in Arrow batches.
    """
    found = pairs.select(
        "repo", "path", F.explode(_changed_ranges("base_text", "head_text")).alias("range"))
    return found.select("repo", "path", F.col("range")[0].alias("new_start"), F.col("range")[1].alias("new_count"))


def changed_pairs(base: DataFrame, head_entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Old and new text of modified and renamed files, ready for :func:`line_hunks`."""
    kept = changes.filter(F.col("change_type").isin("M", "R")).select(
        "repo", "path", F.coalesce("previous_path", "path").alias("_old")
    )
    old = base.select(
        "repo", F.col("path").alias("_old"), F.col("content").cast("string").alias("base_text")
    )
    new = head_entries.select("repo", "path", F.col("text").alias("head_text"))
    return kept.join(new, ["repo", "path"]).join(old, ["repo", "_old"]).drop("_old")
