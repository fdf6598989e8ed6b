"""Selecting files by given paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.ignore import IgnoreRules
from quire.functions.paths import display_path, scope_path
from quire.operators.scale import narrow_by_keys, stored, without_keys


def path_records(blob: Column, null_delimited: bool = False) -> Column:
    """Array of the non-empty records of a path list.

    Newline lists lose one carriage return per record; the last record may be open.
    """
    records = F.split(blob, "\0" if null_delimited else "\n", -1)
    if not null_delimited:
        records = F.transform(records, lambda r: F.regexp_replace(r, r"\r\z", ""))
    return F.filter(records, lambda r: r != "")


def parse_path_lists(lists: DataFrame, null_delimited: bool = False) -> DataFrame:
    """``(repo, blob)`` lists to distinct ``(repo, path)`` rows."""
    return (
        lists.select("repo", F.explode(path_records(F.col("blob"), null_delimited)).alias("path"))
        .distinct()
    )


def select_files(files: DataFrame, selected: DataFrame) -> DataFrame:
    """Files named by ``selected``; missing and repeated names have no effect.

    A leading ``./`` on either side does not matter.
    """
    wanted = selected.select("repo", display_path(F.col("path")).alias("_shown")).distinct()
    return (
        files.withColumn("_shown", display_path(F.col("path")))
        .join(wanted, ["repo", "_shown"], "left_semi")
        .drop("_shown")
        .select(*files.columns)
    )


def shown_paths(rows: DataFrame) -> DataFrame:
    """Rows with paths, and previous paths, as an artifact shows them: without a leading ``./``."""
    names = [c for c in ("path", "previous_path") if c in rows.columns]
    return rows.withColumns({c: display_path(F.col(c)) for c in names})


def one_per_path(files: DataFrame) -> DataFrame:
    """``files`` under their shown paths, one row per repository and path.

    Of rows that share a shown path the one whose path needs no change stays, then the one of the
    first kind by name, the smallest and the one with the first digest; equal rows become one.
    Only paths are counted first. Where none is repeated, which is usual, bodies stay in place;
    otherwise only the repeated rows move, and partial aggregation leaves one per key and task.
    """
    key = ["repo", "path"]
    shown = shown_paths(files)
    counts = shown.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    repeated = stored(counts.filter("_n > 1").select(*key))
    if repeated.isEmpty():
        return shown
    rank = F.struct(
        (F.col("path") != display_path(F.col("path"))).alias("changed"), F.col("kind"), F.col("size"),
        F.sha2("content", 256).alias("digest"))
    ranked = files.select(*shown.columns, rank.alias("_rank")).withColumn("path", display_path(F.col("path")))
    rest = [c for c in shown.columns if c not in key]
    chosen = (
        narrow_by_keys(ranked, repeated, key)
        .groupBy(*key).agg(F.min_by(F.struct(*rest), "_rank").alias("_file"))
        .select(*key, "_file.*").select(*shown.columns))
    return without_keys(shown, repeated, key).unionByName(chosen)


def distinct_changes(changes: DataFrame) -> DataFrame:
    """Distinct change records. One path under two change types stays two records."""
    columns = [c for c in ("repo", "path", "change_type", "previous_path") if c in changes.columns]
    return changes.select(*columns).distinct()


def worktree_paths(inventory: DataFrame, rules: IgnoreRules) -> DataFrame:
    """Tracked paths plus untracked ones that no rule ignores.

    ``inventory`` is ``(repo, path, tracked)``. One scan, no self-union.
    """
    keep = F.col("tracked") | ~rules.ignored(F.col("path"))
    return inventory.filter(keep).select("repo", "path").distinct()


def in_subtree(rows: DataFrame, prefix: str) -> DataFrame:
    """Rows below ``prefix``, with paths (and previous paths) as seen from there."""
    scoped = rows.filter(F.startswith("path", F.lit(prefix))) if prefix else rows
    scoped = scoped.withColumn("path", scope_path(F.col("path"), prefix))
    if "previous_path" in rows.columns:
        scoped = scoped.withColumn("previous_path", scope_path(F.col("previous_path"), prefix))
    return scoped
