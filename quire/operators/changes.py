"""Change records: reading them from version-control text and printing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.paths import display_path, escape_markdown

# One record after another from the start: renames and copies carry two paths, every other
# status one. Stray empty fields between records are skipped.
_RECORD = (
    r"\G\x00*(?:([RC][^\x00]*)\x00([^\x00]+)\x00([^\x00]+)\x00"
    r"|([^RC\x00][^\x00]*)\x00([^\x00]+)\x00)"
)
# Change types after reading; a status other than A, R and D counts as M.
_KEPT_STATUSES = ("A", "M", "R")
_TYPE_RANK = {"A": 1, "M": 2, "R": 3}


def parse_name_status(blobs: DataFrame) -> DataFrame:
    """NUL-separated change lists ``(repo, blob)`` to typed rows with ``parse_error``.

    A list that ends inside a record yields one row with ``parse_error`` and no path: nothing
    of it can be trusted. Deletions are dropped; any status other than A and R counts as M, at
    the new path of a copy.
    """
    blob = F.col("blob")

    def group(n: int) -> Column:
        return F.regexp_extract_all(blob, F.lit(_RECORD), F.lit(n))

    parsed = blobs.select(
        "repo",
        F.arrays_zip(
            group(0).alias("whole"), group(1).alias("two"), group(2).alias("old"),
            group(3).alias("new"), group(4).alias("one"), group(5).alias("only"),
        ).alias("records"),
        "blob",
    )
    consumed = F.aggregate(
        "records", F.lit(0), lambda total, r: total + F.length(r["whole"])
    )
    # Only padding may be left behind the last record.
    broken = F.substr(blob, consumed + 1).rlike(r"[^\x00]")
    rows = parsed.select(
        "repo",
        broken.alias("parse_error"),
        F.explode_outer(F.when(~broken, F.col("records"))).alias("r"),
    )
    status = F.when(F.col("r.two") != "", F.col("r.two")).otherwise(F.col("r.one"))
    letter = F.left(status, F.lit(1))
    two = F.col("r.two") != ""
    kind = F.when(letter.isin("A", "R"), letter).when(letter.isNotNull(), F.lit("M"))
    return rows.filter(F.col("parse_error") | (letter != "D")).select(
        "repo",
        F.when(two, F.col("r.new")).otherwise(F.col("r.only")).alias("path"),
        kind.alias("change_type"),
        F.when(two & (letter == "R"), F.col("r.old")).alias("previous_path"),
        "parse_error",
    )


def changes_from_name_status(blobs: DataFrame) -> DataFrame:
    """Distinct change rows of all well-formed lists."""
    return (
        parse_name_status(blobs)
        .filter(~F.col("parse_error"))
        .select("repo", "path", "change_type", "previous_path")
        .distinct()
    )


def export_changes(changes: DataFrame, kinds: tuple[str, ...] = _KEPT_STATUSES) -> DataFrame:
    """Changes that can be exported: no deletions."""
    return changes.filter(F.col("change_type").isin(*kinds))


def surviving_changes(changes: DataFrame, entries: DataFrame) -> DataFrame:
    """Changes whose file was accepted."""
    return (
        changes.withColumn("path", display_path(F.col("path")))
        .join(entries.select("repo", "path"), ["repo", "path"], "left_semi")
        .select("repo", "path", "change_type", "previous_path")
    )


def change_order_key(path: Column, change_type: Column, previous: Column) -> Column:
    """Sorts by path, then no type < A < M < R, then the previous path."""
    rank = F.lit("0")
    for kind, position in _TYPE_RANK.items():
        rank = F.when(change_type == kind, F.lit(str(position))).otherwise(rank)
    return F.concat_ws("\0", path, rank, F.coalesce(previous, F.lit("")))


def change_line(path: Column, change_type: Column, previous: Column) -> Column:
    label = F.when(change_type.isin("A", "R"), change_type).otherwise(F.lit("M"))
    origin = F.when(
        (change_type == "R") & (F.coalesce(previous, F.lit("")) != ""),
        F.concat(escape_markdown(previous), F.lit(" -> ")),
    ).otherwise(F.lit(""))
    return F.concat(F.lit("- "), label, F.lit(" "), origin, escape_markdown(path))


def change_context(changes: DataFrame) -> DataFrame:
    """Printed change lines with their order."""
    path, kind, previous = F.col("path"), F.col("change_type"), F.col("previous_path")
    return changes.select(
        "repo",
        change_order_key(path, kind, previous).alias("order_key"),
        change_line(path, kind, previous).alias("line"),
    )


def context_heads(repos: DataFrame, changes: DataFrame, diff_range: str | None) -> DataFrame:
    """Heading of the change section for every repository, also with no change left."""
    counts = changes.groupBy("repo").agg(F.count(F.lit(1)).alias("n"))
    shown_range = (
        F.concat(F.lit("Diff range: "), escape_markdown(F.lit(diff_range)), F.lit("\n"))
        if diff_range
        else F.lit("")
    )
    return repos.select("repo").join(counts, "repo", "left").select(
        "repo",
        F.concat(
            F.lit(f"{C.CONTEXT_HEADING}\n\nFiles changed: "),
            F.coalesce("n", F.lit(0)).cast("string"),
            F.lit("\n"), shown_range, F.lit("\n"),
        ).alias("body"),
    )
