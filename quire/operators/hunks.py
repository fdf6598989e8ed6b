"""Changed line ranges: from patches to the line intervals an artifact shows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Only a newline ends a line, so CRLF patches read the same. Numbers too long for a bigint
# make a header malformed.
_NUMBER = r"\d{1,18}"
_HEADER = rf"(?md)^@@ *-{_NUMBER}(?:,{_NUMBER})? *\+({_NUMBER})(?:,({_NUMBER}))? *@@"
_MARK = r"(?md)^@@[^\r\n]{2}"


def parse_patches(patches: DataFrame) -> DataFrame:
    """``(repo, path, patch)`` to hunks, with ``parse_error`` for malformed headers.

    An omitted count is 1. A patch with a malformed header yields one row without a range.
    """
    patch = F.col("patch")
    found = F.arrays_zip(
        F.regexp_extract_all(patch, F.lit(_HEADER), F.lit(1)).alias("start"),
        F.regexp_extract_all(patch, F.lit(_HEADER), F.lit(2)).alias("count"),
    )
    broken = F.regexp_count(patch, F.lit(_MARK)) != F.regexp_count(patch, F.lit(_HEADER))
    rows = patches.select("repo", "path", broken.alias("parse_error"), found.alias("found")).select(
        "repo",
        "path",
        "parse_error",
        F.explode_outer(F.when(~F.col("parse_error"), F.col("found"))).alias("h"),
    )
    return rows.filter(F.col("parse_error") | F.col("h").isNotNull()).select(
        "repo",
        "path",
        F.col("h.start").cast("bigint").alias("new_start"),
        F.coalesce(F.expr("nullif(h.count, '')"), F.when(F.col("h").isNotNull(), "1"))
        .cast("bigint")
        .alias("new_count"),
        "parse_error",
    )


def hunks_from_patches(patches: DataFrame) -> DataFrame:
    return (
        parse_patches(patches)
        .filter(~F.col("parse_error"))
        .select("repo", "path", "new_start", "new_count")
    )


def render_ranges(hunks: DataFrame, sizes: DataFrame, context: int) -> DataFrame:
    """Widened line ranges, one row per distinct start.

    ``sizes`` is ``(repo, path, total_lines)``. Starts are clamped into the file, a hunk
    without new lines counts as one line, and both ends move out by ``context`` lines. Only
    the longest hunk per start matters, so repeats collapse before each shuffle and a file
    keeps at most as many ranges as it has lines.
    """
    longest = hunks.groupBy("repo", "path", "new_start").agg(F.max("new_count").alias("new_count"))
    total, start, count = F.col("total_lines"), F.col("new_start"), F.col("new_count")
    first = F.least(F.greatest(start, F.lit(1)), total)
    last = F.when(
        count > 0, F.least(F.greatest(start + count - 1, first), total)
    ).otherwise(first)
    return (
        longest.join(sizes.select("repo", "path", "total_lines"), ["repo", "path"])
        .filter(total > 0)
        .groupBy(
            "repo", "path", "total_lines", F.greatest(first - context, F.lit(1)).alias("range_start")
        )
        .agg(F.max(F.least(last + context, total)).alias("range_end"))
    )


def merge_ranges(ranges: DataFrame) -> DataFrame:
    """Join overlapping and adjacent ranges of a file.

    Needs :func:`render_ranges` rows, whose number per file is bounded by its lines.
    """
    by_file = Window.partitionBy("repo", "path").orderBy("range_start")
    reach = F.max("range_end").over(by_file.rowsBetween(Window.unboundedPreceding, -1))
    return (
        ranges.withColumn("_opens", (F.col("range_start") > F.coalesce(reach, F.lit(-1)) + 1).cast("int"))
        .withColumn("_island", F.sum("_opens").over(by_file))
        .groupBy("repo", "path", "total_lines", "_island")
        .agg(F.min("range_start").alias("start_line"), F.max("range_end").alias("end_line"))
        .drop("_island")
    )


def omissions(merged: DataFrame) -> DataFrame:
    """Unchanged lines left out before each range and after the last one.

    ``before_line`` is the line the gap ends at; the gap behind the last range ends at
    ``total_lines + 1``. Gaps of no lines are not listed.
    """
    by_file = Window.partitionBy("repo", "path").orderBy("start_line")
    placed = merged.withColumn("_previous", F.lag("end_line", 1, 0).over(by_file)).withColumn(
        "_following", F.lead("start_line").over(by_file)
    )
    gaps = placed.select(
        "repo",
        "path",
        F.explode(
            F.array(
                F.struct(
                    F.col("start_line").alias("before_line"),
                    (F.col("start_line") - F.col("_previous") - 1).alias("omitted_lines"),
                ),
                F.struct(
                    (F.col("total_lines") + 1).alias("before_line"),
                    F.when(
                        F.col("_following").isNull(), F.col("total_lines") - F.col("end_line")
                    )
                    .otherwise(0)
                    .alias("omitted_lines"),
                ),
            )
        ).alias("gap"),
    )
    return gaps.filter("gap.omitted_lines > 0").select("repo", "path", "gap.*")


def file_ranges(hunks: DataFrame, sizes: DataFrame, context: int) -> DataFrame:
    """One row per file with the ordered, merged ranges to show."""
    merged = merge_ranges(render_ranges(hunks, sizes, context))
    return merged.groupBy("repo", "path").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "end_line"))).alias("ranges")
    )


def with_render_mode(entries: DataFrame, changes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Entries with ``mode`` and ``ranges`` for an export of changed lines.

    Added files are shown whole, files with ranges in slices, others not at all.
    """
    added = changes.filter(F.col("change_type") == "A").select("repo", "path").distinct()
    joined = entries.join(
        added.withColumn("_added", F.lit(True)), ["repo", "path"], "left"
    ).join(ranges, ["repo", "path"], "left")
    mode = (
        F.when(F.col("_added"), "FULL").when(F.col("ranges").isNotNull(), "SLICED").otherwise("OMIT")
    )
    return joined.withColumn("mode", mode).drop("_added")
