"""Reading artifacts back into files.

Each input row is a whole artifact or one part of it that starts and ends on a block
boundary, so every row is parsed by itself: no shuffle, and one bad artifact does not stop
the others. An artifact of any size comes in parts; :func:`with_flags` gives all of them the flags of
its header, and :func:`judged_whole` its status.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.paths import contained_path, decode_heading
from quire.functions.text import strip_line_numbers
from quire.operators.scale import stored

STATUS_OK = "ok"
STATUS_HUNKS = "hunk_export"
STATUS_MALFORMED = "malformed"
STATUS_BAD_NUMBERS = "invalid_line_number"
STATUS_UNSAFE = "unsafe_path"
#: Flags of up to this many artifacts, some 50 bytes each, are broadcast.
BROADCAST_HEADERS = 500_000

_PREAMBLE_END = r"(?md)^## "
_OTHER_LINES = r"(?:(?!## )[^\n]*\n)*+"
# First change section and first tree of an artifact without a begin marker. A part may end
# inside either.
_CONTEXT = rf"\A({_OTHER_LINES}){re.escape(C.CONTEXT_HEADING)}\n{_OTHER_LINES}"
_TREE = (
    rf"\A({_OTHER_LINES}){re.escape(C.TREE_HEADING)}\n\s*(`{{3,}}+)[^\n]*\n"
    r"(?:(?!\2\n)[^\n]*\n)*+(?:\2\n|\z)"
)


def _file_pattern(end_marker: str) -> str:
    """One file after the previous match: heading, fence, body, the same fence.

    Lines that are neither a heading nor the end marker are passed over. The fence length
    is remembered, so shorter fences inside the body stay part of it.
    """
    stop = rf"(?:\Q{end_marker}\E(?:\n|\z)|## )"
    between = rf"(?:(?!{stop})[^\n]*\n)*+"
    return (
        rf"(?s)\G{between}## ([^\n]+)\n(?:[ \t\r\f]*\n)*+"
        r"(`{3,}+)[^\n]*\n((?:[^`\n][^\n]*\n|\n|(?!\2(?:\n|\z))`[^\n]*\n)*+)\2(?:\n|\z)"
    )


def preamble_flags(body: Column) -> tuple[Column, Column]:
    """Line-number and hunk flags of a header, read above the first section."""
    preamble = F.split(body, _PREAMBLE_END, 2)[0]
    numbers = preamble.rlike(rf"(?md)^{re.escape(C.LINE_NUMBERS_FLAG)}$")
    hunks = preamble.rlike(rf"(?md)^{re.escape(C.HUNKS_FLAG)}")
    return numbers, hunks


def with_flags(artifacts: DataFrame) -> DataFrame:
    """Fill ``part``, ``line_numbers`` and ``hunks`` for whole artifacts ``(repo, body)``.

    With a column ``part`` the rows are parts of artifacts, and the flags of part 0, which holds the header, are those of all. ``artifacts``
    is then read twice and should be stored; bodies stay in place while the headers are few.
    """
    numbers, hunks = preamble_flags(F.col("body"))
    if "part" in artifacts.columns:
        headers = stored(artifacts.filter("part = 0").select(
            F.col("repo").alias("_repo"), numbers.alias("line_numbers"), hunks.alias("hunks")))
        if headers.count() <= BROADCAST_HEADERS:
            headers = F.broadcast(headers)
        return artifacts.join(headers, F.col("repo").eqNullSafe(F.col("_repo")), "left").select(
            "repo", "part", F.coalesce("line_numbers", F.lit(False)).alias("line_numbers"),
            F.coalesce("hunks", F.lit(False)).alias("hunks"), "body")
    return artifacts.select(
        "repo",
        F.lit(0).cast("bigint").alias("part"),
        numbers.alias("line_numbers"),
        hunks.alias("hunks"),
        "body",
    )


def unpack(
    artifacts: DataFrame, files_begin: str = C.FILES_BEGIN, files_end: str = C.FILES_END
) -> DataFrame:
    """``ARTIFACTS`` rows to ``(repo, part, ord, path, safe_path, text, status)``.

    A row that cannot be read gives one row with its status and no file. ``safe_path`` is
    null for a path that would leave the output root.
    """
    body = F.col("body")
    # A part inside the files section starts with a heading; a marker further down is text
    # of some file. The two sections that also start with a heading look different.
    inside = (
        F.startswith(body, F.lit("## "))
        & ~F.startswith(body, F.lit(f"{C.CONTEXT_HEADING}\n\nFiles changed: "))
        & ~body.rlike(rf"\A{re.escape(C.TREE_HEADING)}\n\n`{{3,}}text\n")
    )
    has_marker = body.rlike(rf"(?md)^\Q{files_begin}\E$")
    files_text = (
        F.when(inside, body)
        .when(has_marker, F.regexp_replace(body, rf"(?msd)\A.*?^\Q{files_begin}\E$", ""))
        .otherwise(F.regexp_replace(F.regexp_replace(body, _CONTEXT, "$1"), _TREE, "$1"))
    )
    pattern = F.lit(_file_pattern(files_end))
    text = F.col("_files")
    parsed = artifacts.withColumn("_files", files_text).select(
        "repo", "part", "line_numbers", "hunks", "_files",
        F.arrays_zip(
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("whole"),
            F.regexp_extract_all(text, pattern, F.lit(1)).alias("heading"),
            F.regexp_extract_all(text, pattern, F.lit(3)).alias("text"),
        ).alias("found"),
    )
    consumed = F.aggregate("found", F.lit(0), lambda n, f: n + F.length(f["whole"]))
    rest = F.substr(text, consumed + 1)
    # A heading left over before the end marker belongs to a file that could not be read.
    unread = F.regexp_replace(rest, rf"(?ms)^\Q{files_end}\E$.*", "").rlike(r"(?md)^## ")
    status = F.when(F.col("hunks"), STATUS_HUNKS).when(unread, STATUS_MALFORMED).otherwise(STATUS_OK)
    rows = parsed.select("repo", "part", "line_numbers", status.alias("status"), "found").select(
        "repo",
        "part",
        "line_numbers",
        "status",
        F.posexplode_outer(
            F.when(F.col("status") == STATUS_OK, F.col("found"))
        ).alias("ord", "f"),
    ).filter(F.col("f").isNotNull() | (F.col("status") != STATUS_OK))
    return checked_files(rows.select(
        "repo", "part", F.col("ord").cast("bigint").alias("ord"), "line_numbers",
        F.col("f.heading").alias("heading"), F.col("f.text").alias("body"), "status",
    ))


def judged_whole(read: DataFrame) -> DataFrame:
    """Rows of :func:`unpack` for parts as it gives them for whole artifacts.

    An artifact with changed lines or with any part that cannot be read has one row with its status and no file. ``read``
    needs ``repo`` and ``status`` and is read twice, so it should be stored.
    """
    lost = stored(
        read.filter(F.col("status").isin(STATUS_HUNKS, STATUS_MALFORMED)).groupBy(F.col("repo").alias("_repo"))
        .agg(F.when(F.bool_or(F.col("status") == STATUS_HUNKS), STATUS_HUNKS).otherwise(STATUS_MALFORMED).alias("_status")))
    known = F.broadcast(lost) if lost.count() <= BROADCAST_HEADERS else lost
    kept = read.join(known, F.col("repo").eqNullSafe(F.col("_repo")), "left_anti")
    empty = {"repo": F.col("_repo"), "status": F.col("_status"), "part": F.lit(0)}
    return kept.unionByName(lost.select(*[
        empty.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in read.dtypes]))


def checked_files(rows: DataFrame) -> DataFrame:
    """Paths and texts of ``(repo, part, ord, line_numbers, heading, body, status)`` with the final status."""
    plain = F.when(F.col("line_numbers"), strip_line_numbers(F.col("body"))).otherwise(F.col("body"))
    read = rows.select(
        "repo", "part", "ord", decode_heading(F.col("heading")).alias("path"), plain.alias("text"), "status",
    )
    safe = contained_path(F.col("path"))
    return read.select(
        "repo", "part", "ord", "path", safe.alias("safe_path"), "text",
        F.when(F.col("status") != STATUS_OK, F.col("status"))
        .when(F.col("text").isNull(), STATUS_BAD_NUMBERS)
        .when(safe.isNull(), STATUS_UNSAFE)
        .otherwise(F.lit(STATUS_OK))
        .alias("status"),
    )
