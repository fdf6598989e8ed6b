"""Artifact text as ordered rows.

``blocks`` is ``(repo, section, order_key, path, body, n_bytes)``; sorting by the first
three columns gives the artifact of each repository. Sizes of files follow from the lengths of
their parts, so counting prints nothing; tests hold them against the printed text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.core import bind
from quire.functions.paths import escape_markdown
from quire.functions.text import (
    line_prefix,
    number_lines,
    number_width,
    split_lines,
    with_final_newline,
)
from quire.operators.changes import change_context, context_heads
from quire.operators.scale import stored
from quire.operators.tree import draw_tree, marked_nodes, tree_fences
from quire.options import ExportOptions

HEADER, CONTEXT, TREE, BEGIN, FILES, END = range(6)
# Between the number of lines left out.
_LEFT_OUT = ("... ", " unchanged lines omitted ...\n\n")


def _ticks(length: Column) -> Column:
    return F.repeat(F.lit("`"), length)


def _heading(path: Column) -> Column:
    return F.concat(F.lit("## "), escape_markdown(path), F.lit("\n\n"))


def full_block(line_numbers: bool = False) -> Column:
    """A whole file: heading, fence with language, body, closing fence."""
    text, fence = F.col("text"), _ticks(F.col("fence_len"))
    body = number_lines(text, F.col("total_lines")) if line_numbers else with_final_newline(text)
    return F.concat(
        _heading(F.col("path")), fence, F.coalesce("lang", F.lit("")), F.lit("\n"),
        body, fence, F.lit("\n\n\n"),
    )


def _omission(lines: Column) -> Column:
    return F.when(
        lines > 0,
        F.concat(F.lit(_LEFT_OUT[0]), lines.cast("string"), F.lit(_LEFT_OUT[1])),
    ).otherwise(F.lit(""))


def sliced_block(line_numbers: bool = False) -> Column:
    """The ranges of a file, each in its own fence, with markers for what is left out.

    Fence and number width are those of the whole file.
    """
    # Bound once per row: inside the lambdas they would be computed again per range or line.
    bound = F.struct(
        split_lines(F.col("text")).alias("lines"),
        _ticks(F.col("fence_len")).alias("fence"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.col("total_lines").alias("total"),
        number_width(F.col("total_lines")).alias("width"),
        F.col("ranges").alias("ranges"),
    )

    def draw(file: Column) -> Column:
        def one(span: Column, i: Column) -> Column:
            first, last = span["start_line"], span["end_line"]
            before = F.when(i > 0, F.try_element_at(file["ranges"], i)["end_line"]).otherwise(0)
            shown = F.slice(file["lines"], first.cast("int"), (last - first + 1).cast("int"))
            printed = F.transform(
                shown,
                lambda line, k: F.concat(
                    line_prefix(first + k, file["width"]) if line_numbers else F.lit(""),
                    line, F.lit("\n"),
                ),
            )
            return F.concat(
                _omission(first - before - 1),
                file["fence"], file["lang"], F.lit("\n"),
                F.array_join(printed, ""), file["fence"], F.lit("\n\n\n"),
            )

        tail = file["total"] - F.element_at(file["ranges"], -1)["end_line"]
        return F.concat(F.array_join(F.transform(file["ranges"], one), ""), _omission(tail))

    return F.concat(_heading(F.col("path")), bind(bound, draw))


def full_block_bytes(line_numbers: bool = False) -> Column:
    """Size of :func:`full_block` without printing it."""
    text, lines = F.col("text"), F.col("total_lines").cast("bigint")
    closing = F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
    size = _heading_bytes() + _fence_bytes() + F.octet_length(text) + closing
    return size + lines * (number_width(lines) + 3) if line_numbers else size


def sliced_block_bytes(line_numbers: bool = False) -> Column:
    """Size of :func:`sliced_block`, from the lengths of the lines."""
    bound = F.struct(
        F.transform(split_lines(F.col("text")), lambda line: F.octet_length(line).cast("bigint") + 1).alias("lengths"),
        _fence_bytes().alias("fences"), F.col("total_lines").alias("total"),
        (number_width(F.col("total_lines")) + 3 if line_numbers else F.lit(0)).alias("prefix"), F.col("ranges").alias("ranges"))

    def add(left: Column, right: Column) -> Column:
        return left + right

    def measure(file: Column) -> Column:
        def one(span: Column, i: Column) -> Column:
            first, lines = span["start_line"], span["end_line"] - span["start_line"] + 1
            before = F.when(i > 0, F.try_element_at(file["ranges"], i)["end_line"]).otherwise(0)
            shown = F.slice(file["lengths"], first.cast("int"), lines.cast("int"))
            return (_omission_bytes(first - before - 1) + file["fences"]
                    + F.aggregate(shown, F.lit(0).cast("bigint"), add) + F.size(shown) * file["prefix"])

        tail = file["total"] - F.element_at(file["ranges"], -1)["end_line"]
        return F.aggregate(F.transform(file["ranges"], one), F.lit(0).cast("bigint"), add) + _omission_bytes(tail)

    return _heading_bytes() + bind(bound, measure)


def _heading_bytes() -> Column:
    return F.octet_length(escape_markdown(F.col("path"))).cast("bigint") + len("## \n\n")


def _fence_bytes() -> Column:
    """Both fences of a body, the language, and the newlines around them."""
    return F.col("fence_len").cast("bigint") * 2 + F.octet_length(F.coalesce("lang", F.lit(""))) + len("\n\n\n\n")


def _omission_bytes(lines: Column) -> Column:
    return F.when(lines > 0, F.length(lines.cast("string")) + sum(map(len, _LEFT_OUT))).otherwise(0).cast("bigint")


def file_blocks(entries: DataFrame, options: ExportOptions) -> DataFrame:
    """One block per visible file."""
    body = full_block(options.line_numbers)
    if "ranges" in entries.columns:
        body = F.when(F.col("mode") == "SLICED", sliced_block(options.line_numbers)).otherwise(body)
    return visible(entries).select(
        "repo",
        F.lit(FILES).alias("section"),
        F.col("path").alias("order_key"),
        "path",
        body.alias("body"),
    )


def file_sizes(entries: DataFrame, options: ExportOptions) -> DataFrame:
    """Place and size of each block of :func:`file_blocks`; no block is printed."""
    size = full_block_bytes(options.line_numbers)
    if "ranges" in entries.columns:
        size = F.when(F.col("mode") == "SLICED", sliced_block_bytes(options.line_numbers)).otherwise(size)
    return visible(entries).select(
        "repo", F.lit(FILES).alias("section"), F.col("path").alias("order_key"), size.alias("n_bytes"))


def visible(entries: DataFrame) -> DataFrame:
    return entries.filter(F.col("mode") != "OMIT")


def header_text(repo: Column, options: ExportOptions) -> Column:
    flags = ""
    if options.line_numbers:
        flags += f"\n{C.LINE_NUMBERS_FLAG}"
    if options.hunks:
        flags += f"\n{C.HUNKS_FLAG} (context: {options.hunk_context})"
    return F.concat(
        F.lit(f"{C.TITLE}\n\nRepository: "), escape_markdown(repo),
        F.lit(
            f"\nMode: {options.mode}\nGenerated: {options.generated_at}{flags}\n\n"
            f"{C.MODE_DESCRIPTIONS[options.mode]}\n\n"
        ),
    )


def _rows(df: DataFrame, section: int, key: Column | str, body: Column) -> DataFrame:
    order = F.lit(key) if isinstance(key, str) else key
    return df.select(
        "repo",
        F.lit(section).alias("section"),
        order.alias("order_key"),
        F.lit(None).cast("string").alias("path"),
        body.alias("body"),
    )


def header_blocks(repos: DataFrame, options: ExportOptions) -> DataFrame:
    return _rows(repos, HEADER, "", header_text(F.col("repo"), options))


def context_blocks(repos: DataFrame, changes: DataFrame, options: ExportOptions) -> list[DataFrame]:
    """Change section: heading, one row per change, closing empty line."""
    heads = context_heads(repos, changes, options.diff_range)
    lines = change_context(changes)
    return [
        _rows(heads, CONTEXT, "0", F.col("body")),
        _rows(lines, CONTEXT, F.concat(F.lit("1"), "order_key"), F.concat("line", F.lit("\n"))),
        _rows(repos, CONTEXT, "2", F.lit("\n")),
    ]


def tree_blocks(repos: DataFrame, nodes: DataFrame, options: ExportOptions) -> list[DataFrame]:
    """Tree section: opening fence, one row per node, closing fence."""
    fences = repos.join(tree_fences(nodes), "repo", "left")
    fence = _ticks(F.coalesce("fence_len", F.lit(3)))
    empty = F.when(F.col("fence_len").isNull(), F.lit(f"{C.EMPTY_TREE_LINE}\n")).otherwise(F.lit(""))
    rows = draw_tree(nodes, options.tree_depth)
    return [
        _rows(fences, TREE, "", F.concat(F.lit(f"{C.TREE_HEADING}\n\n"), fence, F.lit("text\n"), empty)),
        # Keys of nodes begin with 0 or 1.
        _rows(rows, TREE, F.col("order_key"), F.concat("line", F.lit("\n"))),
        _rows(fences, TREE, "2", F.concat(fence, F.lit("\n\n"))),
    ]


def marker_blocks(shown: DataFrame, options: ExportOptions) -> list[DataFrame]:
    """Begin and end marker, for repositories that show at least one file."""
    repos = shown.select("repo").distinct()
    return [
        _rows(repos, BEGIN, "", F.lit(f"{options.files_begin}\n\n")),
        _rows(repos, END, "", F.lit(f"{options.files_end}\n\n")),
    ]


def frame_blocks(
    repos: DataFrame,
    entries: DataFrame,
    options: ExportOptions,
    changes: DataFrame | None = None,
) -> DataFrame:
    """All blocks but those of files: headers, changes, trees and markers.

    ``repos`` lists the repositories that get an artifact, also without any file. Which paths are
    shown is learnt from the entries once and stored.
    """
    repos = stored(repos.select("repo").distinct())
    if options.show_tree:
        shown = marked_nodes(visible(entries))
    else:
        shown = stored(visible(entries).select("repo").distinct())
    parts = [header_blocks(repos, options)]
    if options.is_delta:
        if changes is None:
            raise ValueError(f"mode {options.mode} needs change records")
        parts += context_blocks(repos, changes, options)
    if options.show_tree:
        parts += tree_blocks(repos, shown, options)
    parts += marker_blocks(shown, options)
    return with_bytes(reduce(DataFrame.unionByName, parts))


def with_bytes(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("n_bytes", F.octet_length("body").cast("bigint"))


def blocks(frame: DataFrame, entries: DataFrame, options: ExportOptions) -> DataFrame:
    """All blocks of all artifacts; ``frame`` comes from :func:`frame_blocks`."""
    return frame.unionByName(with_bytes(file_blocks(entries, options)))


def block_sizes(frame: DataFrame, entries: DataFrame, options: ExportOptions) -> DataFrame:
    """``(repo, section, order_key, n_bytes)`` of all blocks, without printing files."""
    return frame.select("repo", "section", "order_key", "n_bytes").unionByName(file_sizes(entries, options))
