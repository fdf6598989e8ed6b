"""Text measurements. All sizes are bytes, never characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.core import bind, div

_CONTROL = r"[\x01-\x08\x0b\x0c\x0e-\x1f]"
# Says the same of a whole text in one greedy pass, more than twice as fast as a search.
_NO_CONTROL = r"\A[ -\x{10FFFF}\n\r\t]*\z"


def is_binary(content: Column) -> Column:
    """True for bytes with a NUL, invalid UTF-8, or at least 3 % control characters.

    The control share is compared with the byte length rounded up. Counting runs only
    for the rare text that holds a control character at all.
    """
    text = content.cast("string")
    allowed = div(F.octet_length(content).cast("bigint") * 3 + 99, 100)
    return (
        F.when(F.octet_length(content) == 0, F.lit(False))
        .when(F.contains(text, F.lit("\0")), F.lit(True))
        .when(~F.is_valid_utf8(text), F.lit(True))
        .when(text.rlike(_NO_CONTROL), F.lit(False))
        .otherwise(F.regexp_count(text, F.lit(_CONTROL)) >= allowed)
    )


def line_count(text: Column) -> Column:
    """Newlines, plus one when the last line is not terminated; 0 for empty text."""
    newlines = F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit("")))
    open_line = F.when((text == "") | F.endswith(text, F.lit("\n")), 0).otherwise(1)
    return (newlines + open_line).cast("bigint")


def longest_backtick_run(text: Column) -> Column:
    runs = F.regexp_extract_all(text, F.lit("`+"), F.lit(0))
    longest = F.array_max(F.transform(runs, lambda run: F.octet_length(run)))
    return F.when(F.contains(text, F.lit("`")), longest).otherwise(0).cast("int")


def fence_for_run(run: Column) -> Column:
    """Shortest fence, at least three backticks, that a run of ``run`` cannot close."""
    return F.when(run >= 3, run + 1).otherwise(3).cast("int")


def fence_length(text: Column) -> Column:
    return F.when(
        F.contains(text, F.lit("```")), fence_for_run(longest_backtick_run(text))
    ).otherwise(3).cast("int")


def split_lines(text: Column) -> Column:
    """Lines without their newline; a final newline does not open another line."""
    pieces = F.split(text, "\n", -1)
    return bind(
        pieces,
        lambda lines: F.when(
            (text == "") | F.endswith(text, F.lit("\n")),
            F.slice(lines, F.lit(1), F.size(lines) - 1),
        ).otherwise(lines),
    )


def number_width(total_lines: Column) -> Column:
    """Width of the widest line number of the whole file."""
    return F.length(total_lines.cast("string"))


def line_prefix(line_no: Column, width: Column) -> Column:
    """Right-aligned line number and separator."""
    return F.concat(F.lpad(line_no.cast("string"), width, F.lit(" ")), F.lit(" | "))


def number_lines(text: Column, total_lines: Column) -> Column:
    """Every line with its number in front and a newline behind."""
    return bind(
        number_width(total_lines),
        lambda width: F.array_join(
            F.transform(
                split_lines(text),
                lambda line, i: F.concat(line_prefix(i + 1, width), line, F.lit("\n")),
            ),
            "",
        ),
    )


def strip_line_numbers(text: Column) -> Column:
    """Inverse of :func:`number_lines`; null when any line has no number."""
    numbered = r"^\s*\d+ \| ?"
    return bind(
        split_lines(text),
        lambda lines: F.when(
            F.forall(lines, lambda line: line.rlike(numbered)),
            F.concat(
                F.array_join(
                    F.transform(lines, lambda line: F.regexp_replace(line, numbered, "")), "\n"
                ),
                F.when(F.endswith(text, F.lit("\n")), F.lit("\n")).otherwise(F.lit("")),
            ),
        ),
    )


def with_final_newline(text: Column) -> Column:
    missing = (text != "") & ~F.endswith(text, F.lit("\n"))
    return F.concat(text, F.when(missing, F.lit("\n")).otherwise(F.lit("")))


def without_last_newline(text: Column) -> Column:
    """Drop one trailing newline, for the text sink that adds one to every row."""
    return F.regexp_replace(text, r"\n\z", "")


def estimate_tokens(n_bytes: Column) -> Column:
    """About one token for 3.5 bytes: floor(2 b / 7), in integers."""
    return div(n_bytes.cast("bigint") * 2, 7)
