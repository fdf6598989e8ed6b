"""Path handling: segments, headings and containment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_CONTROL = r"[\x00-\x1f\x7f]"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_segments(path: Column) -> Column:
    """Non-empty parts; repeated slashes count as one."""
    return F.filter(F.split(path, "/", -1), lambda part: part != "")


def display_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def normalize_path(path: Column) -> Column:
    """Relative path without ``./`` or slashes in front and with single slashes."""
    return F.regexp_replace(path, r"\A(?:\./)?/*|(?<=/)/+", "")


def scope_path(path: Column, prefix: str) -> Column:
    """Path seen from below ``prefix``; paths outside keep their full form."""
    if not prefix:
        return path
    return F.when(
        F.startswith(path, F.lit(prefix)), F.substr(path, F.lit(len(prefix) + 1))
    ).otherwise(path)


def visible_text(name: Column) -> Column:
    """Control characters as two-character escapes or ``\\xNN``."""
    named = name
    for char, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        named = F.replace(named, F.lit(char), F.lit(shown))
    spelled = F.array_join(
        F.transform(
            F.split(named, "", -1),
            lambda c: F.when(
                c.rlike(_CONTROL), F.concat(F.lit("\\x"), F.lpad(F.hex(F.ascii(c)), 2, "0"))
            ).otherwise(c),
        ),
        "",
    )
    return (
        F.when(~name.rlike(_CONTROL), name)
        .when(~named.rlike(_CONTROL), named)
        .otherwise(spelled)
    )


def escape_markdown(path: Column) -> Column:
    """Path as heading text: Markdown marks escaped, control characters spelled out."""
    marked = F.regexp_replace(path, r"([\\`*\[\]])", r"\\$1")
    entities = F.replace(F.replace(marked, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return visible_text(entities)


def decode_heading(heading: Column) -> Column:
    """Inverse of :func:`escape_markdown`."""
    plain = F.replace(
        F.replace(heading, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&")
    )
    tokens = F.regexp_extract_all(
        plain, F.lit(r"(?s)\\x[0-9A-Fa-f]{2}|\\.|[^\\]+|\\"), F.lit(0)
    )
    decoded = F.array_join(
        F.transform(
            tokens,
            lambda t: F.when(~F.startswith(t, F.lit("\\")), t)
            .when(t == "\\n", F.lit("\n"))
            .when(t == "\\r", F.lit("\r"))
            .when(t == "\\t", F.lit("\t"))
            .when(t.rlike(r"^\\[\\`*\[\]]$"), F.substring(t, 2, 1))
            .when(
                F.length(t) == 4,
                F.char(F.conv(F.substring(t, 3, 2), 16, 10).cast("int")),
            )
            .otherwise(t),
        ),
        "",
    )
    return F.when(F.contains(plain, F.lit("\\")), decoded).otherwise(plain)


def contained_path(path: Column) -> Column:
    """Path relative to an output root, or null when it would leave that root.

    Leading slashes are dropped, ``.`` and ``..`` resolved.
    """
    start = F.struct(
        F.array().cast("array<string>").alias("kept"), F.lit(False).alias("escaped")
    )

    def step(state: Column, part: Column) -> Column:
        return (
            F.when(part == ".", state)
            .when(
                part == "..",
                F.struct(
                    F.slice(
                        state["kept"], F.lit(1), F.greatest(F.size(state["kept"]) - 1, F.lit(0))
                    ).alias("kept"),
                    (state["escaped"] | (F.size(state["kept"]) == 0)).alias("escaped"),
                ),
            )
            .otherwise(
                F.struct(
                    F.array_append(state["kept"], part).alias("kept"),
                    state["escaped"].alias("escaped"),
                )
            )
        )

    def finish(state: Column) -> Column:
        return F.when(
            ~state["escaped"] & (F.size(state["kept"]) > 0), F.array_join(state["kept"], "/")
        )

    dotted = path.rlike(r"(^|/)\.{1,2}(/|$)|//|^/|/$|^$")
    return F.when(
        dotted, F.aggregate(path_segments(path), start, step, finish)
    ).otherwise(path)
