"""Fence language of a file, from its name or its script header."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.core import ascii_lower, literal_map
from quire.functions.paths import basename

# The possessive quantifiers keep a skipped option from being read as the interpreter.
_WORD = r"[^ \t\r\n]"
_INTERPRETER = (
    rf"^#![ \t]*+(?:{_WORD}*/)?"
    rf"(?:env(?:[ \t]++-{_WORD}*+)*+[ \t]++(?:{_WORD}*/)?)?({_WORD}+)"
)


def shebang_language(content: Column) -> Column:
    """Language named by a ``#!`` line; only the first 255 bytes are looked at."""
    head = F.substring(content, 1, C.SHEBANG_BYTES).cast("string")
    name = F.regexp_extract(head, _INTERPRETER, 1)
    return F.when(
        F.startswith(head, F.lit("#!")),
        F.try_element_at(literal_map(C.LANGUAGE_BY_INTERPRETER), name),
    )


def language_of(path: Column, content: Column) -> Column:
    """Well-known names first, then the extension; the header only without extension."""
    base = ascii_lower(basename(path))
    by_name = F.try_element_at(literal_map(C.LANGUAGE_BY_FILE_NAME), base)
    by_extension = F.try_element_at(
        literal_map(C.LANGUAGE_BY_EXTENSION), F.substring_index(base, ".", -1)
    )
    has_extension = base.rlike(r"(?s)^.+\.[^.]*\z")
    return (
        F.when(by_name.isNotNull(), by_name)
        .when(has_extension, by_extension)
        .otherwise(shebang_language(content))
    )
