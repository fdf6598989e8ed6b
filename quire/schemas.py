"""Table contracts. Readers and tests build DataFrames against these schemas."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


_S, _L, _I, _B = T.StringType(), T.LongType(), T.IntegerType(), T.BooleanType()

#: One row per file. ``kind`` is ``file``, ``symlink``, ``other``, ``unreadable`` or
#: ``unreadable_dir``; ``content`` may be null for anything but ``file``.
FILES = _struct(
    ("repo", _S), ("path", _S), ("content", T.BinaryType()), ("size", _L), ("kind", _S)
)
SELECTED_PATHS = _struct(("repo", _S), ("path", _S))
CHANGES = _struct(("repo", _S), ("path", _S), ("change_type", _S), ("previous_path", _S))
HUNKS = _struct(("repo", _S), ("path", _S), ("new_start", _L), ("new_count", _L))
PATCHES = _struct(("repo", _S), ("path", _S), ("patch", _S))
NAME_STATUS = _struct(("repo", _S), ("blob", _S))
#: ``part`` numbers the pieces of one repository's artifact; every piece starts and
#: ends on a block boundary. ``line_numbers`` and ``hunks`` repeat the header flags.
ARTIFACTS = _struct(
    ("repo", _S), ("part", _L), ("line_numbers", _B), ("hunks", _B), ("body", _S)
)
