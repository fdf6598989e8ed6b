"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use the result many times in ``body``.

    The optimizer inlines a projected column that is referenced once, even when that
    reference sits inside a lambda that runs per array element. Binding the value as a
    lambda argument keeps costly parts, such as splitting a whole file, at one
    evaluation per row.
    """
    return F.transform(F.array(value), body)[0]


def div(left: Column, right: int) -> Column:
    """Integer division that never goes through floating point."""
    return F.call_function("div", left.cast("bigint"), F.lit(right).cast("bigint"))


def any_of(conditions: list[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | condition
    return result


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only, so that a lookup never depends on Unicode case rules."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def literal_map(entries: dict[str, str]) -> Column:
    """Map constant; keys and values must not hold quotes or backslashes."""
    return F.expr("map(" + ", ".join(f"'{k}', '{v}'" for k, v in entries.items()) + ")")
