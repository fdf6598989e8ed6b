"""Project tree: one row per directory or file, drawn without building a tree anywhere.

A node's line needs its own last-sibling flag and those of its ancestors. Both come from
joins on node paths, which are unique, so a directory with millions of children is never
gathered in one task. Printing order is a string key that each row computes by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.core import bind
from quire.functions.paths import path_segments, visible_text
from quire.functions.text import fence_for_run, longest_backtick_run
from quire.operators.scale import HOT_KEY_ROWS, hot_key_join, hot_keys, stored


def node_names(path: Column) -> Column:
    """Names from the root to the file; an absolute path hangs below a node ``/``."""
    return F.when(
        F.startswith(path, F.lit("/")), F.concat(F.array(F.lit("/")), path_segments(path))
    ).otherwise(path_segments(path))


def _node_id(names: Column) -> Column:
    """Names joined by slashes; below the node ``/`` this starts with two of them."""
    return F.array_join(names, "/")


def _names_of(node: Column) -> Column:
    """Inverse of :func:`_node_id`."""
    return (
        F.when(node == "/", F.array(F.lit("/")))
        .when(
            F.startswith(node, F.lit("//")),
            F.concat(F.array(F.lit("/")), F.split(F.substr(node, F.lit(3)), "/", -1)),
        )
        .otherwise(F.split(node, "/", -1))
    )


def _order_key(names: Column, is_dir: Column) -> Column:
    """Sorts as the tree prints: directories before files, then by name, parents first.

    Every ancestor is a directory because it has a child. NUL ends a name and sorts below
    every character a name can hold.
    """
    steps = F.transform(
        names,
        lambda name, i: F.concat(
            F.when((i + 1 < F.size(names)) | is_dir, F.lit("0")).otherwise(F.lit("1")), name
        ),
    )
    return F.array_join(steps, "\0")


def tree_nodes(entries: DataFrame) -> DataFrame:
    """Distinct nodes per repository: ``node, parent, name, depth, is_dir, order_key``.

    A node that is a directory for any path is a directory.
    """
    names = entries.select("repo", node_names(F.col("path")).alias("names")).filter(
        F.size("names") > 0
    )
    nodes = F.transform(
        F.sequence(F.lit(1), F.size("names")),
        lambda depth: F.struct(
            _node_id(F.slice(F.col("names"), F.lit(1), depth)).alias("node"),
            # "/" is a directory even as the last step of a path.
            ((depth < F.size("names")) | (F.col("names")[0] == "/") & (depth == 1)).alias(
                "is_dir"
            ),
        ),
    )
    # Ancestors repeat for every file below them and collapse before the shuffle.
    distinct = (
        names.select("repo", F.explode(nodes).alias("n"))
        .groupBy("repo", F.col("n.node").alias("node"))
        .agg(F.max("n.is_dir").alias("is_dir"))
        .withColumn("names", _names_of(F.col("node")))
    )
    depth = F.size("names")
    return distinct.select(
        "repo",
        "node",
        _node_id(F.slice("names", F.lit(1), depth - 1)).alias("parent"),
        F.element_at("names", -1).alias("name"),
        depth.cast("bigint").alias("depth"),
        "is_dir",
        _order_key(F.col("names"), F.col("is_dir")).alias("order_key"),
    )


def marked_nodes(entries: DataFrame) -> DataFrame:
    """Tree nodes with ``is_last``, stored because drawing reads them several times.

    The last child of a directory is a maximum, which is found by partial aggregation; the
    mark comes back by the child's own path. The bare nodes are stored first, so that
    ``entries``, with all the work on file bodies behind it, is evaluated only once. Only
    paths are stored, never bodies.
    """
    nodes = stored(tree_nodes(entries))
    last = nodes.groupBy("repo", "parent").agg(
        F.max_by("node", F.struct(~F.col("is_dir"), F.col("name"))).alias("node")
    )
    return stored(
        nodes.join(
            last.select("repo", "node", F.lit(True).alias("_last")), ["repo", "node"], "left"
        )
        .withColumn("is_last", F.coalesce("_last", F.lit(False)))
        .drop("_last")
    )


def tree_rows(
    entries: DataFrame, max_depth: int | None = None, min_hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Printed tree lines of ``entries``; see :func:`draw_tree`."""
    return draw_tree(marked_nodes(entries), max_depth, min_hot_rows)


def draw_tree(
    nodes: DataFrame, max_depth: int | None = None, min_hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Tree lines: ``repo, order_key, depth, name, is_dir, is_last, line``.

    ``max_depth`` hides what lies deeper; a directory at the limit is still printed.
    """
    shown = nodes if max_depth is None else nodes.filter(F.col("depth") <= max_depth)
    parents = nodes.filter("is_dir")
    if max_depth is not None:
        parents = parents.filter(F.col("depth") < max_depth)
    # (directory, ancestor or self) pairs; directories are few compared with files.
    steps = parents.select(
        "repo",
        "node",
        F.posexplode(
            bind(
                _names_of(F.col("node")),
                lambda names: F.transform(
                    F.sequence(F.lit(1), F.size(names)),
                    lambda depth: _node_id(F.slice(names, F.lit(1), depth)),
                ),
            )
        ).alias("level", "step"),
    )
    flags = parents.select("repo", F.col("node").alias("step"), "is_last")
    # A top-level directory is an ancestor of nearly everything below it.
    size = parents.agg(F.sum("depth")).head()[0] or 0
    crowded = hot_keys(steps, ["repo", "step"], size, min_hot_rows)
    pairs = hot_key_join(steps, flags, ["repo", "step"], crowded, F.col("node"), "inner")
    # One group is one directory's own ancestor chain, as long as the path is deep.
    prefixes = pairs.groupBy("repo", "node").agg(
        F.array_sort(F.collect_list(F.struct("level", "is_last"))).alias("chain")
    ).select(
        "repo",
        F.col("node").alias("parent"),
        F.array_join(
            F.transform(
                "chain",
                lambda s: F.when(s["is_last"], F.lit(C.TREE_SPACE)).otherwise(F.lit(C.TREE_PIPE)),
            ),
            "",
        ).alias("prefix"),
    )
    wide = hot_keys(shown, ["repo", "parent"], shown.count(), min_hot_rows)
    placed = hot_key_join(
        shown, prefixes, ["repo", "parent"], wide, F.col("node"), "left"
    )
    return placed.select(
        "repo", "order_key", "depth", "name", "is_dir", "is_last",
        F.concat(
            F.coalesce("prefix", F.lit("")),
            F.when(F.col("is_last"), F.lit(C.TREE_LAST)).otherwise(F.lit(C.TREE_BRANCH)),
            visible_text(F.col("name")),
        ).alias("line"),
    )


def tree_fences(nodes: DataFrame) -> DataFrame:
    """Fence length per repository; hidden nodes count as well."""
    return (
        nodes.groupBy("repo")
        .agg(F.max(longest_backtick_run(F.col("name"))).alias("run"))
        .select("repo", fence_for_run(F.col("run")).alias("fence_len"))
    )
