"""Merkle manifest of a dataset: one tree of row digests per group, one tree over the groups' roots.

Nodes of a tree are cut into superblocks of 3^k consecutive ones. A first pass reduces every superblock to
its single node; the nodes that are left form a table smaller by that factor, whose own paths to the root come
from the same procedure. Then leaves and the outer nodes that their superblock needs, the siblings on its
way up, are cogrouped by superblock: one task finishes the local levels, joins both halves of every
proof and folds each leaf, original or changed, up to the root. No task sees more than a superblock.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.operators.scale import running

ARITY = 3
#: Levels finished within one superblock: 3^9 = 19,683 leaves, some 5 MB.
SUPERBLOCK_LEVELS = 9
#: Columns of a leaf, in this order.
LEAF_COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(values: list[Column]) -> Column:
    """Lower-case hex SHA-256 of the values, each ``-`` if null, else byte count, colon, value."""
    coded = [
        F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
        for v in (v.cast("string") for v in values)
    ]
    return F.sha2(F.concat(*coded), 256)


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def local_levels(nodes: list[str], block: int, levels: int) -> list[list[str]]:
    """Levels from the nodes of a superblock up to its single top node.

    A superblock behind the first has neighbours on every level, so a run of one node is hashed as well.
    The first one, where it is not full, is the whole tree and ends at one node.
    """
    tree = [nodes]
    while len(tree) <= levels if block else len(tree[-1]) > 1:
        last = tree[-1]
        tree.append([digest("".join(last[i : i + ARITY])) for i in range(0, len(last), ARITY)])
    return tree


def local_path(tree: list[list[str]], at: int) -> Iterator[tuple[str, str]]:
    """Siblings before and after the node on each level below the top, joined."""
    for level in tree[:-1]:
        run = at - at % ARITY
        yield "".join(level[run:at]), "".join(level[at + 1 : run + ARITY])
        at //= ARITY


def fold(node: str, path: list[tuple[str, str]]) -> str:
    for before, after in path:
        node = digest(before + node + after)
    return node


NODES = "tree string, pos bigint, digest string"
PATHS = "tree string, pos bigint, before array<string>, after array<string>, root string"


def tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The node that each superblock is reduced to, at the superblock's number."""

    def reduce(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        digests = block.sort_values("pos")["digest"].tolist()
        top = local_levels(digests, key[1], levels)[-1][0]
        return pd.DataFrame([(key[0], key[1], top)], columns=["tree", "pos", "digest"])

    return in_blocks(nodes, levels).groupBy("tree", "block").applyInPandas(reduce, NODES)


def in_blocks(nodes: DataFrame, levels: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / F.lit(ARITY**levels)).cast("bigint"))


def paths(nodes: DataFrame, levels: int, scratch: Scratch) -> DataFrame:
    """Siblings from every node of ``nodes`` (tree, pos, digest) up to its root, lowest level first, and that root.

    Positions start at 0 without gaps. Trees of one superblock are finished at once; for larger ones
    the superblocks' top nodes are a smaller table of the same kind.
    """
    highest = nodes.agg(F.max("pos")).head()[0]
    if highest is None or highest < ARITY**levels:
        outer = nodes.select("tree").distinct().select(
            "tree", F.lit(0).cast("bigint").alias("block"), F.array().cast("array<string>").alias("before"),
            F.array().cast("array<string>").alias("after"), F.lit(None).cast("string").alias("root"))
    else:
        above = scratch.store(tops(nodes, levels), "tops")
        outer = paths(above, levels, scratch).withColumnRenamed("pos", "block")

    def join(key: tuple, block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        tree = local_levels(block["digest"].tolist(), key[1], levels)
        upper = outside.iloc[0]
        rows = []
        for i, pos in enumerate(block["pos"]):
            path = [*local_path(tree, i), *zip(upper["before"], upper["after"], strict=True)]
            rows.append((key[0], pos, [b for b, _ in path], [a for _, a in path], upper["root"] or tree[-1][0]))
        return pd.DataFrame(rows, columns=["tree", "pos", "before", "after", "root"])

    return scratch.store(
        in_blocks(nodes, levels).select("tree", "block", "pos", "digest").groupBy("tree", "block")
        .cogroup(outer.select("tree", "block", "before", "after", "root").groupBy("tree", "block")).applyInPandas(join, PATHS), "paths")


def manifest(
    docs: DataFrame, group: str = "source", order: str = "doc_id", columns: tuple[str, ...] = LEAF_COLUMNS,
    changed: dict[str, Column] | None = None, levels: int = SUPERBLOCK_LEVELS,
) -> DataFrame:
    """One row per row of ``docs``: ``order``, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaves of a group ascend by ``order`` (null first), then by digest; groups ascend by the bytes of their names,
    null first. ``changed`` replaces columns by what is to be verified; the leaf made from it is folded with the original
    siblings, and ``verified`` says whether the root comes out. Rows alike in all columns are leaves of their own;
    their proofs hold one another. A group of one row has that leaf as its root and, where it is the only group, an
    empty proof. An empty table gives no rows. Bodies are read once, for both digests; from there on a row has
    some 200 bytes. Positions come from a distributed running number, so a group of any size is split.
    """
    scratch = Scratch(docs.sparkSession)
    changed = changed or {}
    original = [F.col(c) for c in columns]
    other = [changed.get(c, F.col(c)) for c in columns]
    name = F.col(group).cast("string")
    # Null comes first: its key is the empty string, all others begin with a mark.
    leaves = scratch.store(docs.select(
        F.when(name.isNull(), "").otherwise(F.concat(F.lit("="), name)).alias("tree"), F.col(order).alias("_order"),
        leaf_digest(original).alias("digest"), leaf_digest(other).alias("other")), "leaves")
    # Equal rows get numbers of their own, so that any number of them can be cut into slices.
    numbered = leaves.withColumn("_row", F.monotonically_increasing_id())
    placed = scratch.store(
        running(numbered, ["tree"], ["_order", "digest", "_row"], store=scratch.store)
        .select("tree", (F.col("row_no") - 1).alias("pos"), F.col("_order").cast("string").alias("shown"), "digest", "other"),
        "placed")
    nodes = placed.select("tree", "pos", "digest")
    blocks = scratch.store(tops(nodes, levels), "tops")
    lower = paths(blocks, levels, scratch)
    subroots = lower.filter("pos = 0").select(F.lit("").alias("forest"), "tree", "root")
    forest = scratch.store(
        running(subroots, ["forest"], ["tree"], store=scratch.store)
        .select("tree", (F.col("row_no") - 1).alias("pos"), F.col("root").alias("digest")), "forest")
    upper = paths(forest.select(F.lit("").alias("tree"), "pos", "digest"), levels, scratch).select(
        "pos", F.col("before").alias("_before"), F.col("after").alias("_after"), F.col("root").alias("_root"))
    outer = (
        lower.join(forest.select("tree", F.col("pos").alias("_place")), "tree")
        .join(upper.withColumnRenamed("pos", "_place"), "_place")
        .select("tree", F.col("pos").alias("block"), F.concat("before", "_before").alias("before"),
                F.concat("after", "_after").alias("after"), F.col("root").alias("subroot"), F.col("_root").alias("root")))

    def finish(key: tuple, block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        digests = block["digest"].tolist()
        tree = local_levels(digests, key[1], levels)
        top = outside.iloc[0]
        above = list(zip(top["before"], top["after"], strict=True))
        rows = []
        for i, (shown, leaf, changed_leaf) in enumerate(zip(block["shown"], digests, block["other"], strict=True)):
            path = [*local_path(tree, i), *above]
            proof = digest("".join(b + a for b, a in path))
            folded = fold(changed_leaf, path)
            rows.append((shown, leaf, top["subroot"], top["root"], proof, folded, folded == top["root"]))
        return pd.DataFrame(rows, columns=["shown", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = "shown string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    finished = in_blocks(placed, levels).groupBy("tree", "block").cogroup(
        outer.groupBy("tree", "block")).applyInPandas(finish, schema)
    scratch.drop(finished)
    return finished.withColumn("shown", F.col("shown").cast(docs.schema[order].dataType)).withColumnRenamed("shown", order)


def manifest_report(docs: DataFrame) -> DataFrame:
    """Manifest of documents, checked against texts that lost their line feeds in every second row.

    Rows whose doc_id has an even CRC-32 (unsigned, of its decimal digits; null: of nothing, 0) are verified with
    all line feeds removed from their text.
    """
    even = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 2 == 0
    text = F.col("text")
    return manifest(docs, changed={"text": F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)})
