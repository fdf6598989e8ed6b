"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

MAX_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being the smallest node reachable.

    A round joins every neighbour to the smallest neighbour, once among larger and once among
    smaller ones; the number of rounds grows with the logarithm of the nodes. Edges of one node
    are never gathered: a round takes minima, with partial aggregation, and joins them back. Every
    round is stored, so the lineage stays short.
    """
    current = scratch.store(oriented(edges, "a", "b"), "edges")
    state = summary(current)
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = oriented(both.filter("b > a").join(least, "a"), "b", "m")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = oriented(joined.select(
            F.explode(F.array(F.struct(F.col("b").alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("e")
        ).select("e.x", "e.m"), "x", "m")
        current = scratch.store(small, "edges")
        before, state = state, summary(current)
        if state == before:
            break
    else:
        raise RuntimeError("the components did not settle")
    roots = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def oriented(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges with the larger node first, without loops."""
    return edges.filter(F.col(a) != F.col(b)).select(
        F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct()


def summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head())
