"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine at least c differ by at most 2 - 2c in squared length. The vectors are
rotated to their principal axes, and the axes are dealt into blocks; the budget 2 - 2c is shared
among the blocks in proportion to their variance. A pair within the whole budget is within the
share of at least one block. In each block space is cut into cells by the signs of the leading
coordinates; a vector visits every cell that a point within the block's share can lie in. Pairs that
meet and keep a block's share are verified exactly, and counted only in their first such block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from quire.llm.common import Scratch
from quire.llm.components import components

BLOCKS = 4
#: Vectors of one side that a task compares; cells with more are cut into tiles.
TILE = 16_384
#: Rows of a tile that are multiplied at a time, and columns; the products stay in a core's cache.
STRIP, ACROSS = 512, 2048
#: Lengths that no more vectors have than this are compared without blocks.
RARE_LENGTH = 2048
#: Coordinates whose signs make the cells of a block, at most.
MOST_SIGNS = 12
#: Rounding allowance on squared distances.
SLACK = 1e-6
#: The same for the first look at a tile, which is taken in single precision.
ROUGH = 1e-5

VISITS = "block int, cell int, home boolean, gid bigint"
FOUND = "a bigint, b bigint, n bigint"


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (key, v, ok): ``ok`` when every component is finite and one is not zero."""
    # Vectors stored in single precision stay so; all others are compared in double precision from the start.
    single = df.schema[vector].dataType == ArrayType(FloatType(), df.schema[vector].dataType.containsNull)
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    ok = (
        F.coalesce(F.size(v) > 0, F.lit(False))
        & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
        & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    )
    return df.select(F.col(key).cast("bigint").alias("key"), v.alias("v"), ok.alias("ok"))


def units(vectors: list) -> np.ndarray:
    wide = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    scaled = wide / np.abs(wide).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def moments(groups: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of all unit vectors; ``size * (size + 1)`` numbers reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size + 1, size + 1))
        for batch in batches:
            u = np.hstack([units(batch["v"].tolist()), np.ones((len(batch), 1))])
            total += u.T @ u
        yield pd.DataFrame({"cell": np.arange(total.size), "value": total.ravel()})

    sums = groups.select("v").mapInPandas(run, "cell int, value double").groupBy("cell").agg(F.sum("value"))
    total = np.zeros((size + 1) ** 2)
    for cell, value in sums.collect():
        total[cell] = value
    total = total.reshape(size + 1, size + 1)
    mean = total[:size, size] / max(1.0, total[size, size])
    return mean, total[:size, :size] / max(1.0, total[size, size]) - np.outer(mean, mean)


class Subspaces:
    """Rotation, blocks, budgets and cells."""

    def __init__(self, mean: np.ndarray, covariance: np.ndarray, rows: int, cosine: float):
        values, axes = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")
        values, axes = np.maximum(values[order], 1e-12), axes[:, order]
        size, blocks = len(values), min(BLOCKS, len(values))
        turn = np.arange(size) % (2 * blocks)
        dealt = np.where(turn < blocks, turn, 2 * blocks - 1 - turn)  # to and fro, for equal shares
        self.dims = [np.flatnonzero(dealt == b) for b in range(blocks)]
        self.axes, self.middle, self.cosine = axes, mean @ axes, cosine
        whole = 2.0 - 2.0 * cosine
        share = np.array([values[d].sum() for d in self.dims])
        self.budgets = whole * share / share.sum()
        signs = min(MOST_SIGNS, max(0, math.ceil(math.log2(max(1, rows) / TILE))))
        self.signs = [d[:signs] for d in self.dims]

    def rotate(self, u: np.ndarray) -> np.ndarray:
        return u @ self.axes

    def visits(self, rotated: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(block, row, cell, home) for every cell that each row lives in or visits."""
        for block, dims in enumerate(self.signs):
            off = rotated[:, dims] - self.middle[dims]
            home = ((off > 0) * (1 << np.arange(len(dims)))).sum(axis=1).astype(np.int64)
            rows, cells = np.arange(len(rotated)), home
            yield block, rows, home, np.ones(len(rotated), dtype=bool)
            spent = np.zeros(len(rotated))
            for bit in range(len(dims)):
                cost = spent + off[rows, bit] ** 2
                across = cost <= self.budgets[block] + SLACK
                rows = np.concatenate([rows, rows[across]])
                cells = np.concatenate([cells, cells[across] ^ (1 << bit)])
                spent = np.concatenate([spent, cost[across]])
            yield block, rows, cells, np.zeros(len(rows), dtype=bool)


def visit_rows(groups: DataFrame, spaces) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = spaces.value
        for batch in batches:
            gid = batch["gid"].to_numpy()
            for block, rows, cells, home in s.visits(s.rotate(units(batch["v"].tolist()))):
                yield pd.DataFrame({"block": block, "cell": cells.astype(np.int32), "home": home, "gid": gid[rows]})

    return groups.mapInPandas(run, VISITS)


def compare(homes: pd.DataFrame, guests: pd.DataFrame, block: int, s: Subspaces) -> pd.DataFrame:
    """Links of one tile pair: per home vector how many, and edges that connect what is linked."""
    a, b = units(homes["v"].tolist()), units(guests["v"].tolist())
    ra, rb = s.rotate(a), s.rotate(b)
    ga, gb, times = homes["gid"].to_numpy(), guests["gid"].to_numpy(), guests["m"].to_numpy()
    dims = s.dims[block]
    # One product tells who is near: x.y - (|x|^2 + |y|^2 - budget) / 2 is negative beyond the budget.
    ha, hb = ra[:, dims], rb[:, dims]
    limit = s.budgets[block] + SLACK + ROUGH
    ha = np.column_stack([ha, (limit - (ha * ha).sum(axis=1)) / 2, np.ones(len(ha))]).astype(np.float32)
    hb = np.column_stack([hb, np.ones(len(hb)), (hb * hb).sum(axis=1) / -2]).astype(np.float32)
    counts = np.zeros(len(a), dtype=np.int64)
    forest = Forest()
    for low, left in ((i, j) for i in range(0, len(a), STRIP) for j in range(0, len(b), ACROSS)):
        near = ha[low : low + STRIP] @ hb[left : left + ACROSS].T >= 0
        at, to = np.divmod(np.flatnonzero(near), near.shape[1])
        at, to = at + low, to + left
        for cut in range(0, len(at), 1 << 17):
            i, j = at[cut : cut + (1 << 17)], to[cut : cut + (1 << 17)]
            other = ga[i] != gb[j]
            i, j = i[other], j[other]
            gap = ra[i] - rb[j]
            gap *= gap
            first = gap[:, dims].sum(axis=1) <= s.budgets[block] + SLACK
            for earlier in range(block):
                first &= gap[:, s.dims[earlier]].sum(axis=1) > s.budgets[earlier] + SLACK
            linked = first & ((a[i] * b[j]).sum(axis=1) >= s.cosine)
            i, j = i[linked], j[linked]
            np.add.at(counts, i, times[j])
            forest.add(ga[i], gb[j])
    x, y = forest.edges()
    some = np.flatnonzero(counts)
    return pd.DataFrame({
        "a": np.concatenate([ga[some], x]), "b": np.concatenate([ga[some], y]),
        "n": np.concatenate([counts[some], np.zeros(len(x), dtype=np.int64)])})


class Forest:
    """Keeps one star of edges per connected group of the links of a tile pair."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        if not len(a):
            return
        for x, y in np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0).tolist():
            p, q = self.find(x), self.find(y)
            if p != q:
                self.parent[max(p, q)] = min(p, q)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [(x, self.find(x)) for x in self.parent]
        pairs = [(x, r) for x, r in pairs if x != r]
        out = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return out[:, 0], out[:, 1]


def pigeonhole_links(groups: DataFrame, size: int, cosine: float, scratch: Scratch) -> DataFrame:
    """(a, b, n): for a = b the links of a vector, else edges that connect linked vectors.

    ``groups`` is (gid, v, m): distinct vectors of one length with their number of rows.
    """
    rows = groups.count()
    mean, covariance = moments(groups, size)
    spaces = groups.sparkSession.sparkContext.broadcast(Subspaces(mean, covariance, rows, cosine))
    visits = scratch.store(visit_rows(groups, spaces), "visits")
    tiles = visits.groupBy("block", "cell").agg(
        F.ceil(F.count_if("home") / F.lit(TILE)).cast("int").alias("across"),
        F.ceil(F.count_if(~F.col("home")) / F.lit(TILE)).cast("int").alias("down"),
    ).filter("across > 0 and down > 0")
    # A home goes to one column of tiles and meets all rows of guests, and the other way.
    mine = lambda n: F.pmod(F.xxhash64("gid"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    placed = visits.join(tiles, ["block", "cell"])
    both = placed.filter("home").withColumn("i", mine("across")).withColumn("j", every("down")).unionByName(
        placed.filter("not home").withColumn("j", mine("down")).withColumn("i", every("across")))
    full = both.select("block", "cell", "home", "gid", "i", "j").join(groups, "gid")

    def run(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        return compare(tile[tile["home"]], tile[~tile["home"]], int(key[0]), spaces.value)

    # Batches of whole groups: a group holds two tiles at most.
    return scratch.store(full.groupBy("block", "cell", "i", "j").applyInPandas(run, FOUND), "found")


def rare_links(groups: DataFrame, cosine: float) -> DataFrame:
    """The same for lengths of at most RARE_LENGTH vectors, each compared in one task as a whole."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        u, gid, times = units(part["v"].tolist()), part["gid"].to_numpy(), part["m"].to_numpy()
        i, j = np.nonzero(u @ u.T >= cosine - SLACK)
        other = (i != j) & ((u[i] * u[j]).sum(axis=1) >= cosine)
        i, j = i[other], j[other]
        counts = np.zeros(len(u), dtype=np.int64)
        np.add.at(counts, i, times[j])
        forest = Forest()
        forest.add(gid[i], gid[j])
        x, y = forest.edges()
        some = np.flatnonzero(counts)
        return pd.DataFrame({
            "a": np.concatenate([gid[some], x]), "b": np.concatenate([gid[some], y]),
            "n": np.concatenate([counts[some], np.zeros(len(x), dtype=np.int64)])})

    return groups.withColumn("size", F.size("v")).groupBy("size").applyInPandas(run, FOUND)


def near_vectors(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.95
) -> DataFrame:
    """Per row: key, n_links, component_id and kept (the row's key is its component's smallest).

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing;
    neither do vectors of different length. Equal vectors are compared once and counted as often
    as they occur, so copies form no pairs. A row without a key takes part; it is kept only where no
    row of its component has a key, and so are rows that share the smallest key. Other columns are
    not read. Work is cut into tile pairs of bounded size.
    """
    scratch = Scratch(df.sparkSession)
    rows = usable(df, key, vector)
    groups = scratch.store(
        rows.filter("ok").groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.min("key").alias("low"))
        .withColumn("gid", F.monotonically_increasing_id()), "groups")
    counted = groups.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    frequent = sorted(r.size for r in counted.filter(F.col("n") > RARE_LENGTH).select("size").collect())
    found = scratch.store(rare_links(groups.filter(~F.size("v").isin(frequent)).select("gid", "v", "m"), cosine), "rare")
    for size in frequent:
        found = found.union(pigeonhole_links(groups.filter(F.size("v") == size).select("gid", "v", "m"), size, cosine, scratch))
    roots = components(found.filter("a != b").select("a", "b"), scratch)
    counts = found.filter("a = b").groupBy("a").agg(F.sum("n").alias("_n"))
    known = (
        groups.join(counts, groups["gid"] == counts["a"], "left").drop("a")
        .join(roots, groups["gid"] == roots["node"], "left").drop("node")
        .withColumn("root", F.coalesce("root", "gid")))
    known = scratch.store(known, "known")
    smallest = known.groupBy("root").agg(F.min("low").alias("component"))
    known = known.join(smallest, "root").select(
        "v", (F.col("m") - 1 + F.coalesce("_n", F.lit(0))).alias("_links"), "component")
    joined = rows.filter("ok").join(known, "v").select("key", "_links", "component").union(
        rows.filter("not ok").select("key", F.lit(0).cast("bigint"), "key"))
    result = scratch.store(joined.select(
        F.col("key").alias(key), F.col("_links").cast("bigint").alias("n_links"),
        F.col("component").alias("component_id"), F.col("key").eqNullSafe(F.col("component")).alias("kept")), "result")
    scratch.drop(result)
    return result


def vector_report(df: DataFrame) -> DataFrame:
    return near_vectors(df)
