"""Rendezvous hashing of stable record keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch
from quire.operators.scale import running


def shard_scores(key: Column, weights: Sequence[float]) -> Column:
    """Array of (score, shard): ``-ln(u) / weight`` with u from the hash of key and shard.

    The smallest score wins. A shard's score does not depend on the other shards, so a new
    shard takes rows only into itself and a removed one gives up only its own. A null key hashes
    like any other value.
    """
    wide = F.coalesce(key.cast("string"), F.lit("\u0000null"))

    def score(shard: int, weight: float) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(wide, F.lit(shard)), 11).cast("double")
        unit = (bits + F.lit(0.5)) / F.lit(2.0**53)
        return F.struct((-F.log(unit) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard"))

    return F.array(*[score(k, w) for k, w in enumerate(weights) if w > 0])


def with_shard(
    df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard", grown: str | None = None,
    grown_weight: float = 1.0,
) -> DataFrame:
    """Append the shard of each row, and with ``grown`` its shard if one more were added."""
    scores = shard_scores(F.col(key), [*weights, grown_weight] if grown else weights)
    if not grown:
        return df.withColumn(shard, F.array_min(scores)["shard"])
    n = len(weights)
    return df.withColumn("_scores", scores).withColumns({
        shard: F.array_min(F.filter("_scores", lambda s: s["shard"] < n))["shard"],
        grown: F.array_min("_scores")["shard"],
    }).drop("_scores")


def shard_plan(
    df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 40,
    weights: Sequence[float] | None = None,
) -> DataFrame:
    """Shard and slot of every row: key, size, text_crc32, law, shard, slot, grown_shard.

    Key and shard count alone decide (law ``key``). ``size`` is the UTF-8 length of the text
    plus 16; a null text counts as empty. Slots run from 0 in each shard, in the order of the
    shard, key, checksum and size; rows equal in all of these are interchangeable. The slots
    come from a range partitioning of the whole order, so a shard or a repeated key is spread
    over tasks. A null key is a key of its own. Other columns are not read.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    scratch = Scratch(df.sparkSession)
    narrow = with_shard(
        df.select(
            F.col(key),
            (F.octet_length(raw) + F.lit(16)).cast("bigint").alias("size"),
            F.crc32(raw).alias("text_crc32"),
        ),
        key, weights or [1.0] * shards, "shard", "grown_shard",
    )
    # Repeated rows get different places in the order; the stored table fixes them.
    placed = scratch.store(narrow.withColumn("_row", F.monotonically_increasing_id()))
    order = placed.withColumn("_null", F.col(key).isNull())
    counted = running(order, ["shard"], ["_null", key, "text_crc32", "size", "_row"], row_no="_no")
    return counted.select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_no") - 1).cast("bigint").alias("slot"), "grown_shard",
    )


def write_shards(
    df: DataFrame, path: str, key: str = "doc_id", weights: Sequence[float] = (1.0,) * 40,
    shard_files: int = 8,
) -> None:
    """Write all rows and columns as Parquet, one folder per shard.

    A shard is written by up to ``shard_files`` tasks, chosen by the hash of the whole row, so a
    hot key does not fill one task. Files are committed by Spark's committer.
    """
    placed = with_shard(df, key, weights, "_shard")
    piece = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(shard_files))
    placed.repartition("_shard", piece).write.partitionBy("_shard").parquet(path)
