from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from quire.operators.scale import (
    ensure_checkpoint_dir,
    hot_key_join,
    hot_keys,
    narrow_by_keys,
    running,
    stored,
    temporary_tables,
)


def test_running_totals(spark):
    rng = random.Random(3)
    # One group holds most rows.
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randint(0, 5)}", i, rng.randint(0, 99)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, o int, v int").repartition(7)
    got = {
        (r.g, r.o): (r.row_no, r.sum_before) for r in running(df, ["g"], ["o"], "v").collect()
    }
    expected, seen = {}, {}
    for g, o, v in sorted(rows):
        n, total = seen.get(g, (0, 0))
        expected[(g, o)] = (n + 1, total)
        seen[g] = (n + 1, total + v)
    assert got == expected


def test_running_spreads_a_large_group(spark):
    df = spark.range(20_000).select(F.lit("one").alias("g"), F.col("id").alias("o"))
    slices = df.repartitionByRange(8, "g", "o").select(F.spark_partition_id()).distinct().count()
    assert slices == 8
    numbered = running(df, ["g"], ["o"])
    assert numbered.filter(F.col("row_no") != F.col("o") + 1).count() == 0


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("min_rows", [1, 100, 10**9])
def test_hot_key_join_equals_plain_join(spark, how, min_rows):
    big = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("v")
    )
    small = spark.createDataFrame([(k, f"n{k}") for k in (0, 1, 2, 70)], "k bigint, name string")
    hot = hot_keys(big, ["k"], big.count(), min_rows)
    assert (hot is None) == (min_rows > 3000)
    joined = hot_key_join(big, small, ["k"], hot, F.col("v"), how)
    plain = big.join(small, ["k"], how)
    assert joined.columns == plain.columns
    assert sorted(map(tuple, joined.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_pieces_follow_the_rows_of_a_key(spark):
    big = spark.range(60_000).select(
        F.when(F.col("id") < 50_000, 0).when(F.col("id") < 52_000, 1).otherwise(F.col("id")).alias("k"), "id")
    small = spark.createDataFrame([(0, "a"), (1, "b"), (55_000, "c")], "k bigint, name string")
    hot = hot_keys(big, ["k"], 60_000, 1_000)
    assert {r.k: r._pieces for r in hot.collect()} == {0: 100, 1: 4}
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = hot_key_join(big, small, ["k"], hot, F.col("id"), "inner")
        met = joined.groupBy("k", F.spark_partition_id().alias("task")).count()
        assert met.agg(F.max("count")).head()[0] <= 2_000 and joined.count() == 52_001
        assert met.filter("k = 0").count() > 60
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        for name in ("adaptive.enabled", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")


def test_temporary_tables_are_dropped(spark):
    kept = stored(spark.range(3))
    with temporary_tables(spark):
        inner = stored(spark.range(4))
        with temporary_tables(spark):
            assert stored(inner).count() == 4
        folder = inner.inputFiles()[0]
        assert inner.count() == 4
    assert not os.path.exists(folder.removeprefix("file://").removeprefix("file:"))
    assert kept.count() == 3


@pytest.mark.parametrize("limit", [0, 10_000])
def test_narrow_by_keys(spark, limit):
    big = spark.range(50).withColumnRenamed("id", "k")
    keys = spark.createDataFrame([(3,), (3,), (7,), (99,)], "k bigint")
    got = narrow_by_keys(big, keys, ["k"], broadcast_bytes=limit)
    assert sorted(r.k for r in got.collect()) == [3, 7]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in plan) or limit == 0


def test_stored_tables_go_to_the_checkpoint_folder(spark):
    ensure_checkpoint_dir(spark)
    df = stored(spark.range(5).withColumn("x", F.rand()))
    assert df.inputFiles()[0].removeprefix("file://").startswith(
        spark.sparkContext.getCheckpointDir().removeprefix("file:").replace("//", "/")
    )
    # A second read gives the same random values.
    assert df.collect() == df.collect()
