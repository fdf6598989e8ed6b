"""Text files of any size whose lines depend on all lines before them.

Spark reads a large file in splits, and what a line means may be decided far ahead of it: a fence opened in the first split
makes everything a body until it is closed. So a file is read twice. The first pass turns each split into a summary: for every
state in which it may begin, the state in which it ends. Summaries are composed in order, which gives the state at
the beginning of each split, and with it the second pass reads all splits side by side. No task holds more than a split.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: States of up to this many splits are broadcast, at some 60 bytes each; beyond it the lines are moved to them.
BROADCAST_SPLITS = 1_000_000


def read_splits(spark: SparkSession, location: str, separator: str = "\n") -> DataFrame:
    """Records ``(file_key, block, value)``, in their order within each split ``(file_key, block)``."""
    return (
        spark.read.option("lineSep", separator).option("recursiveFileLookup", "true").text(location)
        .select(F.xxhash64("_metadata.file_path").alias("file_key"),
                F.col("_metadata.file_block_start").alias("block"), "value"))


def split_files(spark: SparkSession, location: str) -> DataFrame:
    """``(file_key, file, size)`` of the files behind :func:`read_splits`; empty ones are left out."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(location)
        .select(F.xxhash64("_metadata.file_path").alias("file_key"), F.col("_metadata.file_path").alias("file"),
                F.col("length").alias("size")))


def folder_value(file: Column, name: str) -> Column:
    """Value of a folder ``name=value`` in a file path, null without one."""
    found = F.regexp_extract(file, f"/{name}=([^/]*)/", 1)
    value = decoded(decoded(found))
    return F.when((found == "") | (value == "__HIVE_DEFAULT_PARTITION__"), F.lit(None)).otherwise(value)


def decoded(value: Column) -> Column:
    return F.url_decode(F.replace(value, F.lit("+"), F.lit("%2B")))


def file_stem(file: Column) -> Column:
    name = F.substring_index(file, "/", -1)
    return decoded(F.regexp_replace(name, r"\.[^.]*$", ""))


def scan(records: DataFrame, scanner: Callable[[dict[str, Any]], Any], schema: str) -> DataFrame:
    """Run one scanner per split over its records in order.

    ``scanner(first_row)`` makes it; ``feed(columns)`` takes arrays of consecutive records and ``end()`` follows the last
    one. Both return lists of rows.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, key = None, None
        for batch in batches:
            rows: list[tuple] = []
            columns = {name: batch[name].to_numpy() for name in batch.columns}
            files, blocks = columns["file_key"], columns["block"]
            cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
            for begin, end in zip([0, *cuts], [*cuts, len(batch)], strict=True):
                if begin == end:
                    continue
                here = (files[begin], blocks[begin])
                if here != key:
                    if current is not None:
                        rows += current.end()
                    current, key = scanner({n: c[begin] for n, c in columns.items()}), here
                rows += current.feed({n: c[begin:end] for n, c in columns.items()})
            yield pd.DataFrame(rows, columns=names)
        if current is not None:
            yield pd.DataFrame(current.end(), columns=names)

    return records.mapInPandas(run, schema)


def begin_states(
    summaries: DataFrame, start: Any, step: Callable[[Any, str, int], Any], end: Callable[[Any, pd.DataFrame], str]
) -> DataFrame:
    """State at the beginning of every split: ``(repo, file_key, block, split_no, state, status)``.

    ``summaries`` is ``(repo, folder, file, size, file_key, block, summary)``, one small row per split. ``step(state, summary,
    split_no)`` leads over a split and ``end(state, splits)`` is the verdict on the whole text, which every
    row carries. Splits count from 0 in the order of folder, file and block.
    """
    import json

    def compose(key: tuple, splits: pd.DataFrame) -> pd.DataFrame:
        splits = splits.fillna({"folder": ""}).sort_values(["folder", "file", "block"], kind="stable")
        state, rows = start, []
        for number, (file_key, block, summary) in enumerate(
                zip(splits["file_key"], splits["block"], splits["summary"], strict=True)):
            rows.append((key[0], file_key, block, number, json.dumps(state)))
            state = step(state, summary, number)
        found = pd.DataFrame(rows, columns=["repo", "file_key", "block", "split_no", "state"])
        found["status"] = end(state, splits)
        return found

    return summaries.groupBy("repo").applyInPandas(
        compose, "repo string, file_key bigint, block bigint, split_no bigint, state string, status string")


def with_states(records: DataFrame, states: DataFrame, most: int = BROADCAST_SPLITS) -> DataFrame:
    """Records with the state of their split, in order. ``states`` should be stored; splits without a state are left out."""
    keys = ["file_key", "block"]
    if states.count() <= most:
        return records.join(F.broadcast(states), keys)
    numbered = records.withColumn("_at", F.monotonically_increasing_id())
    return numbered.join(states.hint("shuffle_merge"), keys).sortWithinPartitions(*keys, "_at").drop("_at")
