"""Artifacts as files or as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.core import div
from quire.functions.text import without_last_newline
from quire.operators.scale import running, stored
from quire.options import ExportOptions

ORDER = ["section", "order_key"]
#: Size at which an artifact is continued in another row.
PART_BYTES = 32 * 1024 * 1024
#: Size at which a written artifact goes on in another file.
RANGE_BYTES = 128 * 1024 * 1024
#: Parts that one task puts together, 1 GB by default.
CHUNK_PARTS = 32
#: Beginnings of up to this many chunks, some 100 bytes each, are broadcast.
BROADCAST_CUTS = 500_000


def write_artifacts(
    blocks: DataFrame,
    location: str,
    by_repo: bool = True,
    mode: str = "errorifexists",
    partitions: int | None = None,
    sizes: DataFrame | None = None,
) -> None:
    """Write all artifacts as text.

    Every range has a folder ``range=...`` with a number of ten digits, so that names sort like
    numbers whatever their count; files in the order of these folders are the artifacts, byte for byte.
    Output appears only when the job commits, and an existing one is kept unless ``mode`` says otherwise.

    With ``by_repo`` every repository gets its own folder ``repo=...`` around them. Its ranges begin where the running
    total of its bytes (``sizes``, by default those of ``blocks``) passes another RANGE_BYTES, or another of
    ``partitions`` shares of all bytes: a range of short lines holds as many bytes as one of long bodies, and only its last
    block may exceed the share. Without ``by_repo`` one range shuffle orders the blocks over the whole cluster, in
    ``partitions`` ranges or the session's number; there bytes are not weighed.
    """
    keys = ["repo", *ORDER]
    if by_repo:
        # Stored first: the running total reads the sizes twice.
        measured = stored((blocks if sizes is None else sizes).select("repo", *ORDER, "n_bytes"))
        share = RANGE_BYTES
        if partitions is not None:
            share = max(1, -(-(measured.agg(F.sum("n_bytes")).head()[0] or 0) // partitions))
        placed = in_chunks(blocks, measured, share).withColumn("range", range_name(F.col("chunk")))
        folders = ["repo", "range"]
        ordered = placed.repartition(*folders).sortWithinPartitions(*folders, *ORDER)
    else:
        ranged = blocks.repartitionByRange(*keys) if partitions is None else blocks.repartitionByRange(partitions, *keys)
        folders = ["range"]
        # The folders come first in the order, so the writer does not sort once more.
        ordered = ranged.withColumn("range", range_name(F.spark_partition_id())).sortWithinPartitions(*folders, *keys)
    # The text writer ends every row with a newline.
    lines = ordered.select(*folders, without_last_newline(F.col("body")).alias("value"))
    lines.write.mode(mode).partitionBy(*folders).text(location)


def in_chunks(blocks: DataFrame, measured: DataFrame, chunk_bytes: int) -> DataFrame:
    """Blocks with the ``chunk`` of their artifact and the offset at which it starts.

    A chunk begins with the first block at or behind a multiple of ``chunk_bytes``. Offsets come from a distributed running total
    over ``measured``, which gives the places where chunks begin, a table of one entry per chunk behind the first. A
    block looks its chunk up in it, so bodies need not be joined with their offsets.
    """
    offsets = running(measured, ["repo"], ORDER, "n_bytes", before="offset")
    begins = (
        offsets.withColumn("chunk", div(F.col("offset"), chunk_bytes)).filter("chunk > 0").groupBy("repo", "chunk")
        .agg(F.min(F.struct(*ORDER)).alias("first"), F.min("offset").alias("start")))
    cuts = stored(begins.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("first", "chunk", "start"))).alias("cuts")))
    known = cuts.agg(F.sum(F.size("cuts"))).head()[0] or 0
    if known <= BROADCAST_CUTS:
        cuts = F.broadcast(cuts)
    here = F.struct(*ORDER)
    cut = F.try_element_at(F.filter("cuts", lambda c: c["first"] <= here), F.lit(-1))
    return blocks.join(cuts, "repo", "left").withColumn("cut", cut).select(
        *blocks.columns, F.coalesce("cut.chunk", F.lit(0)).alias("chunk"), F.coalesce("cut.start", F.lit(0)).alias("start"))


def range_name(number: Column) -> Column:
    return F.lpad(number.cast("string"), 10, "0")


def artifact_parts(
    blocks: DataFrame, options: ExportOptions, part_bytes: int = PART_BYTES, sizes: DataFrame | None = None
) -> DataFrame:
    """Artifacts as ``ARTIFACTS`` rows of about ``part_bytes``.

    A small repository is one row. A larger one goes on in further rows, cut between blocks,
    so no row ever holds more than one part. Bodies move once, to the task of their chunk of CHUNK_PARTS parts (see
    :func:`in_chunks`), which counts out the parts. ``sizes`` are by default those of ``blocks``.
    """
    # Stored first: the running total reads the sizes twice.
    measured = stored((blocks if sizes is None else sizes).select("repo", *ORDER, "n_bytes"))
    placed = in_chunks(blocks, measured, part_bytes * CHUNK_PARTS)
    earlier = Window.partitionBy("repo", "chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.withColumn(
        "part", div(F.col("start") + F.coalesce(F.sum("n_bytes").over(earlier), F.lit(0)), part_bytes))
    return (
        counted.groupBy("repo", "chunk", "part")
        .agg(F.array_sort(F.collect_list(F.struct(*ORDER, "body"))).alias("pieces"))
        .select(
            "repo",
            "part",
            F.lit(options.line_numbers).alias("line_numbers"),
            F.lit(options.hunks).alias("hunks"),
            F.array_join(F.transform("pieces", lambda p: p["body"]), "").alias("body"),
        )
    )
