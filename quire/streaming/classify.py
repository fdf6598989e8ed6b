"""Classify and render files as they arrive.

Decisions, descriptions and file blocks look at one row at a time and need no state, so the
batch operators run on a stream as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.decisions import decisions, entries
from quire.operators.render import file_blocks
from quire.options import ExportOptions
from quire.schemas import FILES


def read_file_stream(spark: SparkSession, location: str) -> DataFrame:
    """Parquet files with the ``files`` schema that appear below ``location``."""
    return spark.readStream.schema(FILES).parquet(location)


def _start(rows: DataFrame, location: str, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = rows.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start(location)


def stream_decisions(
    files: DataFrame, options: ExportOptions, location: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append one decision per arriving file."""
    return _start(decisions(files, options), location, checkpoint, available_now)


def stream_file_blocks(
    files: DataFrame, options: ExportOptions, location: str, checkpoint: str,
    available_now: bool = False,
) -> StreamingQuery:
    """Append the printed block of every accepted file."""
    blocks = file_blocks(entries(files, options), options)
    return _start(blocks, location, checkpoint, available_now)
