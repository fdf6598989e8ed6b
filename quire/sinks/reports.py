"""Reject reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_decisions(decided: DataFrame, location: str, mode: str = "errorifexists") -> None:
    """Rejected files as Parquet, one folder per reason."""
    (
        decided.filter(F.col("skip_reason").isNotNull())
        .write.mode(mode)
        .partitionBy("skip_reason")
        .parquet(location)
    )
