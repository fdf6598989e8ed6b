"""Path lists, change lists, patches and artifacts kept as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.unpack import with_flags


def read_path_list(
    spark: SparkSession, location: str, repo: str, null_delimited: bool = False
) -> DataFrame:
    """Path list files to distinct ``(repo, path)`` rows.

    Records end with a newline or with NUL; newline records lose one carriage return; empty
    records are dropped and the last one may be open. Spark splits large lists by itself.
    """
    value = F.col("value")
    record = value if null_delimited else F.regexp_replace(value, r"\r\z", "")
    return (
        spark.read.option("lineSep", "\0" if null_delimited else "\n")
        .text(location)
        .select(F.lit(repo).alias("repo"), record.alias("path"))
        .filter(F.col("path") != "")
        .distinct()
    )


def _file_stem() -> Column:
    name = F.substring_index(F.col("_metadata.file_path"), "/", -1)
    return F.url_decode(F.regexp_replace(name, r"\.[^.]*$", ""))


def read_name_status(spark: SparkSession, location: str) -> DataFrame:
    """One NUL-separated change list per file ``<repo>.<ext>``: ``(repo, blob)``.

    Each list becomes a row; :func:`quire.operators.change_lists.read_change_lists` takes lists of any size.
    """
    return (
        spark.read.text(location, wholetext=True)
        .select(_file_stem().alias("repo"), F.col("value").alias("blob"))
    )


def read_patches(spark: SparkSession, location: str) -> DataFrame:
    """Patches archived as Parquet ``(repo, path, patch)``."""
    return spark.read.parquet(location).select("repo", "path", "patch")


def read_artifacts(spark: SparkSession, location: str) -> DataFrame:
    """Artifacts, one whole text file each, named ``<repo>.<ext>``: ``ARTIFACTS`` rows.

    For small ones, each a row. Artifacts written in folders, or of any size, are read by
    :func:`quire.operators.stored_artifacts.unpack_stored`; their folders are refused here.
    """
    texts = spark.read.text(location, wholetext=True)
    if any("/range=" in file for file in texts.inputFiles()):
        raise ValueError(f"{location} holds artifacts in ranges: unpack_stored reads them")
    rows = (
        texts
        .select(_file_stem().alias("repo"), F.col("value").alias("body"))
    )
    return with_flags(rows)
