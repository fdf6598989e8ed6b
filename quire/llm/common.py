"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scale import ensure_checkpoint_dir

#: Runs of the six ASCII white-space characters that separate words.
SPACES = r"[\x20\x09-\x0D]+"


class Scratch:
    """Tables of one job in the shared checkpoint folder.

    ``store`` writes a table once and reads it back, which cuts the lineage; a lost executor
    costs a repeated read. ``drop`` deletes the tables that nothing reads any more; the job calls it
    when its result no longer depends on them.
    """

    def __init__(self, spark: SparkSession):
        ensure_checkpoint_dir(spark)
        self.spark = spark
        self.root = f"{spark.sparkContext.getCheckpointDir()}/llm-{uuid.uuid4().hex}"
        self.tables: list[str] = []

    def path(self, name: str = "table") -> str:
        location = f"{self.root}/{len(self.tables)}-{name}"
        self.tables.append(location)
        return location

    def store(self, df: DataFrame, name: str = "table") -> DataFrame:
        location = self.path(name)
        df.write.parquet(location)
        return self.spark.read.schema(df.schema).parquet(location)

    def drop(self, *kept: DataFrame) -> None:
        """Delete all tables but those that ``kept`` reads."""
        needed = {file.rsplit("/", 1)[0] for df in kept for file in df.inputFiles()}
        for location in self.tables:
            if not any(folder.endswith(location.split(":", 1)[-1]) for folder in needed):
                delete(self.spark, location)


def release(scratch: Scratch) -> None:
    """Let Spark delete the shuffle files of steps whose results are stored."""
    gc.collect()
    scratch.spark._jvm.System.gc()


def forget(scratch: Scratch, *tables: DataFrame) -> None:
    """Delete stored tables that no later step reads, and the shuffle files of the steps that are done."""
    for location in {file.rsplit("/", 1)[0] for df in tables for file in df.inputFiles()}:
        delete(scratch.spark, location)
    release(scratch)


def delete(spark: SparkSession, location: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and use it by name in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def ordered_text(value: Column) -> Column:
    """A string that sorts by code point with null last, and that joins null to null."""
    return F.when(value.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), value))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
