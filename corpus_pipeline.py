"""Documents to a mixed, encoded training corpus in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, ngram_join, pieces, quality, secrets
from quire.llm.common import Scratch

#: No SQL expresses the mixing and the encoding; tests hold every stage against brute force.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.quality_filter(docs)


def duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: five-word shingles, similarity 0.8 or more."""
    return ngram_join.without_near_duplicates(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark and the length counted anew."""
    return secrets.redact(docs).withColumn("n_chars", F.char_length("text").cast("bigint"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's token target asks for, at most twice."""
    return mixing.mixed(docs)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, whether they decode to its text, and the n-best scores."""
    encoded = pieces.with_pieces(docs, decoded="_decoded")
    return encoded.select(
        "doc_id", "lang", "source", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids",
        "nbest_scores", F.col("_decoded").eqNullSafe(F.col("text")).alias("round_trip"))


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", duplicate_stage),
    ("secret scans", secret_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding and decoding", piece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
