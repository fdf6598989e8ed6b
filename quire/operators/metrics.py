"""Artifact sizes, token estimates and the token budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import estimate_tokens
from quire.operators.render import FILES
from quire.operators.scale import HOT_KEY_ROWS, hot_key_join, pieces_of
from quire.options import ExportOptions


class TokenBudgetExceeded(RuntimeError):
    """Some artifact is estimated above ``max_tokens``; nothing was written."""


def artifact_metrics(blocks: DataFrame, options: ExportOptions) -> DataFrame:
    """Files, bytes, tokens and verdict of every artifact.

    Tokens are estimated from the whole artifact. Both limits are exclusive; a
    ``max_tokens`` of 0 is no limit.
    """
    tokens = F.col("estimated_tokens")
    verdict = F.when(tokens > options.warn_tokens, "warn").otherwise("ok")
    if options.max_tokens:
        verdict = F.when(tokens > options.max_tokens, "fail").otherwise(verdict)
    return (
        blocks.groupBy("repo")
        .agg(
            F.count_if(F.col("section") == FILES).alias("files_exported"),
            F.sum("n_bytes").alias("bytes_written"),
        )
        .withColumn("estimated_tokens", estimate_tokens(F.col("bytes_written")))
        .withColumn("verdict", verdict)
    )


def within_budget(
    blocks: DataFrame, metrics: DataFrame, min_hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """Blocks of artifacts that may be written. ``metrics`` should be stored."""
    failed = metrics.filter(F.col("verdict") == "fail").select("repo")
    # Every file is a block, so the counts are already there.
    large = metrics.filter(F.col("files_exported") >= min_hot_rows).select(
        "repo", pieces_of(F.col("files_exported"), max(min_hot_rows, 1)).alias("_pieces"))
    return hot_key_join(
        blocks,
        failed,
        ["repo"],
        None if large.isEmpty() else large,
        F.concat_ws("\0", F.col("section").cast("string"), "order_key"),
        "left_anti",
    ).select(*blocks.columns)


def require_budget(metrics: DataFrame) -> None:
    """Raise when any artifact is over the limit; looks at one row."""
    worst = metrics.filter(F.col("verdict") == "fail").select("repo", "estimated_tokens").head(1)
    if worst:
        raise TokenBudgetExceeded(
            f"artifact of {worst[0].repo!r} is estimated at {worst[0].estimated_tokens} tokens"
        )
