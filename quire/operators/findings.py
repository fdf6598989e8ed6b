"""Secret findings as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire import constants as C
from quire.functions.sensitive import SecretRule, finding_counts
from quire.operators.decisions import decide
from quire.options import ExportOptions


def secret_findings(
    files: DataFrame, options: ExportOptions, rules: tuple[SecretRule, ...] | None = None
) -> DataFrame:
    """Hits per file and rule, for files that pass every check before the content check.

    Rules stay literals in the expression: no join, and texts without a rule's literal part
    skip its regular expression.
    """
    rules = options.secret_rules if rules is None else rules
    # One reference to the reason, so that it is worked out once per file.
    reason = F.coalesce("skip_reason", F.lit(C.SKIP_SENSITIVE_CONTENT))
    readable = decide(files, options).filter(reason == C.SKIP_SENSITIVE_CONTENT)
    return readable.select(
        "repo",
        "path",
        F.explode(finding_counts(F.col("content").cast("string"), rules)).alias("f"),
    ).select("repo", "path", "f.rule", "f.severity", "f.n_hits")
