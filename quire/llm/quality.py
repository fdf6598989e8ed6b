"""Quality rules as a short-circuit cascade, ordered by rejection per cost on a sample."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, let, words

#: Rows on which cost and selectivity are estimated. Only the order of the rules depends on them.
SAMPLE_ROWS = 2_000
#: Words in a repeated window.
WINDOW = 8


def with_text_measures(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """Append n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, all bigint.

    A null or empty text gives zeros. Windows are compared by a 64-bit hash of their words, so
    two different windows of one text count as equal with a chance of about n*n / 2^65.
    Existing columns of these names are replaced.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    listed = df.withColumn("_words", words(F.col(text)))
    return listed.withColumns({
        f"{prefix}n_words": F.size("_words").cast("bigint"),
        f"{prefix}word_chars": F.char_length(F.array_join("_words", "")).cast("bigint"),
        f"{prefix}n_symbols": F.length(F.regexp_replace(raw, "[^#*$%&|<>]+", "")).cast("bigint"),
        f"{prefix}n_dup_lines": duplicate_lines(raw),
        f"{prefix}n_repeat_words": repeated_words(F.col("_words")),
    }).drop("_words")


def worded_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line of the text."""
    return let(
        worded_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))
    ).cast("bigint")


def repeated_words(listed: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window found twice or more in the list; ``window`` is a power of two."""

    def doubled(hashes: Column, step: int) -> Column:
        return F.transform(hashes, lambda h, i: F.xxhash64(h, F.get(hashes, i + F.lit(step))))

    def build(hashes: Column, step: int) -> Column:
        if step == window:
            count = F.greatest(F.size(hashes) - F.lit(window - 1), F.lit(0))
            return let(F.slice(hashes, F.lit(1), count), lambda full: F.when(
                F.size(F.array_distinct(full)) < F.size(full), covered_words(full, window)
            ).otherwise(F.lit(0)))
        return let(doubled(hashes, step), lambda next_: build(next_, step * 2))

    return F.when(F.size(listed) <= window, F.lit(0).cast("bigint")).otherwise(
        let(F.transform(listed, lambda w: F.xxhash64(w)), lambda h: build(h, 1)).cast("bigint")
    )


def covered_words(hashes: Column, window: int) -> Column:
    """Size of the union of all windows whose hash occurs more than once."""

    def repeated(pairs: Column) -> Column:
        return F.filter(pairs, lambda p, k: F.coalesce(
            (p["h"] == F.get(pairs, k - 1)["h"]) | (p["h"] == F.get(pairs, k + 1)["h"]),
            p["h"] == F.get(pairs, k - 1)["h"], p["h"] == F.get(pairs, k + 1)["h"], F.lit(False),
        ))

    pairs = F.array_sort(
        F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    places = F.array_sort(F.transform(let(pairs, repeated), lambda p: p["i"]))
    start = F.struct(F.lit(0).alias("total"), F.lit(-window).alias("last"))
    return F.aggregate(places, start, lambda acc, i: F.struct(
        (acc["total"] + F.least(F.lit(window), i - acc["last"])).alias("total"), i.alias("last")
    ))["total"]


@dataclass(frozen=True)
class Rule:
    """A named test; ``rejects`` gets the text column and returns a boolean column."""

    name: str
    rejects: Callable[[Column], Column]


def default_rules() -> list[Rule]:
    """Conservative rules: each rejects only what ordinary prose of any length does not do."""
    raw = lambda text: F.coalesce(text, F.lit(""))
    return [
        Rule("few_words", lambda t: F.size(words(t)) < 20),
        Rule("repeated_windows", lambda t: let(
            words(t), lambda w: F.lit(100) * repeated_words(w) > F.lit(30) * F.size(w))),
        *method_rules(),
    ]


def method_rules() -> list[Rule]:
    raw = lambda text: F.coalesce(text, F.lit(""))
    return [
        Rule("symbols", lambda t: F.lit(10) * F.length(
            F.regexp_replace(raw(t), "[^#*$%&|<>]+", "")) > F.size(words(t))),
        Rule("duplicate_lines", lambda t: let(worded_lines(raw(t)), lambda lines: F.lit(10) * (
            F.size(lines) - F.size(F.array_distinct(lines))) > F.lit(3) * F.size(lines))),
        Rule("word_length", lambda t: let(words(t), lambda w: let(
            F.char_length(F.array_join(w, "")),
            lambda n: (n < F.lit(2) * F.size(w)) | (n > F.lit(15) * F.size(w))))),
        Rule("no_letters", lambda t: F.lit(2) * F.regexp_count(
            raw(t), F.lit(r"\p{L}[^\x20\x09-\x0D]*")) < F.size(words(t))),
    ]


def order_rules(
    df: DataFrame, rules: list[Rule], text: str = "text", sample_rows: int = SAMPLE_ROWS
) -> list[Rule]:
    """Rules by rejections per second on a sample of at most ``sample_rows`` rows.

    Each rule runs alone over the stored sample: the better of two times, less the time of an
    empty pass, is its cost, the share of rows that it rejects its selectivity. The order
    changes the work and never the verdict, so a noisy clock does no harm. An empty table keeps
    the given order.
    """
    total = df.count()
    if not total or len(rules) < 2:
        return list(rules)
    scratch = Scratch(df.sparkSession)
    share = min(1.0, 2.0 * sample_rows / total)
    sample = scratch.store(
        df.select(F.col(text).alias("text")).sample(False, share, 17).limit(sample_rows)
    )

    def run(reject: Column) -> tuple[float, int]:
        best, hits = float("inf"), 0
        for _ in range(2):
            began = time.perf_counter()
            hits = sample.agg(F.count_if(reject)).head()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    idle, _ = run(F.length("text") < 0)
    measured = []
    for rule in rules:
        seconds, hits = run(rule.rejects(F.col("text")))
        measured.append((hits / max(seconds - idle, 1e-3), rule))
    scratch.drop()
    return [rule for _, rule in sorted(measured, key=lambda m: -m[0])]


def passes(rules: list[Rule], text: Column) -> Column:
    """True when no rule rejects; later rules are evaluated only on what earlier ones let through."""
    verdict = F.lit(True)
    for rule in reversed(rules):
        verdict = F.when(rule.rejects(text), F.lit(False)).otherwise(verdict)
    return verdict


def quality_report(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The measures of every row, ``base_failed`` and ``kept``.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in repeated windows. Null,
    empty and blank texts fail. Repeated rows are judged one by one, equal texts alike; other
    columns of the table, whatever their names, are not read. One pass, no shuffle.
    """
    rules = order_rules(df, method_rules(), text)
    measured = with_text_measures(df.select(F.col(key), F.col(text).alias("_text")), "_text")
    failed = (F.col("n_words") < 20) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words")
    )
    return measured.withColumn("base_failed", failed).select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("base_failed"), F.lit(False)).otherwise(
            passes(rules, F.col("_text"))
        ).alias("kept"),
    )


def quality_filter(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows that no rule of the whole cascade rejects, with all their columns."""
    return df.filter(passes(order_rules(df, default_rules(), text), F.col(text)))
