"""How filters of a cascade depend on their order: forward and backward path counting.

The sets of filters already applied form a lattice; an order of the filters is a path from the empty
set to the full one. An edge from set S to S + f is filter f at work after those of S, whatever the
order within S. So a corpus needs one count per edge, not one per order: the paths that reach S times
those that leave S + f say in how many orders the edge is walked. Shapley sums weight the removals of
edges with these numbers, and the steps of each single order read the same edges.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, let, words

#: Orders are listed in full, so their number, the factorial, must stay small.
MOST_FILTERS = 6


def path_counts(n: int) -> tuple[list[int], list[int]]:
    """Number of orders that reach each subset of ``n`` filters, and that lead on from it to the full set."""
    forward, backward = [0] * 2**n, [0] * 2**n
    forward[0] = backward[-1] = 1
    for state in range(1, 2**n):
        forward[state] = sum(forward[state ^ 1 << f] for f in range(n) if state >> f & 1)
    for state in reversed(range(2**n - 1)):
        backward[state] = sum(backward[state | 1 << f] for f in range(n) if not state >> f & 1)
    return forward, backward


def audit(rows: DataFrame, filters: list[str], part: str, measures: dict[str, Column] | None = None) -> DataFrame:
    """Effect of every filter at every step of every order, for each value of ``part``.

    ``filters`` are boolean columns of ``rows`` named by one letter each, true where the filter
    fails the row (null: false). ``measures`` are conditions whose rows are counted when removed (null: false). Returns
    (part, filter_order, step, kept, removed, redundant, unique_fails, one column per measure,
    shapley); a null part is one of the parts. Rows are reduced to counts of
    failure sets by partial aggregation, so no part is ever gathered: from there on a part is at most 2^n
    counts. A table without rows has no parts.
    """
    n, letters = len(filters), "".join(filters)
    if not 1 <= n <= MOST_FILTERS or len(letters) != n:
        raise ValueError(f"between one and {MOST_FILTERS} filters with names of one letter can be audited")
    measures = measures or {}
    names = ["_n", *(f"_m{i}" for i in range(len(measures)))]
    failed = sum((F.when(F.col(f), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    cells = rows.groupBy(F.col(part).alias("_part"), failed.alias("_failed")).agg(
        F.count(F.lit(1)).alias("_n"),
        *(F.count_if(F.coalesce(c, F.lit(False))).alias(name) for c, name in zip(measures.values(), names[1:], strict=True)))
    parts = cells.groupBy("_part").agg(F.collect_list(F.struct("_failed", *names)).alias("_cells"))

    def total(name: str, wanted) -> Column:
        return F.aggregate("_cells", F.lit(0).cast("bigint"), lambda s, c: s + F.when(wanted(c["_failed"]), c[name]).otherwise(0))

    forward, backward = path_counts(n)
    # alive[name][S]: rows that no filter of S fails.
    alive = [F.array(*(total(name, lambda x, s=s: x.bitwiseAND(s) == 0) for s in range(2**n))).alias(f"_alive{name}")
             for name in names]
    unique = F.array(*(total("_n", lambda x, f=f: x == 1 << f) for f in range(n))).alias("_unique")
    counted = parts.select("_part", unique, *alive)

    def edge(name: str, state: Column, bit: Column) -> Column:
        alive = F.col(f"_alive{name}")
        return F.get(alive, state) - F.get(alive, state.bitwiseOR(bit))

    shapley = F.array(*(
        sum((edge("_n", F.lit(s), F.lit(1 << f)) * (forward[s] * backward[s | 1 << f])
             for s in range(2**n) if not s >> f & 1), F.lit(0).cast("bigint"))
        for f in range(n)))
    orders = F.split(F.lit(",".join("".join(p) for p in itertools.permutations(letters))), ",")
    index = F.position(F.col("_letter"), F.lit(letters)) - 1
    steps = (
        counted.withColumn("_shapley", shapley)
        .withColumn("filter_order", F.explode(orders))
        .withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
        .withColumn("_letter", F.substr("filter_order", F.col("step"), F.lit(1)))
        .withColumn("_f", index.cast("int"))
        .withColumn("_bit", F.element_at(F.array(*(F.lit(1 << f) for f in range(n))), F.col("_f") + 1))
        .withColumn("_state", F.aggregate(
            F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0),
            lambda s, c: s + F.pow(F.lit(2), F.position(c, F.lit(letters)) - 1).cast("int")))
    )
    state, bit = F.col("_state"), F.col("_bit")
    everything = F.get("_alive_n", F.lit(0))
    fails = everything - F.get("_alive_n", bit)
    removed = edge("_n", state, bit)
    return steps.select(
        F.col("_part").alias(part), "filter_order", "step",
        F.get("_alive_n", state.bitwiseOR(bit)).alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        F.get("_unique", F.col("_f")).alias("unique_fails"),
        *(edge(name, state, bit).alias(shown) for shown, name in zip(measures, names[1:], strict=True)),
        F.get("_shapley", F.col("_f")).alias("shapley"))


def text_failures(text: Column) -> list[Column]:
    """The filters A to D as failure conditions of one text: short, repetitive, shouting, with symbols."""
    text = F.coalesce(text, F.lit(""))
    counts = let(words(text), lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")))
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    return [
        counts.alias("_counts"),
        (100 * capitals.cast("bigint") > 10 * F.char_length(text)).alias("C"),
        text.rlike(r"[#$%&*|]").alias("D"),
    ]


def interaction_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Audit of five document filters by language.

    A null text is the empty text, a null language the part ''. E fails rows whose text some row with
    a smaller doc_id has as well; rows with equal doc_id don't fail each other, and a null doc_id is neither
    smaller nor larger than another. A doc_id with several labels counts as good, or toxic, if any of them says
    so. Each text is read once; what is compared, joined and counted afterwards are rows of some 50 bytes.
    The smallest doc_id of a text comes from partial minima and is looked up by (text, doc_id), so copies that
    hold a third of all rows are neither gathered nor joined with one another.
    """
    scratch = Scratch(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    judged = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("_digest"), *text_failures(F.col("text")))
    counts = F.col("_counts")
    narrow = scratch.store(judged.select(
        "doc_id", "part", "_digest", (counts["n"] < 100).alias("A"),
        (100 * counts["distinct"].cast("bigint") < 80 * counts["n"]).alias("B"), "C", "D"), "failures")
    first = narrow.filter("doc_id IS NOT NULL").groupBy("_digest").agg(F.min("doc_id").alias("doc_id"))
    known = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.col("quality") == 1)).alias("_good"), F.max(F.col("toxic") == 1).alias("_toxic"))
    rows = (
        narrow.join(first.withColumn("_first", F.lit(True)), ["_digest", "doc_id"], "left")
        .withColumn("E", F.col("doc_id").isNotNull() & F.col("_first").isNull())
        .join(known, "doc_id", "left")
    )
    return audit(rows, list("ABCDE"), "part", {"good_lost": F.col("_good"), "toxic_lost": F.col("_toxic")})
