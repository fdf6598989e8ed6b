"""Mixing sources to token targets by entropy balancing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Scratch, ordered_text, words
from quire.operators.scale import hot_key_join, hot_keys, running

#: No document is taken more often than this, and no source beyond this multiple of its size.
MOST_COPIES = 2
#: Newton steps end when every source is this close to its target, relatively, or after MAX_STEPS.
TOLERANCE = 1e-9
#: Sums of the dual are taken in units of one by this.
FIXED_POINT = float(1 << 20)
MAX_STEPS = 60
#: Copies are broadcast to the rows up to this size and shuffled beyond.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Starting points of the rounding that are tried per source.
OFFSETS = 64


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float) -> DataFrame:
    """Targets by source: (_source, source_size) to (_source, source_size, target).

    Sources in order get the weights in turn and share ``share`` times all sizes; a target stops
    at MOST_COPIES times its source's size and the excess goes to the others by weight. The
    shared level grows from step to step and every step stops at least one more source, as
    water filling does; a step is one aggregate over the table of sources.
    """
    ranked = _ranked(sizes)
    weight = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"),
    )
    scratch = Scratch(sizes.sparkSession)
    weighted = scratch.store(ranked.withColumn("_weight", weight))
    cap = F.lit(float(MOST_COPIES)) * F.col("source_size")
    total = share * float(weighted.agg(F.coalesce(F.sum("source_size"), F.lit(0))).head()[0])
    level = 0.0
    while True:
        stopped = cap <= F.lit(level) * F.col("_weight")
        spent, open_weight = weighted.agg(
            F.coalesce(F.sum(F.when(stopped, cap)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("_weight"))), F.lit(0.0)),
        ).head()
        if open_weight == 0 or (total - spent) / open_weight <= level:
            break
        level = (total - spent) / open_weight
    return weighted.select(
        "_source", "source_size", F.least(cap, F.lit(level) * F.col("_weight")).alias("target")
    )


def _ranked(sizes: DataFrame) -> DataFrame:
    """Position of each source; one constant group, range-partitioned so no task holds all."""
    return running(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_source"], row_no="_rank")


def rate(tilt: Column, size: Column, mean: Column) -> Column:
    """Tilted rate of a document: exp(tilt * size / mean), at most MOST_COPIES."""
    exponent = F.least(tilt * size / mean, F.lit(50.0))
    return F.least(F.exp(exponent), F.lit(float(MOST_COPIES)))


def exact_sum(value: Column) -> Column:
    """Sum in fixed point, so that it does not depend on the order in which tasks deliver their parts."""
    return F.sum(F.round(value * F.lit(FIXED_POINT)).cast("decimal(38,0)")).cast("double") / F.lit(FIXED_POINT)


def solve_tilts(scratch: Scratch, groups: DataFrame, targets: DataFrame) -> DataFrame:
    """Dual variables: (_source, target, mean, tilt).

    Minimizing the relative entropy of the rates to 1 under ``sum(rate * size) = target`` and
    ``rate <= MOST_COPIES`` has a convex dual with one variable per source. A step is one
    aggregate over the (source, size) counts: value and slope of the token sum, then Newton's
    step, replaced by bisection where it leaves the bracket. The variables of all sources move
    together as a small table, stored after each step.
    """
    means = groups.filter("_size > 0").groupBy("_source").agg(
        (F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("mean"))
    # exp(tilt * size / mean) reaches the cap for every size >= 1 within this bracket.
    state = scratch.store(targets.join(means, "_source").select(
        "_source", "target", "mean", "source_size", F.lit(0.0).alias("tilt"),
        (F.lit(-60.0) * F.col("mean")).alias("low"), (F.lit(1.0) * F.col("mean")).alias("high"),
    ))
    for _ in range(MAX_STEPS):
        taken = rate(F.col("tilt"), F.col("_size"), F.col("mean"))
        tokens = F.col("_n") * F.col("_size") * taken
        slope = F.when(taken < MOST_COPIES, tokens * F.col("_size") / F.col("mean")).otherwise(0.0)
        moved = groups.filter("_size > 0").join(state, "_source")
        sums = moved.groupBy("_source", "target", "mean", "source_size", "tilt", "low", "high").agg(
            exact_sum(tokens).alias("value"), exact_sum(slope).alias("slope"))
        gap = F.col("value") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > F.col("_low")) & (newton < F.col("_high"))
        stepped = scratch.store(sums.withColumns({"_low": low, "_high": high}).select(
            "_source", "target", "mean", "source_size",
            F.when(gap == 0, F.col("tilt")).when(inside, newton)
            .otherwise((F.col("_low") + F.col("_high")) / 2).alias("tilt"),
            F.col("_low").alias("low"), F.col("_high").alias("high"),
            (F.abs(gap) / F.greatest(F.col("target"), F.lit(1.0))).alias("_off"),
            F.col("tilt").alias("_was"),
        ))
        worst = stepped.agg(F.max("_off")).head()[0]
        if worst is None or worst <= TOLERANCE:
            return stepped.select("_source", "target", "mean", F.col("_was").alias("tilt"))
        state = stepped.drop("_off", "_was")
    return state.select("_source", "target", "mean", "tilt")


def mix(
    df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
) -> DataFrame:
    """How often each row is taken: key, size, source_size, target, taken, copies, row.

    ``size`` is the number of words (null and empty texts: 0, never taken). A null source is a
    source of its own, last in order. The rates are rounded by cumulative sums in the order
    (size, key, row) of each source: a row gets the floor or the ceiling of its rate, and a
    source misses its target by no more than its largest document. Rows that are equal in
    source, size and key are interchangeable; of OFFSETS starting points each source takes the one
    that comes nearest to its target. Other columns are not read. All steps work on
    (source, size) counts or on narrow rows in range order, so neither a hot source nor a group
    of copies meets in one task.
    """
    scratch = Scratch(df.sparkSession)
    narrow = scratch.store(df.select(
        F.col(key).alias("_key"), ordered_text(F.col(source).cast("string")).alias("_source"),
        F.size(words(F.col(text))).cast("bigint").alias("_size"),
        F.monotonically_increasing_id().alias("_row"),
    ), "narrow")
    groups = scratch.store(
        narrow.groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n")), "groups")
    sizes = scratch.store(
        groups.groupBy("_source").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size")))
    targets = scratch.store(source_targets(sizes, weights, share), "targets")
    tilts = solve_tilts(scratch, groups, targets)
    # One row per distinct size in a window: the counts bound it, not the documents.
    before = Window.partitionBy("_source").orderBy("_size").rowsBetween(
        Window.unboundedPreceding, -1)
    full = F.col("target") >= F.lit(float(MOST_COPIES)) * F.col("source_size")
    rated = scratch.store(
        groups.join(targets, "_source")
        .join(tilts.select("_source", "mean", "tilt"), "_source", "left")
        .withColumn("_rate", F.when(F.col("_size") == 0, 0.0).when(full, float(MOST_COPIES))
                    .otherwise(rate(F.col("tilt"), F.col("_size"), F.col("mean"))))
        .withColumn("_before", F.coalesce(F.sum(F.col("_rate") * F.col("_n")).over(before), F.lit(0.0)))
        .select("_source", "_size", "_n", "source_size", "target", "_rate", "_before")
    )
    tried = F.explode(F.sequence(F.lit(0), F.lit(OFFSETS - 1)))
    offset = (F.col("_try") + F.lit(0.5)) / F.lit(float(OFFSETS))
    up = F.floor(F.col("_before") + F.col("_n") * F.col("_rate") + offset) - F.floor(
        F.col("_before") + offset)
    chosen = (
        rated.withColumn("_try", tried).groupBy("_source", "target", "_try")
        .agg(F.sum(up * F.col("_size")).alias("_taken"))
        .groupBy("_source").agg(F.min_by(
            (F.col("_try") + F.lit(0.5)) / F.lit(float(OFFSETS)),
            F.struct(F.abs(F.col("_taken") - F.col("target")), "_try")).alias("_offset"))
    )
    rated = scratch.store(rated.join(chosen, "_source").drop("_n"), "rated")
    placed = running(
        narrow.withColumn("_no_key", F.col("_key").isNull()),
        ["_source", "_size"], ["_no_key", "_key", "_row"], row_no="_no")
    total = narrow.count()
    hot = hot_keys(narrow, ["_source", "_size"], total)
    joined = hot_key_join(placed, rated, ["_source", "_size"], hot, F.col("_row"), "inner")
    level = lambda n: F.floor(F.col("_before") + n * F.col("_rate") + F.col("_offset"))
    copies = F.greatest(F.lit(0), F.least(
        F.lit(MOST_COPIES), level(F.col("_no")) - level(F.col("_no") - 1)))
    return joined.withColumn("_copies", copies).select(
        F.col("_key").alias(key), F.col("_size").alias("size"), "source_size", "target",
        (F.col("_size") * F.col("_copies")).cast("bigint").alias("taken"),
        F.col("_copies").cast("bigint").alias("copies"), F.col("_row").alias("row"),
    )


def mixed(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """All columns, each row as often as the mix takes it.

    ``df`` is read twice and must number its rows alike each time, as a scan of stored files does.
    """
    copies = mix(df, key, text, source).filter("copies > 0").select("row", "copies")
    if df.count() * 16 <= BROADCAST_BYTES:
        copies = F.broadcast(copies)
    # The columns travel as one, so their names cannot clash.
    numbered = df.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"))
    repeated = F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")
    return numbered.join(copies, "row").select("all", repeated).select("all.*")
