"""Renames of edited files: deleted and added paths whose texts share most of their lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import split_lines
from quire.operators.scale import hot_key_join, hot_keys, narrow_by_keys, running, stored

#: Least similarity of a rename, in percent of the lines of both files together.
LEAST_PERCENT = 50
#: Pairs of equal sets are counted out in steps of this many.
PAIR_STEP = 100_000
#: Repositories with up to this many pairs of classes left are matched in one task each.
LOCAL_EDGES = 250_000
#: Matched classes: so many files of each from the given positions on.
MATCHED = "repo string, old_key string, new_key string, score double, old_from bigint, new_from bigint, pairs bigint"


def similar_renames(
    base: DataFrame, head: DataFrame, delta: DataFrame, exact: DataFrame, percent: int = LEAST_PERCENT,
    hot_rows: int | None = None,
) -> DataFrame:
    """Deleted and added paths of a repository, paired by the lines they share.

    ``delta`` comes from :func:`quire.operators.delta.path_delta`, ``exact`` are the renames without an edit,
    whose paths are out; both should be stored. The score of a pair is the number of distinct lines both texts have
    by the number that either has; pairs below ``percent`` are no renames. Pairs are taken greedily by score, then by a
    digest of both line sets, then in path order, each path once, so every run gives the same ones. Files
    that are empty or not valid UTF-8 are never similar. Gives ``(repo, path, change_type, previous_path, score)``.

    Files with equal line sets form a class. Classes, not files, are compared and matched: a
    pair of classes takes as many files as the smaller has left, the n-th with the n-th. Candidates share one of
    their rarest lines: of a set of n lines, those that only one side of the repository has come first, then by the
    number of classes that have them, and n - ceil(percent n / 100) + 1 of them must meet one of any partner's. Lines are
    compared by 64-bit hashes within a repository. A line with many classes behind it is split over several tasks.
    """
    key = ["repo", "path"]
    gone = delta.filter("change_type = 'D'").join(
        exact.selectExpr("repo", "previous_path AS path"), key, "left_anti").select(*key)
    new = delta.filter("change_type = 'A'").join(exact.select(*key), key, "left_anti").select(*key)
    sides = _line_sets(narrow_by_keys(base, gone, key), 0).unionByName(_line_sets(narrow_by_keys(head, new, key), 1))
    files = stored(sides)
    members = stored(running(files.select("repo", "set_key", "side", "path"), ["repo", "set_key", "side"], ["path"], row_no="nth"))
    classes = stored(files.groupBy("repo", "set_key").agg(
        F.first("tokens").alias("tokens"), F.count_if(F.col("side") == 0).alias("olds"), F.count_if(F.col("side") == 1).alias("news")))
    both = F.least("olds", "news")
    equal = classes.filter(both > 0).select(
        "repo", F.col("set_key").alias("old_key"), F.col("set_key").alias("new_key"), F.lit(1.0).alias("score"),
        F.lit(0).cast("bigint").alias("old_from"), F.lit(0).cast("bigint").alias("new_from"), both.alias("pairs"))
    rest = classes.filter(F.col("olds") != F.col("news")).select(
        "repo", "set_key", "tokens", F.size("tokens").alias("n"), (F.col("olds") > F.col("news")).alias("old"),
        both.alias("used"), F.abs(F.col("olds") - F.col("news")).alias("left"))
    edges = stored(_edges(rest, percent, hot_rows))
    matched = equal
    while not edges.isEmpty():
        matched, edges = _take_in_order(matched, edges)
        if not edges.isEmpty():
            matched, edges = _take_best(matched, edges)
    # Long runs of pairs are counted out in two steps, so no row holds more than PAIR_STEP numbers.
    steps = matched.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("pairs") - 1, F.lit(PAIR_STEP))))
    numbered = steps.withColumn("i", F.explode(F.sequence(
        "step", F.least(F.col("step") + PAIR_STEP, "pairs") - 1))).select(
        "repo", "old_key", "new_key", "score", (F.col("old_from") + F.col("i") + 1).alias("old_nth"),
        (F.col("new_from") + F.col("i") + 1).alias("new_nth"))
    olds = members.filter("side = 0").selectExpr("repo", "set_key AS old_key", "nth AS old_nth", "path AS previous_path")
    news = members.filter("side = 1").selectExpr("repo", "set_key AS new_key", "nth AS new_nth", "path")
    return numbered.join(olds, ["repo", "old_key", "old_nth"]).join(news, ["repo", "new_key", "new_nth"]).select(
        "repo", "path", F.lit("R").alias("change_type"), "previous_path", "score")


def _line_sets(files: DataFrame, side: int) -> DataFrame:
    """Sorted distinct lines of each text as hashes, and their digest."""
    text = F.col("content").cast("string")
    readable = files.filter(F.col("content").isNotNull() & (F.octet_length("content") > 0) & F.is_valid_utf8(text))
    lines = readable.select("repo", "path", F.array_sort(F.array_distinct(split_lines(text))).alias("lines"))
    return lines.select(
        "repo", "path", F.lit(side).alias("side"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("set_key"),
        F.transform("lines", lambda x: F.xxhash64(x)).alias("tokens"))


def _edges(classes: DataFrame, percent: int, hot_rows: int | None) -> DataFrame:
    """Pairs of an old and a new class that are similar enough, with what each has left."""
    tokens = stored(classes.select("repo", "set_key", "old", "n", F.explode("tokens").alias("token")))
    rarity = tokens.groupBy("repo", "token").agg(
        F.count(F.lit(1)).alias("classes"), F.max("old").alias("in_old"), F.min("old").alias("all_old"))
    rows = tokens.count()
    hot = hot_keys(tokens, ["repo", "token"], rows, *([hot_rows] if hot_rows else []))
    shared = rarity.select("repo", "token", F.when(F.col("in_old") & ~F.col("all_old"), F.col("classes")).otherwise(0).alias("rank"))
    ranked = hot_key_join(tokens, shared, ["repo", "token"], hot, F.col("set_key"), "inner")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100).cast("int") + 1
    # The lines of one file: bounded by its length.
    prefix = stored(
        ranked.groupBy("repo", "set_key", "old", "n").agg(F.array_sort(F.collect_list(F.struct("rank", "token"))).alias("ordered"))
        .select("repo", "set_key", "old", "n", F.explode(F.slice("ordered", F.lit(1), keep)).alias("t"))
        .filter("t.rank > 0").select("repo", "set_key", "old", "n", F.col("t.token").alias("token")))
    left = prefix.filter("old").select("repo", "token", F.col("set_key").alias("old_key"), F.col("n").alias("old_n"))
    right = prefix.filter("NOT old").select("repo", "token", F.col("set_key").alias("new_key"), F.col("n").alias("new_n"))
    hot = hot_keys(left, ["repo", "token"], rows, *([hot_rows] if hot_rows else []))
    close = 100 * F.least("old_n", "new_n") >= percent * F.greatest("old_n", "new_n")
    pairs = hot_key_join(left, right, ["repo", "token"], hot, F.col("old_key"), "inner").filter(close).select(
        "repo", "old_key", "new_key").distinct()
    olds = classes.filter("old").selectExpr("repo", "set_key AS old_key", "tokens AS old_tokens", "used AS old_from", "left AS old_left")
    news = classes.filter("NOT old").selectExpr("repo", "set_key AS new_key", "tokens AS new_tokens", "used AS new_from", "left AS new_left")
    common = F.size(F.array_intersect("old_tokens", "new_tokens"))
    compared = pairs.join(olds, ["repo", "old_key"]).join(news, ["repo", "new_key"]).withColumn("common", common).withColumn(
        "either", F.size("old_tokens") + F.size("new_tokens") - F.col("common"))
    return compared.filter(100 * F.col("common") >= percent * F.col("either")).select(
        "repo", "old_key", "new_key", (F.col("common") / F.col("either")).alias("score"),
        F.md5(F.concat("old_key", "new_key").cast("binary")).alias("tie"), "old_from", "old_left", "new_from", "new_left")


def _take_in_order(matched: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match the repositories with at most LOCAL_EDGES pairs of classes one pair after the other.

    In a family of edited copies most classes are closest to the same few, so :func:`_take_best` takes as many rounds
    as the family has members; it serves the others until they are small enough.
    """
    counts = stored(edges.groupBy("repo").agg(F.count(F.lit(1)).alias("_edges")))
    # At most one in LOCAL_EDGES rows names such a repository.
    large = F.broadcast(counts.filter(F.col("_edges") > LOCAL_EDGES).select("repo"))
    taken = stored(edges.join(large, "repo", "left_anti").groupBy("repo").applyInPandas(_in_order, MATCHED))
    return matched.unionByName(taken), stored(edges.join(large, "repo", "left_semi"))


def _in_order(edges: pd.DataFrame) -> pd.DataFrame:
    old, new, taken = {}, {}, []
    for e in edges.sort_values(["score", "tie"], ascending=[False, True]).itertuples(index=False):
        old_from, old_left = old.get(e.old_key, (e.old_from, e.old_left))
        new_from, new_left = new.get(e.new_key, (e.new_from, e.new_left))
        pairs = min(old_left, new_left)
        if pairs:
            taken.append((e.repo, e.old_key, e.new_key, e.score, old_from, new_from, pairs))
            old[e.old_key] = old_from + pairs, old_left - pairs
            new[e.new_key] = new_from + pairs, new_left - pairs
    return pd.DataFrame(taken, columns=["repo", "old_key", "new_key", "score", "old_from", "new_from", "pairs"])


def _take_best(matched: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Match every pair of classes that is the best one of both, and take them out of what is left.

    This equals taking all pairs one after the other in order. As ties are broken by a digest, the number of rounds
    grows with the logarithm of the number of pairs, however many have the same score.
    """
    order = F.struct((-F.col("score")).alias("s"), "tie")
    of_old = edges.groupBy("repo", "old_key").agg(F.min(order).alias("best_old"))
    of_new = edges.groupBy("repo", "new_key").agg(F.min(order).alias("best_new"))
    taken = stored(
        edges.join(of_old, ["repo", "old_key"]).join(of_new, ["repo", "new_key"])
        .filter((F.col("best_old") == order) & (F.col("best_new") == order))
        .select("repo", "old_key", "new_key", "score", "old_from", "new_from", F.least("old_left", "new_left").alias("pairs")))
    for side in ("old", "new"):
        less = taken.select("repo", f"{side}_key", F.col("pairs").alias("less"))
        less_rows = F.coalesce("less", F.lit(0))
        edges = edges.join(less, ["repo", f"{side}_key"], "left").withColumn(
            f"{side}_from", F.col(f"{side}_from") + less_rows).withColumn(
            f"{side}_left", F.col(f"{side}_left") - less_rows).drop("less")
    return matched.unionByName(taken), stored(edges.filter("old_left > 0 AND new_left > 0"))
