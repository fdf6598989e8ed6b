"""Jaccard self-join of shingle sets with token-combination prefixes.

1. Rows with equal sets become one. A set is ordered so that shingles of long words come first;
   its prefix is extended so that a pair that reaches the threshold shares several prefix tokens.
2. Prefix tokens that no other set has are dropped; sets that are left with too few have no
   partner. The others order their tokens by frequency and keep the rarest: enough that a
   pair still shares two of them, either a rare one or two frequent ones. Rare tokens are indexed
   alone, frequent ones as pairs.
3. In a large bucket every set is first compared with one pivot. What is joined with the pivot
   is connected already, so only pairs with a set outside the bucket's main component follow.
4. Sets that share many tokens meet in few of their buckets: an entry names some of the set's
   earlier tokens, and a pair that has one of them in common is left to that token's bucket.
   Candidates must fit in size and in parity sketch, a lower bound on the symmetric difference;
   in large buckets in a sketch with two bits and more for each token as well, as a short one is full there and
   lets all edited copies of a long text pass. The rest are verified on their whole sets. Components follow from the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, forget, release
from quire.llm.components import components
from quire.llm.hashing import U, Group, mix, run_bytes, signed, word_groups

SHINGLE, THRESHOLD = 3, 90
#: Buckets with more sets than this are handled through a pivot; rarer tokens are indexed alone.
HOT_BUCKET = 32
#: Frequent tokens are paired where that gives at most this many entries per token; a set with more
#: of them indexes them alone.
PAIRS_PER_TOKEN = 4
#: An entry names up to this many earlier tokens of its set; one of a pair of frequent tokens names the earlier frequent ones too.
LEAD = 8
#: Prefix tokens are counted in so many slices of their hashes, one after the other; a power of 2.
TOKEN_SLICES = 4
BROADCAST_BYTES = 8 * 1024 * 1024

#: Words of the parity sketch of a set, 64 bits each.
SKETCH = ("s0", "s1", "s2", "s3")
#: Entries of large buckets carry a sketch of at least two bits for each token, up to this many words; a power of 2.
FAR_WORDS = 128
SETS = "row bigint, n int, k1 bigint, k2 bigint, prefix array<bigint>, far array<bigint>, " + ", ".join(f"{s} bigint" for s in SKETCH)


def shingles(group: Group, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a group: (hash, bytes, text), ordered by text and hash.

    The bytes are those of the words, so that a shingle has the same rank in every text.
    """
    h, text = group.hashes, group.text
    first, counts = group.first[:-1], np.diff(group.first)
    total = len(h) - size + 1
    parts = []
    if total > 0:
        gram = mix(h[:total] + U(size))
        for k in range(1, size):
            gram = mix(gram + h[k : total + k])
        valid = np.flatnonzero(text[:total] == text[size - 1 :])
        parts.append((gram[valid], run_bytes(group, valid, size), text[valid]))
    for length in range(1, size):  # texts with fewer words: the whole sequence
        short = np.flatnonzero(counts == length)
        begin = first[short]
        gram = mix(h[begin] + U(length))
        for k in range(1, length):
            gram = mix(gram + h[begin + k])
        parts.append((gram, run_bytes(group, begin, length), short))
    gram, size_, owner = (np.concatenate([p[i] for p in parts]) for i in range(3))
    order = np.lexsort((gram, owner))
    gram, size_, owner = gram[order], size_[order], owner[order]
    keep = np.ones(len(gram), dtype=bool)
    keep[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return gram[keep], size_[keep], owner[keep]


def spare(n: np.ndarray) -> np.ndarray:
    """Tokens by which the first prefix is extended: pairs share one more than this in it."""
    return n // 32


def most_apart(n: np.ndarray, percent: int) -> np.ndarray:
    """Tokens of a set of ``n`` that a partner may lack."""
    return n - -(-percent * n // 100)


def far_sketches(gram: np.ndarray, owner: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Parity sketches of sets of ``n`` tokens, 2 n bits or more each: a token flips one bit.

    Their lengths are powers of 2, and the place of a token in a shorter one is that in a longer one by the remainder, so
    the halves of a sketch, flipped into each other, are the sketch of half the length.
    """
    needed = np.clip(-(-2 * n // 64), len(SKETCH), FAR_WORDS)
    length = np.left_shift(1, np.ceil(np.log2(needed)).astype(np.int64))
    starts = np.concatenate(([0], np.cumsum(length)))
    bit = (gram >> U(8)) & (length[owner] * 64 - 1).astype(U)
    flat = np.zeros(starts[-1], dtype=U)
    np.bitwise_xor.at(flat, starts[owner] + (bit >> U(6)).astype(np.int64), U(1) << (bit & U(63)))
    flat = signed(flat)
    return [flat[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]


def set_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """(row, text) to size, two hashes, the prefix and the sketches of the set; long shingles come first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["row"].to_numpy()
            for group in word_groups(batch["text"].tolist(), lower=True):
                gram, length, owner = shingles(group, size)
                texts = len(group.rows)
                n = np.bincount(owner, minlength=texts)
                sums = [np.zeros(texts, dtype=U) for _ in range(2)]
                for k, salt in enumerate((U(0x51), U(0xA7))):
                    np.add.at(sums[k], owner, mix(gram ^ (salt << U(40))))
                sketch = {s: np.zeros(texts, dtype=U) for s in SKETCH}
                for k, s in enumerate(SKETCH):
                    mine = (gram >> U(6)) % U(len(SKETCH)) == U(k)
                    np.bitwise_xor.at(sketch[s], owner[mine], U(1) << (gram[mine] & U(63)))
                rank = (3 - np.clip(length // (8 * size), 0, 3)).astype(U)
                order = np.lexsort(((rank << U(62)) | (gram >> U(2)), owner))
                starts = np.concatenate(([0], np.cumsum(n)))
                width = np.minimum(n, most_apart(n, percent) + 1 + spare(n))
                tokens = signed(gram[order])
                yield pd.DataFrame({
                    "row": ids[group.rows.start : group.rows.stop], "n": n,
                    "k1": signed(sums[0]), "k2": signed(sums[1]),
                    "prefix": [tokens[s : s + w] for s, w in zip(starts[:-1], width, strict=True)],
                    "far": far_sketches(gram, owner, n),
                    **{s: signed(v) for s, v in sketch.items()}})

    return docs.mapInPandas(run, SETS)


def whole_sets(docs: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for group in word_groups(batch["text"].tolist(), lower=True):
                gram, _, owner = shingles(group, size)
                starts = np.searchsorted(owner, np.arange(len(group.rows) + 1))
                tokens = signed(gram)
                yield pd.DataFrame({
                    "row": batch["row"].to_numpy()[group.rows.start : group.rows.stop],
                    "tokens": [tokens[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]})

    return docs.mapInPandas(run, "row bigint, tokens array<bigint>")


def least_overlap(a: Column, b: Column, percent: int) -> Column:
    """Common tokens that two sets of these sizes need."""
    return F.ceil((a + b) * F.lit(percent) / F.lit(100.0 + percent) - F.lit(1e-9))


def may_differ(percent: int) -> Column:
    """Tokens that only one of the sets x and y may have if they are linked."""
    return F.col("x.n") + F.col("y.n") - least_overlap(F.col("x.n"), F.col("y.n"), percent) * 2


def reachable(percent: int) -> Column:
    """Sizes and sketches allow sets x and y to be linked."""
    apart = may_differ(percent)
    smaller, larger = F.least("x.n", "y.n"), F.greatest("x.n", "y.n")
    seen = sum((F.bit_count(F.col(f"x.{s}").bitwiseXOR(F.col(f"y.{s}"))) for s in SKETCH), F.lit(0))
    return (smaller * 100 >= larger * percent) & (seen <= apart)


def near_by_far(percent: int) -> Column:
    """The long sketches, where entries carry them, allow sets x and y to be linked.

    Sizes that :func:`reachable` lets through at 50 percent and above differ by no more than a factor of two, so one fold
    makes the sketches equally long; where it does not, the pair stays.
    """
    x, y = F.col("x.far"), F.col("y.far")

    def flipped(a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda v, w: v.bitwiseXOR(w))

    def folded(long: Column, words: Column) -> Column:
        return flipped(F.slice(long, F.lit(1), words), F.slice(long, words + 1, words))

    apart = F.when(F.size(x) == F.size(y), flipped(x, y)).when(
        F.size(x) == F.size(y) * 2, flipped(folded(x, F.size(y)), y)).when(
        F.size(y) == F.size(x) * 2, flipped(x, folded(y, F.size(x))))
    seen = F.aggregate(apart, F.lit(0), lambda total, word: total + F.bit_count(word))
    return F.coalesce(seen <= may_differ(percent), F.lit(True))


def shared_tokens(reps: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, t, f) of the prefix tokens that ``f`` sets have, at least two.

    Most prefix tokens belong to one set and are gone after the count. They are counted in slices whose shuffle files go
    before the next, so what lies on disk at a time is a slice of all tokens and the few that are shared.
    """
    slices = []
    for k in range(TOKEN_SLICES):
        tokens = reps.select("sid", F.explode("prefix").alias("t")).filter(F.col("t").bitwiseAND(TOKEN_SLICES - 1) == k)
        shared = tokens.groupBy("t").agg(F.count(F.lit(1)).alias("f")).filter("f > 1")
        slices.append(scratch.store(tokens.join(shared, "t").select("sid", "t", "f"), f"tokens-{k}"))
        del tokens, shared
        release(scratch)
    return reduce(DataFrame.union, slices)


def heads(reps: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Index tokens of each set that can have a partner: (sid, head, often, wide, u).

    ``u`` counts prefix tokens that no other set has; ``head`` holds the rarest others as (f, t),
    ``often`` the frequent ones of these. A set is ``wide`` when its frequent tokens are indexed alone:
    a partner may share only one token, or there are too many to pair them.
    """
    partner = F.ceil(F.col("n") * F.lit(percent) / F.lit(100.0) - F.lit(1e-9))
    need = (F.floor(partner / 32) + 1).cast("int")
    # The tokens of one set: bounded by its prefix.
    ranked = shared.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("f", "t"))).alias("ranked")).join(
        reps.select("sid", "n", F.size("prefix").alias("_w")), "sid").withColumn("need", need).filter(F.size("ranked") >= F.col("need"))
    kept = F.size("ranked") - F.col("need") + F.least(F.col("need"), F.lit(2))
    often = F.filter("head", lambda t: t["f"] > HOT_BUCKET)
    return ranked.withColumn("head", F.slice("ranked", F.lit(1), kept)).withColumn("often", often).select(
        "sid", "head", "often",
        ((F.size("often") > 2 * PAIRS_PER_TOKEN + 1) | (F.col("need") < 2)).alias("wide"),
        (F.col("_w") - F.size("ranked")).alias("u"))


def entries(listed: DataFrame) -> DataFrame:
    """Index entries (sig, sid, wide, lone, label, lead) from heads with the label of each set's component.

    ``lone`` entries serve only pairs of which one set is ``wide``. ``lead`` holds tokens that come before the entry's own
    and whose buckets compare the set as well: two sets that have one of them in common meet there already. They
    are all of them where LEAD holds them, else those with the least hashes among two thirds of them or more, so that sets
    with much in common have the same ones. The entry of two frequent tokens names all frequent ones before the later of
    them as well: sets that share one of these meet in a pair of earlier tokens, so of all pairs they share only the first is left.
    """

    def least(tokens: Column) -> Column:
        return F.slice(F.array_sort(tokens), F.lit(1), F.lit(LEAD))

    split = listed.select(
        "sid", "wide", "label", F.transform("head", lambda t: t["t"]).alias("all"),
        F.transform(F.filter("head", lambda t: t["f"] <= HOT_BUCKET), lambda t: t["t"]).alias("rare"),
        F.transform("often", lambda t: t["t"]).alias("often"))
    # Beginnings of LEAD, 1.5 LEAD, 2 LEAD, 3 LEAD, ... tokens, by number of tokens before an entry.
    doublings = F.sequence(F.lit(0), F.greatest(F.floor(F.log2(F.size("all") / LEAD)), F.lit(0)).cast("int"))
    split = split.withColumn("leads", F.flatten(F.transform(doublings, lambda k: F.array(*[
        least(F.slice("all", F.lit(1), (F.pow(F.lit(2), k) * length).cast("int"))) for length in (LEAD, LEAD * 3 // 2)]))))

    def before(at: Column) -> Column:
        octave = F.floor(F.log2(F.greatest(at, F.lit(LEAD)) / LEAD)).cast("int")
        upper = (at >= F.pow(F.lit(2), octave) * (LEAD * 3 // 2)).cast("int")
        return F.when(at <= LEAD, F.slice("all", F.lit(1), at)).otherwise(F.get("leads", octave * 2 + upper))

    def entry(kind: str, lead: Column, *tokens: Column) -> Column:
        return F.struct(
            F.xxhash64(F.lit(kind), *tokens).alias("sig"), F.lit(kind == "lone").alias("lone"), lead.alias("lead"))

    # Rare tokens come first in a head. Entries of two tokens serve sets that are not wide, which meet in rare ones alone.
    rare = F.transform("rare", lambda t, i: entry("rare", before(i), t))
    lone = F.transform("often", lambda t, i: entry("lone", before(F.size("rare") + i), t))
    pairs = F.flatten(F.transform("often", lambda a, i: F.transform(
        F.slice("often", i + 2, F.size("often")),
        lambda b, j: entry("pair", F.concat(least(F.col("rare")), F.array_remove(
            F.slice("often", F.lit(1), i + 1 + j), a)), F.least(a, b), F.greatest(a, b)))))
    no_entry = F.array().cast("array<struct<sig:bigint,lone:boolean,lead:array<bigint>>>")
    return split.select("sid", "wide", "label", F.explode(F.concat(
        rare, lone, F.when(F.col("wide"), no_entry).otherwise(pairs))).alias("e")
    ).select("sid", "wide", "label", "e.sig", "e.lone", "e.lead")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold."""
    left = sets.select(F.col("sid").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    right = sets.select(F.col("sid").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    common = F.size(F.array_intersect("_ta", "_tb"))
    return pairs.join(left, "a").join(right, "b").withColumn("_c", common).filter(
        F.col("_c") * 100 >= (F.col("_na") + F.col("_nb") - F.col("_c")) * percent).select("a", "b")


def links(reps: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between distinct sets that connect all that belong together; links
    inside one component may be left out."""
    shared = shared_tokens(reps, scratch)
    listed = scratch.store(heads(reps, shared, percent), "heads")
    forget(scratch, shared)
    facts = reps.select("sid", "n", *SKETCH)

    def checked(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.store(pairs.distinct(), f"{name}-candidates")
        release(scratch)
        ids = scratch.store(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), f"{name}-ids")
        wanted = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
        sets = scratch.store(whole_sets(
            texts.join(wanted, F.col("row") == F.col("sid"), "left_semi"), size
        ).select(F.col("row").alias("sid"), F.size("tokens").alias("n"), "tokens"), f"{name}-sets")
        verified = scratch.store(verify(pairs, sets, percent), name)
        forget(scratch, pairs, ids, sets)
        return verified

    # Every set with a frequent token against the token's pivot.
    whole = ["u", "sid", "n", *SKETCH]
    hot = listed.select("sid", "u", F.explode("often.t").alias("t")).join(facts, "sid")
    pivots = hot.groupBy("t").agg(F.min(F.struct(*whole)).alias("y"))
    star = hot.select("t", F.struct(*whole).alias("x")).join(pivots, "t").filter(
        (F.col("x.sid") != F.col("y.sid")) & reachable(percent))
    spokes = checked(star.select(
        F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b")), "spokes")
    roots = components(spokes, scratch)
    # Buckets of one component give no new link. In the others the main component meets only
    # the rest, and the rest itself.
    labelled = listed.join(roots, F.col("sid") == F.col("node"), "left").withColumn(
        "label", F.coalesce("root", "sid"))
    found = scratch.store(entries(labelled), "entries")
    by_label = found.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("_n"), F.max("wide").alias("_wide"))
    useful = by_label.groupBy("sig").agg(
        F.count(F.lit(1)).alias("_labels"), F.max("_wide").alias("_wide"), (F.sum("_n") > HOT_BUCKET).alias("_hot"),
        F.max(F.struct("_n", "label"))["label"].alias("main")).filter("_labels > 1")
    members = scratch.store(
        found.join(useful, "sig").filter("not lone or _wide").join(reps.select("sid", "n", "far", *SKETCH), "sid")
        .withColumn("inner", F.col("label") == F.col("main")).withColumn("far", F.when(F.col("_hot"), F.col("far")))
        .drop("_wide", "_labels", "_hot", "main"), "members")
    del by_label, useful
    forget(scratch, found)

    def joined(left: DataFrame, right: DataFrame, extra: Column) -> DataFrame:
        # Both sides are asked alike, so that one shuffle serves either.
        lone = ~(F.col("x.lone") & F.col("y.lone")) | F.col("x.wide") | F.col("y.wide")
        apart = F.col("x.label") != F.col("y.label")
        first = ~F.arrays_overlap("x.lead", "y.lead")
        return left.alias("x").join(
            right.alias("y"), (F.col("x.sig") == F.col("y.sig")) & lone & apart & extra & first & reachable(percent) & near_by_far(percent)
        ).select(F.least("x.sid", "y.sid").alias("a"), F.greatest("x.sid", "y.sid").alias("b"))

    outer, inner = members.filter("not inner"), members.filter("inner")
    candidates = joined(outer, outer, F.col("x.sid") < F.col("y.sid")).union(joined(inner, outer, F.lit(True)))
    outside = checked(candidates, "links")
    forget(scratch, members)
    return spokes.union(outside)


def near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = THRESHOLD
) -> DataFrame:
    """Per row: key, n_shingles, component_id and ``row``, which is the smallest row of the component
    when ``keeper`` is true.

    Words are lower-cased in A-Z. A text with fewer words than a shingle has its whole sequence as
    one; null and blank texts have an empty set and link with nothing. Rows with equal sets are
    linked; rows that share a key are separate rows. ``component_id`` is the smallest key reachable;
    where no row of a component has a key it is null. Of each component the row with the smallest
    key, then the first in the table, is the ``keeper``; every row with an empty set is one. Other
    columns are not read. ``df`` is read several times and must number its rows alike each time, as
    a scan of stored files does. Sets are told apart by 128 bits, shingles by 64.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    source = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"),
                       F.monotonically_increasing_id().alias("row"))
    sets_of = scratch.store(set_rows(source.select("row", "text"), size, percent), "sets")
    keys = source.select("key", "row")
    equal = ["k1", "k2", "n"]
    reps = scratch.store(
        sets_of.filter("n > 0").groupBy(*equal).agg(F.min("row").alias("sid"), *[F.first(c).alias(c) for c in ("prefix", "far", *SKETCH)]),
        "reps")
    # From here on only the representatives need their prefixes.
    rows_of = scratch.store(sets_of.select("row", *equal), "rows")
    scratch.drop(reps, rows_of)
    release(scratch)
    roots = components(links(reps, source.select("row", "text"), size, percent, scratch), scratch)
    placed = scratch.store(
        reps.select("sid", *equal).join(roots, F.col("sid") == F.col("node"), "left")
        .select(*equal, F.coalesce("root", "sid").alias("root")), "roots")
    linked = scratch.store(
        rows_of.join(placed, equal, "left").join(keys, "row"), "linked")
    best = linked.filter("n > 0").groupBy("root").agg(
        F.min("key").alias("component_id"),
        F.min(F.struct(F.col("key").isNull(), "key", "row"))["row"].alias("_keeper"))
    result = linked.join(best, "root", "left").select(
        F.col("key").alias(key), F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("key")).alias("component_id"),
        (F.col("n").eqNullSafe(0) | (F.col("row") == F.col("_keeper"))).alias("keeper"), "row")
    result = scratch.store(result, "result")
    scratch.drop(result)
    return result


def join_report(df: DataFrame) -> DataFrame:
    return near_duplicates(df).select("doc_id", "n_shingles", "component_id")


def without_near_duplicates(
    df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row of each group of near-duplicates, with all columns: the one with the smallest key."""
    # The columns travel as one, so their names cannot clash.
    numbered = df.select(
        F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("all"))
    dropped = near_duplicates(df, key, text, size, percent).filter("not keeper").select("row")
    if dropped.count() * 16 <= BROADCAST_BYTES:
        dropped = F.broadcast(dropped)
    return numbered.join(dropped, "row", "left_anti").select("all.*")
