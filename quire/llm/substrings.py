"""Repeated word runs across documents by seed and extend.

Every window of WINDOW words is assigned to its anchor, the smallest of its SEED-word runs in an
order that prefers long words, whatever white space stands between them. Neighbouring windows with the same anchor form a stretch: the seed
extended both ways as far as the anchor rules. Documents meet on anchors. Where all stretches of an
anchor are equal, the whole stretch is repeated; where they differ, a match begins or ends there,
and its windows are compared one by one. So the maximal repeats are exact, and no pairs of
documents are formed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch, release
from quire.llm.hashing import U, WORDS, Group, mix, run_bytes, run_hash, run_sums, signed, word_groups

WINDOW = 13
SEED = 3
#: Documents to clean are picked by a broadcast of their ids up to this size, else by a shuffle.
BROADCAST_BYTES = 8 * 1024 * 1024
#: Parts in which windows are compared.
SLICES = 4
#: Order of a document without an id: after all others.
LAST = 2**63 - 1

STRETCHES = "anchor bigint, content bigint, doc bigint, body bigint, start int, n int"
WINDOWS = "hash bigint, doc bigint, body bigint, at int"


def body_hashes(group: Group) -> np.ndarray:
    """Hash of the whole word sequence of each text."""
    sums, down = run_sums(group.hashes, WORDS)
    return signed(run_hash(sums, down, group.first[:-1], group.first[1:]))


def stretches(group: Group, window: int = WINDOW, seed: int = SEED) -> dict[str, np.ndarray]:
    """Stretches of a group: anchor, content, text, start (within the text) and windows."""
    h, count = group.hashes, len(group.hashes)
    total = count - window + 1
    if total <= 0:
        return {}
    grams = count - seed + 1
    gram = h[:grams].copy()
    for k in range(1, seed):
        gram = mix(gram) + h[k : grams + k]
    gram = mix(gram)
    length = run_bytes(group, np.arange(grams), seed)
    rank = (3 - np.clip(length // (8 * seed), 0, 3)).astype(U)
    order = (rank << U(62)) | (gram >> U(2))
    best, place = order[:total].copy(), np.arange(total)
    for k in range(1, window - seed + 1):
        other = order[k : total + k]
        better = other < best
        best[better] = other[better]
        place[better] = np.flatnonzero(better) + k
    valid = group.text[:total] == group.text[window - 1 :]
    fresh = valid.copy()
    fresh[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (group.text[1:total] != group.text[: total - 1])
    begin = np.flatnonzero(fresh)
    stops = np.append(np.flatnonzero(fresh | ~valid), total)
    end = stops[np.searchsorted(stops, begin, side="right")]
    sums, down = run_sums(h, WORDS)
    content = run_hash(sums, down, begin, end + window - 1)
    text = group.text[begin]
    return {
        "anchor": signed(gram[place[begin]]), "content": signed(content), "text": text,
        "start": (begin - group.first[text]).astype(np.int32), "n": (end - begin).astype(np.int32),
    }


def order_key(key: str) -> Column:
    return F.coalesce(F.col(key).cast("bigint"), F.lit(LAST))


def find_stretches(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """Stretches of all rows (doc, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs = batch["doc"].to_numpy()
            for group in word_groups(batch["text"].tolist()):
                found = stretches(group, window, seed)
                if found:
                    text = found.pop("text")
                    own = docs[group.rows.start : group.rows.stop]
                    yield pd.DataFrame({
                        "anchor": found["anchor"], "content": found["content"], "doc": own[text],
                        "body": body_hashes(group)[text], "start": found["start"], "n": found["n"]})

    return rows.mapInPandas(run, STRETCHES)


def with_body(rows: DataFrame) -> DataFrame:
    @F.pandas_udf("bigint")
    def body(texts: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([body_hashes(g) for g in word_groups(texts.tolist())]))

    return rows.withColumn("body", body("text"))


def picked(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose doc is in ``ids`` (doc), with a broadcast only below a measured size."""
    if ids.count() * 16 <= BROADCAST_BYTES:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc", "left_semi")


def packed() -> Column:
    """A range as one number, start above and length below 32 bits."""
    return F.shiftleft(F.col("start").cast("bigint"), 32) + F.col("n")


def unpacked(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ranges = np.asarray(places, dtype=np.int64)
    return ranges >> 32, ranges & 0xFFFFFFFF


def within(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each count in turn."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def repeated_ranges(
    rows: DataFrame, scratch: Scratch, window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """Ranges (doc, body, start, n): windows from ``start`` on, ``n`` of them, that also start in
    a document that comes earlier. ``rows`` is (doc, text) with a total order in ``doc``.
    """
    found = find_stretches(rows, window, seed)
    anchors = scratch.store(
        found.groupBy("anchor").agg(
            F.min("doc").alias("low"), F.max("doc").alias("_high"),
            F.min("content").alias("_c"), F.max("content").alias("_d"))
        .filter("low < _high").select("anchor", "low", (F.col("_c") != F.col("_d")).alias("mixed")), "anchors")
    release(scratch)
    shared = scratch.store(
        found.drop("content").join(anchors, "anchor").filter("mixed or doc > low")
        .select("doc", "body", "start", "n", "mixed"), "shared")
    release(scratch)
    whole = shared.filter(~F.col("mixed")).select("doc", "body", "start", "n")
    mixed = scratch.store(
        shared.filter("mixed").groupBy("doc", "body")
        .agg(F.collect_set(packed()).alias("places")), "mixed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            docs, bodies = batch["doc"].to_numpy(), batch["body"].to_numpy()
            places = batch["places"].tolist()
            for group in word_groups(batch["text"].tolist()):
                sums, down = run_sums(group.hashes, WORDS)
                spots = [unpacked(places[row]) for row in group.rows]
                at = [np.unique(np.repeat(s, n) + within(n)) for s, n in spots]
                owner = np.repeat(np.arange(len(at)), [len(a) for a in at])
                at = np.concatenate(at)
                begin = at + group.first[owner]
                rows = owner + group.rows.start
                yield pd.DataFrame({
                    "hash": signed(run_hash(sums, down, begin, begin + window)),
                    "doc": docs[rows], "body": bodies[rows], "at": at.astype(np.int32)})

    ids = scratch.store(mixed.select("doc").distinct(), "ids")
    texts = with_body(picked(rows, ids)).join(mixed, ["doc", "body"])
    windows = scratch.store(texts.mapInPandas(run, WINDOWS), "windows")
    del texts
    release(scratch)
    # Windows are compared one slice of their hashes after the other, so that only a slice is shuffled at a time.
    ranges = whole
    for part in range(SLICES):
        own = windows.filter(F.pmod("hash", F.lit(SLICES)) == part)
        first = own.groupBy("hash").agg(F.min("doc").alias("low"), F.max("doc").alias("_high")).filter("low < _high")
        single = scratch.store(own.join(first, "hash").filter("doc > low").select(
            "doc", "body", F.col("at").alias("start"), F.lit(1).alias("n")), "single")
        ranges = ranges.union(single)
        del own, first
        release(scratch)
    ranges = scratch.store(ranges, "ranges")
    scratch.drop(ranges)
    return ranges


def clean_rows(
    rows: DataFrame, scratch: Scratch, handle, schema: str, window: int = WINDOW, seed: int = SEED
) -> DataFrame:
    """Apply ``handle(words, removed)`` to every row, ``removed`` a boolean array or None.

    Only texts that lose words move; all others are read and finished where they are.
    """
    ranges = repeated_ranges(rows.select("doc", "text"), scratch, window, seed)
    grouped = scratch.store(
        ranges.groupBy("doc", "body").agg(F.collect_set(packed()).alias("places")), "places")
    ids = scratch.store(grouped.select("doc").distinct(), "ids")
    release(scratch)
    names = [f.split()[0] for f in schema.split(", ")]
    kept = [f.name for f in rows.schema if f.name not in ("doc", "text")]
    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in kept], schema])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            results = []
            places = batch["places"].tolist() if "places" in batch else [None] * len(batch)
            for text, spots in zip(batch["text"].tolist(), places, strict=True):
                listed = (text or "").encode().split()
                removed = None
                if spots is not None and len(spots):
                    start, n = unpacked(spots)
                    steps = np.zeros(len(listed) + 1, dtype=np.int64)
                    np.add.at(steps, start, 1)
                    np.add.at(steps, start + n + window - 1, -1)
                    removed = np.cumsum(steps[:-1]) > 0
                results.append(handle(listed, removed))
            frame = batch[kept].reset_index(drop=True)
            for k, name in enumerate(names):
                frame[name] = [r[k] for r in results]
            yield frame

    flagged = F.broadcast(ids) if ids.count() * 16 <= BROADCAST_BYTES else ids
    losing = with_body(rows.join(flagged, "doc", "left_semi")).join(grouped, ["doc", "body"], "left")
    other = rows.join(flagged, "doc", "left_anti")
    return other.mapInPandas(run, out).union(losing.mapInPandas(run, out))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns, with ``text`` reduced to its kept words joined by one space; null stays empty."""
    scratch = Scratch(df.sparkSession)
    other = [c for c in df.columns if c != text]
    rows = df.select(
        order_key(key).alias("doc"), F.col(text).alias("text"),
        F.struct(*[F.col(f"`{c}`") for c in other]).alias("_row") if other else F.lit(None).alias("_row"))

    def handle(listed, removed):
        kept = listed if removed is None else list(compress(listed, ~removed))
        return (b" ".join(kept).decode(),)

    cleaned = clean_rows(rows, scratch, handle, "kept string")
    return cleaned.select("_row.*", F.col("kept").alias(text))


def repeat_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, n_words, n_removed and the digest of the kept words.

    A null or blank text has no words. A row without a key comes after all others and can lose
    words to them, never the other way; rows that share a key count as one document and do not
    affect each other. Repeated rows get the same result. Other columns are not read. Windows and the contents of
    stretches are compared by 64-bit hashes.
    """
    scratch = Scratch(df.sparkSession)
    rows = df.select(order_key(key).alias("doc"), F.col(text).alias("text"), F.col(key).alias(key))

    def handle(listed, removed):
        kept = listed if removed is None else list(compress(listed, ~removed))
        return len(listed), len(listed) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()

    return clean_rows(rows, scratch, handle, "n_words bigint, n_removed bigint, kept_sha256 string")
