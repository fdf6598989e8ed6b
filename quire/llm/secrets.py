"""Secrets in texts: fixed patterns, and tokens that are far likelier as random than as ordinary strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import let

ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]"
    r"|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: A run of the class; the shorter runs that the contract drops cannot match at all.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: What may be random.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")


@dataclass(frozen=True)
class Encoding:
    """An alphabet with what ordinary strings over it do.

    ``changes``: the most that they change between small letters, capitals, digits and signs, per
    pair of neighbours; ``others``: the classes that a change can lead to.
    """

    name: str
    pattern: str
    size: int
    changes: float
    others: int


ENCODINGS = (
    Encoding("hex", "^[0-9a-f]+$", 16, 0.25, 1),
    Encoding("hex_capitals", "^[0-9A-F]+$", 16, 0.25, 1),
    Encoding("base32", "^[A-Z2-7]+$", 32, 0.10, 1),
    Encoding("alphanumeric", "^[A-Za-z0-9]+$", 62, 0.25, 2),
    Encoding("base64", "^[A-Za-z0-9+/]+$", 64, 0.30, 3),
    Encoding("base64url", "^[A-Za-z0-9_-]+$", 64, 0.30, 3),
    Encoding("mixed", "^[A-Za-z0-9+/_-]+$", 66, 0.30, 3),
)
#: Letters of running text in per mille, a to z; a tenth is spread evenly for other languages and names.
FREQUENCIES = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
#: By ASCII code: logarithm of a character's share of its class in ordinary strings.
LETTERS = [
    math.log(0.9 * FREQUENCIES[(c | 32) - 97] / sum(FREQUENCIES) + 0.1 / 26) if chr(c).isalpha()
    else math.log(0.1) if chr(c).isdigit() else math.log(0.25) for c in range(128)]
#: Share of ordered strings, such as counters, among ordinary ones, and of their neighbours that do
#: not follow each other.
ORDERED, APART = 0.125, 0.1
#: Lower ends of the length bands within which the false-discovery rate is held.
BANDS = (20, 28, 40, 64, 128)
FALSE_DISCOVERIES = 0.05
#: P-values are counted in steps of this width of -ln p, rounded towards 1, up to MAX_STEPS steps.
STEP = 0.05
MAX_STEPS = 2_000


def starts(gaps: Column, block: int = 128) -> Column:
    """Running sums before each element, built in blocks so that no long array is copied often."""
    empty = F.array().cast("array<bigint>")

    def inner(at: Column, part: Column) -> Column:
        return F.aggregate(part, F.struct(at.alias("at"), empty.alias("out")), lambda a, x: F.struct(
            (a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def outer(acc: Column, part: Column) -> Column:
        return let(inner(acc["at"], part), lambda r: F.struct(
            r["at"].alias("at"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    last = F.floor((F.size(gaps) - 1) / F.lit(block)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(gaps, b * block + 1, F.lit(block)))
    none = F.array().cast("array<array<bigint>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("out"))
    return F.flatten(F.aggregate(parts, zero, outer)["out"])


def located(text: Column, pattern: str) -> Column:
    """Matches as array of (start, end, match), in code points, end exclusive.

    The parts between the matches come from ``split`` with the same pattern, so the places
    follow from lengths; texts without a match are scanned once.
    """
    kind = "array<struct<start:bigint,end:bigint,match:string>>"

    def places(found: Column) -> Column:
        lengths = let(F.split(text, pattern, -1), lambda parts: F.transform(
            found, lambda m, i: (F.char_length(F.get(parts, i)) + F.char_length(m)).cast("bigint")))
        return let(lengths, lambda n: let(starts(n), lambda s: F.transform(found, lambda m, i: F.struct(
            (F.get(s, i) + F.get(n, i) - F.char_length(m)).alias("start"),
            (F.get(s, i) + F.get(n, i)).alias("end"), m.alias("match")))))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(
        F.size(found) > 0, places(found)).otherwise(F.array().cast(kind)))


def base_spans(text: Column) -> Column:
    """Spans of the three fixed kinds as array of (start, kind, end), sorted."""

    def spans(kind: int, pattern: str) -> Column:
        found = located(text, pattern)
        if kind == 0:
            value = lambda m: F.regexp_extract(m["match"], ASSIGN, 2)
            found = F.filter(found, lambda m: F.char_length(value(m)) >= 6)
        return F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end")))

    return F.array_sort(F.concat(spans(0, ASSIGN), spans(1, ACCESS), spans(2, HEX)))


def inferred(s: Column) -> Column:
    """Parameters of the first encoding whose alphabet holds the whole string."""
    chosen = F.lit(None)
    for enc in reversed(ENCODINGS):
        chosen = F.when(s.rlike(enc.pattern), F.struct(
            F.lit(float(enc.size)).alias("k"), F.lit(enc.changes).alias("r"),
            F.lit(float(enc.others)).alias("others"))).otherwise(chosen)
    return chosen


def ordinary_p(s: Column) -> Column:
    """P-value of "this is an ordinary string": its likelihood as one over that as a random one.

    Ordinary strings are words, with the frequencies of letters and few changes of character class,
    or ordered, with neighbours that follow each other. All evidence is added up, and by Markov's
    inequality an ordinary string has a ratio below p with a chance of p at most. Every encoding may
    be the random one, hence the factor.
    """

    def ratio(v: Column, enc: Column) -> Column:
        n, pairs = v["n"], v["n"] - 1
        words = v["letters"] + v["changes"] * F.log(enc["r"] / enc["others"]) + (
            pairs - v["changes"]) * F.log(F.lit(1.0) - enc["r"]) - F.log(enc["others"] + 1)
        ordered = v["near"] * F.lit(math.log((1 - APART) / 3)) + (
            pairs - v["near"]) * (F.lit(math.log(APART)) - F.log(enc["k"])) - F.log(enc["k"])
        random = -n * F.log(enc["k"]) - F.lit(math.log(len(ENCODINGS)))
        return F.least(F.lit(1.0), F.exp(F.least(F.lit(0.0), words - random + F.lit(math.log(1 - ORDERED)))) + F.exp(
            F.least(F.lit(0.0), ordered - random + F.lit(math.log(ORDERED)))))

    weights = F.array(*[F.lit(w) for w in LETTERS])
    codes = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.ascii(c))
    changes = F.regexp_count(s, F.lit(
        r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"))
    zero = F.struct(F.lit(0.0).alias("letters"), F.lit(0).alias("near"), F.lit(-9).alias("last"))
    walked = let(codes, lambda at: F.aggregate(at, zero, lambda a, c: F.struct(
        (a["letters"] + F.get(weights, c)).alias("letters"),
        (a["near"] + F.when(F.abs(c - a["last"]) <= 1, 1).otherwise(0)).alias("near"), c.alias("last"))))
    measured = let(walked, lambda w: F.struct(
        F.char_length(s).cast("double").alias("n"), w["letters"].alias("letters"), w["near"].alias("near"),
        changes.alias("changes")))
    return let(inferred(s), lambda enc: let(measured, lambda v: ratio(v, enc)))


def p_step(p: Column) -> Column:
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-300))) / F.lit(STEP)), F.lit(MAX_STEPS)).cast("int")


def candidates(text: Column) -> Column:
    """Long tokens as array of (start, end, band, step)."""

    def band(n: Column) -> Column:
        return sum((F.when(n >= lower, 1).otherwise(0) for lower in BANDS[1:]), F.lit(0))

    return F.transform(located(text, CANDIDATE), lambda m: F.struct(
        m["start"].alias("start"), m["end"].alias("end"),
        band(m["end"] - m["start"]).alias("band"), p_step(ordinary_p(m["match"])).alias("step")))


def discovery_cuts(df: DataFrame, text: str = "text", rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Benjamini-Hochberg cut per length band over the candidates of all rows.

    Returns the lowest accepted step of each band that has one. Longer tokens carry more
    evidence, so each band is held to ``rate`` on its own. At most ``len(BANDS) * MAX_STEPS``
    counts leave the aggregate, whatever the size of the table.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    counts = df.select(F.explode(candidates(raw)).alias("c")).groupBy(
        F.col("c.band").alias("band"), F.col("c.step").alias("step")
    ).agg(F.count(F.lit(1)).alias("n"))
    down = Window.partitionBy("band").orderBy(F.desc("step"))
    whole = Window.partitionBy("band")
    accepted = F.exp(-F.col("step") * STEP) <= rate * F.sum("n").over(down) / F.sum("n").over(whole)
    rows = counts.withColumn("_ok", accepted).filter("_ok").groupBy("band").agg(F.min("step")).collect()
    return {band: step for band, step in rows}


def all_spans(text: Column, cuts: dict[int, int]) -> Column:
    """Base spans, and random tokens that pass their band's cut and touch no base span."""
    raw = F.coalesce(text, F.lit(""))
    limits = F.array(*[F.lit(cuts.get(b, MAX_STEPS + 1)) for b in range(len(BANDS))])

    def add(base: Column) -> Column:
        passed = F.filter(candidates(raw), lambda c: (c["step"] >= F.get(limits, c["band"])) & ~F.exists(
            base, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
        return F.array_sort(F.concat(base, F.transform(passed, lambda c: F.struct(
            c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))))

    return let(base_spans(raw), add)


def spans_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_report(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Counts, digest and spans of every row.

    A null text counts as empty and has no span. Repeated rows are reported one by one; other
    columns are not read. Two passes without a shuffle of rows: the first counts the p-values
    of all candidates, the second finds all spans.
    """
    cuts = discovery_cuts(df, text)
    found = df.select(F.col(key), all_spans(F.col(text), cuts).alias("_spans"))
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("bigint")
    return found.select(
        key, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("_spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        spans_text(F.col("_spans")).alias("spans"), count(3).alias("n_random"),
    )


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Replace every span in ``text`` by ``mark``; overlapping spans become one. Null stays null."""
    spans = all_spans(F.col(text), discovery_cuts(df, text))

    def cleaned(listed: Column) -> Column:
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
        walked = F.aggregate(listed, zero, lambda a, s: F.when(s["end"] <= a["at"], a).otherwise(F.struct(
            s["end"].alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(
                a["out"], F.substring(F.col(text), (a["at"] + 1).cast("int"), (s["start"] - a["at"]).cast("int")),
                F.lit(mark))).alias("out"))))
        return let(walked, lambda w: F.concat(w["out"], F.substring(
            F.col(text), (w["at"] + 1).cast("int"), F.lit(2**31 - 1))))

    return df.withColumn(text, let(spans, lambda s: F.when(
        F.size(s) > 0, cleaned(s)).otherwise(F.col(text))))
