"""Toxicity (op12): the kernel against its definition, edge cases, held-out labels."""

from __future__ import annotations

import itertools
import os
import random
import zlib

import numpy as np
import pytest
from helpers import documents
from pyspark.sql import functions as F

from quire.llm import toxicity as T

SF_DIR = os.environ.get("QUIRE_TEST_SF_DIR", "/root/testdata/sf0.01").replace("sf0.001", "sf0.01")
LETTERS = "etaoinshrdlucmfwypvbgkjqxz"


def counted(text, starts=None):
    """Subsequences by their definition: four characters in a span of up to SPAN, none of them a mark."""
    alphabet = T.Alphabet(LETTERS)
    codes = [int(c) for c in alphabet.codes(text)]
    found = {}
    for first in range(len(codes) if starts is None else min(starts, len(codes))):
        for rest in itertools.combinations(range(first + 1, min(first + T.SPAN, len(codes))), T.LENGTH - 1):
            picked = tuple(codes[i] for i in (first, *rest))
            if all(picked):
                found[picked] = found.get(picked, 0) + T.DECAY ** (rest[-1] - first + 1 - T.LENGTH)
    return found


def inner(a, b):
    return sum(v * b.get(k, 0) for k, v in a.items())


def test_kernel():
    strings = ["idiot", "moron", "été", "aaaa", "x" * 20]
    marks = T.Landmarks(strings, T.Alphabet(LETTERS))
    pieces = [" you idiot ", "i.d-i.o.t", "idXiot moron", "a", "the and of and the", "ete aaaaa", "idiot" * 9, "mo1ron"]
    expected = [[inner(counted(p, T.WINDOW), counted(f" {s} ")) / np.sqrt(inner(counted(f" {s} "), counted(f" {s} "))) for s in strings]
                for p in pieces]
    assert np.allclose(marks.kernel(pieces), expected, atol=1e-4)


def test_margins_are_sums_of_weights():
    numbers = np.arange(T.TABLE)
    weights = np.random.default_rng(3).normal(size=T.TABLE).astype("f4")
    weights[~T.real(numbers)] = 0
    model = T.Model(LETTERS, numbers, weights, 0.25, 1.0, 0.0)
    model.prepare()
    pieces = ["short", "a sentence that is longer than one window, and then some", "x" * 33]
    margin, piece, at = model.margins(pieces)
    assert [(piece == i).sum() for i in range(3)] == [1, 1 + -(-(len(pieces[1]) - T.WINDOW) // T.STEP), 2]
    for m, p, a in zip(margin, piece, at, strict=True):
        held = counted(pieces[p][a:], T.WINDOW)
        number = lambda k: k[0] << 15 | k[1] << 10 | k[2] << 5 | k[3]
        assert m == pytest.approx(0.25 + sum(v * weights[number(k)] for k, v in held.items()), abs=1e-3)


def test_sentences_lose_nothing():
    long = " ".join(f"w{i}" for i in range(9000))
    pieces = list(T.sentences(long))
    assert max(map(len, pieces)) <= T.PIECE + T.OVERLAP
    whole = pieces[0]
    for p in pieces[1:]:
        assert whole.endswith(p[: T.OVERLAP])
        whole += p[T.OVERLAP :]
    assert whole == f" {long} "
    assert list(T.sentences("a b. c!\n\nd d d e")) == [" a b. ", " c! ", " d e "]
    assert list(T.sentences(None)) == list(T.sentences("\n\n")) == []


def corpus(n):
    rng = random.Random(2)
    syllables = ["ba", "to", "ri", "men", "sol", "ka", "ne", "lu", "vir", "ost"]
    insults = ["grunk", "zwoffel", "pjaxt"]

    def words(k):
        return ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(k)]

    rows = []
    for i in range(n):
        text = words(rng.randint(5, 60))
        toxic = i % 4 == 0
        for _ in range(2 if toxic else 0):
            text.insert(rng.randrange(len(text)), rng.choice(insults))
        rows.append((i, " ".join(text).replace("ba ", "ba. "), toxic))
    return rows


def test_report(spark):
    made = corpus(400)
    extra = [(1000, None, "a"), (1001, "", "a"), (1002, "  \n. ! ", "a"), (None, "grunk zwoffel", "a"), (4, "grunk again", "a"),
             (1003, "toto men " * 60000 + "zwoffel grunk", "a"), (1004, "you g.runk and zwof-fel", "a"), (1005, "baka " * 50000, "a")]
    docs = documents(spark, [(i, t, "a") for i, t, _ in made] + extra).withColumn("toxic", F.lit("x")).withColumn("score", F.lit(9))
    labels = spark.createDataFrame(
        [(i, 1, int(t)) for i, _, t in made] + [(8, 1, 0), (9999, 0, 1), (3, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    report = T.toxicity_report(docs, labels)
    assert report.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows = report.collect()
    assert len(rows) == len(made) + len(extra)
    truth = {i: t for i, _, t in made}
    wrong = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(b"" if r.doc_id is None else str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        wrong += r.doc_id in truth and r.doc_id != 4 and r.predicted != truth[r.doc_id]
    assert wrong <= 4
    by_id = {r.doc_id: r for r in rows if r.doc_id is None or r.doc_id >= 1000}
    assert by_id[1000].score == by_id[1001].score and {by_id[i].predicted for i in (1000, 1001, 1002, 1005)} == {0}
    assert by_id[None].predicted == by_id[1003].predicted == by_id[1004].predicted == 1
    again = {(r.doc_id, r.score) for r in T.toxicity_report(docs.repartition(7), labels).collect()}
    assert again == {(r.doc_id, r.score) for r in rows}


def test_labels_of_one_kind_or_none(spark):
    docs = documents(spark, [(i, f"text {i}", "a") for i in range(10)])
    labels = spark.createDataFrame([(i, 1, 1) for i in range(10)], "doc_id bigint, quality int, toxic int")
    assert {r.predicted for r in T.toxicity_report(docs, labels).collect()} == {1}
    assert {r.predicted for r in T.toxicity_report(docs, labels.withColumn("toxic", F.lit(0))).collect()} == {0}
    assert {r.predicted for r in T.toxicity_report(docs, labels.limit(0)).collect()} == {0}
    assert T.toxicity_report(docs.limit(0), labels).count() == 0


def test_held_out_labels(spark):
    from quire.llm import queries

    if not os.path.isdir(SF_DIR):
        pytest.skip("test tables are not here")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    scored = queries.op12_toxicity(spark, SF_DIR).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in scored if r.toxic]
    clean = [r.predicted for r in scored if not r.toxic]
    assert toxic and np.mean(toxic) >= 0.8 and np.mean(clean) <= 0.1
