"""Buckets of pairs of frequent tokens, and what lies on disk while tokens are counted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ngram_join


def test_sets_meet_in_one_pair_of_their_common_tokens(spark):
    # Sets 1 and 2 have five frequent tokens in common, and so ten pairs of them.
    tokens = {1: [10, 11, 12, 13, 14, 20], 2: [9, 10, 11, 12, 13, 14]}
    head = "array<struct<f:bigint,t:bigint>>"
    rows = [(sid, False, sid, [(100, t) for t in ts], [(100, t) for t in ts]) for sid, ts in tokens.items()]
    listed = spark.createDataFrame(rows, f"sid bigint, wide boolean, label bigint, head {head}, often {head}")
    found = ngram_join.entries(listed).filter("not lone")
    x, y = found.filter("sid = 1").alias("x"), found.filter("sid = 2").alias("y")
    both = x.join(y, F.col("x.sig") == F.col("y.sig"))
    assert both.count() == 10
    assert both.filter(~F.arrays_overlap("x.lead", "y.lead")).count() == 1


def test_few_tokens_before_an_entry_are_all_named(spark):
    head = "array<struct<f:bigint,t:bigint>>"
    tokens = [(2, t) for t in range(30, 0, -1)]
    listed = spark.createDataFrame([(1, True, 1, tokens, [])], f"sid bigint, wide boolean, label bigint, head {head}, often {head}")
    leads = [set(r.lead) for r in ngram_join.entries(listed).collect()]
    whole = [t for _, t in tokens]
    for at, lead in enumerate(leads):
        assert lead <= set(whole[:at])
        assert len(lead) == min(at, ngram_join.LEAD)


def test_shared_tokens_leave_no_shuffle_of_all_tokens(spark):
    scratch = ngram_join.Scratch(spark)
    rows = [(1, [4, 5, 6, 7, -8]), (2, [4, 6, -8, 100]), (3, [100, 200, 4])]
    shared = ngram_join.shared_tokens(spark.createDataFrame(rows, "sid bigint, prefix array<bigint>"), scratch)
    assert sorted(map(tuple, shared.collect())) == [
        (1, -8, 2), (1, 4, 3), (1, 6, 2), (2, -8, 2), (2, 4, 3), (2, 6, 2), (2, 100, 2), (3, 4, 3), (3, 100, 2)]
    assert len(scratch.tables) == ngram_join.TOKEN_SLICES
    ngram_join.forget(scratch, shared)
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(scratch.tables[0]).count()


def test_edited_copies_of_a_long_text_are_told_apart_before_they_are_compared(spark, tmp_path, monkeypatch):
    # Edited in every thirtieth word copies are too far apart to be linked; edited in one word they are linked.
    whole = [f"{'long' * (k % 3)}word{k}" for k in range(900)]
    edited = [" ".join(f"{w}x{c}" if (k + c) % 30 == 7 else w for k, w in enumerate(whole)) for c in range(5, 85)]
    linked = [" ".join(f"{w}y{c}" if k == c else w for k, w in enumerate(whole)) for c in range(5)]
    place = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate([*linked, *edited])), "doc_id bigint, text string").coalesce(1).write.parquet(place)
    candidates = {}
    store = ngram_join.Scratch.store

    def watched(self, df, name="table"):
        table = store(self, df, name)
        if name.endswith("-candidates"):
            candidates[name] = table.count()
        return table

    monkeypatch.setattr(ngram_join.Scratch, "store", watched)
    got = {r.doc_id: r.component_id for r in ngram_join.near_duplicates(spark.read.parquet(place), size=5, percent=80).collect()}
    assert got == {k: 0 if k < 5 else k for k in range(85)}
    # Of 3,570 pairs; those left are compared in buckets of few sets.
    assert candidates["links-candidates"] < 1000


def test_long_sketches_fold_to_one_length():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (3, 250, 260, 9000)]
    n = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    sketches = ngram_join.far_sketches(np.concatenate(sets), owner, n)
    assert [len(s) for s in sketches] == [4, 8, 16, ngram_join.FAR_WORDS]
    again = ngram_join.far_sketches(sets[2][:250], np.zeros(250, dtype=int), np.array([250]))[0]
    folded = sketches[2][:8] ^ sketches[2][8:]
    assert sum(int(w).bit_count() for w in (folded ^ again).view(np.uint64)) <= n[2] - 250
