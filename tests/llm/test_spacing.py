"""White space between words changes no result of the operators that compare word sequences."""

from __future__ import annotations

import random

from helpers import documents, stored_documents

from quire.llm import ngram_join, substrings


def long_words(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(4, 14))) for _ in range(n)]


def spaced(rng, words):
    """The words with one wide run of blanks among other white space."""
    gaps = [rng.choice((" ", "  ", "\n", "\r\n    ", "\t")) for _ in words[1:]]
    gaps[rng.randrange(len(gaps))] = " " * 60
    return words[0] + "".join(g + w for g, w in zip(gaps, words[1:], strict=True))


def test_repeats_do_not_depend_on_white_space(spark):
    rng = random.Random(21)
    rows = []
    for k in range(150):
        passage = long_words(rng, 16)
        rows += [(2 * k, " ".join(passage), "a"), (2 * k + 1, spaced(rng, passage), "a")]
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substrings.repeat_report(documents(spark, rows)).collect()}
    assert got == {key: (16, 16 * (key % 2)) for key, _, _ in rows}


def test_near_copies_do_not_depend_on_white_space(spark, tmp_path):
    rng = random.Random(22)
    rows = []
    for k in range(150):
        words = long_words(rng, 21)
        rows += [(2 * k, " ".join(words[:20]), "a"), (2 * k + 1, spaced(rng, words), "a")]
    df = stored_documents(spark, tmp_path, rows)
    got = {r.doc_id: r.component_id for r in ngram_join.join_report(df).collect()}
    assert got == {key: key - key % 2 for key, _, _ in rows}
