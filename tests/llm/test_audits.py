"""Operators on whole tables: the filter audit (op11) and the manifest (op13)."""

from __future__ import annotations

import hashlib
import itertools
import zlib
from math import factorial

import pytest
from helpers import DOCS, stored_documents
from pyspark.sql import functions as F

from quire.llm import interaction, merkle

ROWS = [
    (1, "one two", "en", "a", 7), (2, "w " * 120, "en", "a", 1), (3, None, None, None, None), (4, "", "fr", "b", 0),
    (5, "one two", "en", "b", 7), (5, "one two", "en", "b", 7), (6, "one two", "fr", "a", 7), (None, "one two", "en", "a", 7),
    (7, " ".join(f"w{i}" for i in range(150)), "en", "", 3), (8, "LOUD $ " + "x\ny " * 60000, "en", "a", 3), (9, "é\nü |", "", "é", 4),
    (10, " ".join(f"w{i}" for i in range(150)), "en", None, 3), (None, None, "de", "a", None),
    *((100 + i, "copy\nof it", "en", "hot", 10) for i in range(40)),
]


def table(spark, tmp_path, rows):
    place = str(tmp_path / "documents.parquet")
    spark.createDataFrame([(*r, "x", "y") for r in rows], DOCS.replace(", text", ", text").replace(
        "_row string", "_digest string").replace("n_words", "digest")).write.parquet(place)
    return spark.read.parquet(place)


def test_path_counts():
    for n in range(1, 7):
        forward, backward = interaction.path_counts(n)
        for s in range(2**n):
            size = s.bit_count()
            assert (forward[s], backward[s]) == (factorial(size), factorial(n - size))


def test_interaction(spark, tmp_path):
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (5, None, 1), (None, 1, 1), (103, 1, 1), (999, 1, 1)]
    seen = {}
    for key, text, *_ in ROWS:
        if key is not None:
            seen[text or ""] = min(key, seen.get(text or "", key))
    docs = []
    for key, text, lang, _, _ in ROWS:
        text = text or ""
        w = text.encode().split()
        fails = {f for f, bad in {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": bool(set(text) & set("#$%&*|")),
            "E": key is not None and seen[text] < key}.items() if bad}
        marks = [x for x in labels if key is not None and x[0] == key]
        docs.append((lang or "", fails, any(q == 1 for _, q, _ in marks), any(t == 1 for *_, t in marks)))
    expected = []
    for part in {d[0] for d in docs}:
        rows = [d for d in docs if d[0] == part]
        steps = []
        for order in itertools.permutations("ABCDE"):
            alive = rows
            for i, f in enumerate(order):
                gone = [d for d in alive if f in d[1]]
                fails = [d for d in rows if f in d[1]]
                alive = [d for d in alive if f not in d[1]]
                steps.append((part, "".join(order), i + 1, len(alive), len(gone), len(fails) - len(gone),
                              sum(d[1] == {f} for d in rows), sum(d[2] for d in gone), sum(d[3] for d in gone), f))
        for s in steps:
            expected.append((*s[:-1], sum(t[4] for t in steps if t[-1] == s[-1])))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumn("part", F.lit("z"))
    docs = table(spark, tmp_path, ROWS)
    got = interaction.interaction_report(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)
    assert interaction.interaction_report(docs.limit(0), marks).count() == 0
    bare = interaction.interaction_report(docs, marks.limit(0))
    assert bare.agg(F.sum("good_lost") + F.sum("toxic_lost")).head()[0] == 0


def test_audit_of_other_filters(spark):
    rows = spark.createDataFrame([("p", True, None), ("p", True, True), (None, False, True)], "g string, X boolean, Y boolean")
    got = {(r.g, r.filter_order, r.step): r for r in interaction.audit(rows, ["X", "Y"], "g").collect()}
    assert len(got) == 8 and got["p", "XY", 1].removed == 2 and got["p", "XY", 2].redundant == 1
    assert got["p", "YX", 1].shapley == 1 and got["p", "YX", 2].shapley == 3 and got[None, "YX", 1].kept == 0
    with pytest.raises(ValueError):
        interaction.audit(rows, list("ABCDEFG"), "g")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def tree_of(nodes):
    tree = [nodes]
    while len(tree[-1]) > 1:
        tree.append([sha("".join(tree[-1][i : i + 3])) for i in range(0, len(tree[-1]), 3)])
    return tree


def expected_manifest(rows):
    def leaf(row, text):
        key, _, lang, source, n = row
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (key, source, lang, n, text)))

    def siblings(tree, at):
        for level in tree[:-1]:
            run = at // 3 * 3
            yield "".join(level[run:at]), "".join(level[at + 1 : run + 3])
            at //= 3

    groups = {}
    for row in rows:
        key, text = row[0], row[1]
        even = zlib.crc32(b"" if key is None else str(key).encode()) % 2 == 0
        other = text.replace("\n", "") if even and text is not None else text
        groups.setdefault(row[3], []).append((key is not None, key or 0, leaf(row, text), leaf(row, other), key))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        groups[name].sort(key=lambda g: g[:3])
        trees[name] = tree_of([g[2] for g in groups[name]])
    forest = tree_of([trees[n][-1][0] for n in names])
    result = []
    for place, name in enumerate(names):
        for at, (_, _, own, other, key) in enumerate(groups[name]):
            path = [*siblings(trees[name], at), *siblings(forest, place)]
            folded = other
            for before, after in path:
                folded = sha(before + folded + after)
            root = forest[-1][0]
            result.append((key, own, trees[name][-1][0], root, sha("".join(b + a for b, a in path)), folded, folded == root))
    return result


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest(spark, tmp_path, monkeypatch, levels):
    monkeypatch.setattr(merkle.manifest, "__defaults__", (*merkle.manifest.__defaults__[:-1], levels))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    for i, rows in enumerate((ROWS, ROWS[:1], [*ROWS, *((2**60 + i, "a\nb", "en", f"s{i}", 3) for i in range(30))])):
        got = merkle.manifest_report(table(spark, tmp_path / str(i), rows))
        assert got.columns == names
        found = [tuple(r) for r in got.collect()]
        assert sorted(map(str, found)) == sorted(map(str, expected_manifest(rows)))
        assert {r[-1] for r in found} == ({True, False} if len(rows) > 1 else {True})
    assert merkle.manifest_report(stored_documents(spark, tmp_path, []).limit(0)).count() == 0
