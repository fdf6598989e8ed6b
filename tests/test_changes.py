from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.functions.ignore import IgnoreRules
from quire.operators.changes import (
    change_context,
    changes_from_name_status,
    context_heads,
    export_changes,
    parse_name_status,
    surviving_changes,
)
from quire.operators.selection import (
    distinct_changes,
    in_subtree,
    parse_path_lists,
    select_files,
    worktree_paths,
)
from quire.schemas import CHANGES, NAME_STATUS

BLOBS = [
    ("M\0a.c\0A\0A\0R087\0old.c\0new.c\0", [("M", "a.c", None), ("A", "A", None), ("R", "new.c", "old.c")]),
    ("", []),
    ("\0\0M\0x\0\0", [("M", "x", None)]),
    ("D\0gone\0M\0Reader\0", [("M", "Reader", None)]),
    ("C100\0from\0to\0T\0mode\0M\0z\0", [("M", "to", None), ("M", "mode", None), ("M", "z", None)]),
    ("M\0a.c\0R100\0old.c\0", None), ("M\0a.c", None), ("A\0", None), ("A\0\0", None),
    ("M\0tab\there\nline\0", [("M", "tab\there\nline", None)]),
]


@pytest.mark.parametrize("blob, expected", BLOBS)
def test_name_status(spark, blob, expected):
    rows = parse_name_status(spark.createDataFrame([("r", blob)], NAME_STATUS)).collect()
    if expected is None:
        assert [(r.path, r.parse_error) for r in rows] == [(None, True)]
    else:
        assert [(r.change_type, r.path, r.previous_path) for r in rows] == expected
        assert not any(r.parse_error for r in rows)


def test_one_bad_list_does_not_spoil_the_others(spark):
    blobs = spark.createDataFrame([("r", "M\0a\0M\0a\0"), ("s", "M\0cut")], NAME_STATUS)
    assert [tuple(r) for r in changes_from_name_status(blobs).collect()] == [("r", "a", "M", None)]


RECORDS = [
    ("r", "b.c", "M", None), ("r", "b.c", "A", None), ("r", "b.c", "M", None), ("r", "a&b.c", "R", "o*.c"),
    ("r", "rejected.c", "A", None), ("r", "c.c", None, None), ("r", "d.c", "D", None),
]


def test_context(spark):
    changes = distinct_changes(spark.createDataFrame(RECORDS, CHANGES))
    assert changes.count() == len(RECORDS) - 1
    accepted = spark.createDataFrame([("r", p) for p in ("a&b.c", "b.c", "c.c")], "repo string, path string")
    survivors = surviving_changes(changes, accepted)
    lines = [r.line for r in change_context(survivors).orderBy("order_key").collect()]
    assert lines == ["- R o\\*.c -> a&amp;b.c", "- A b.c", "- M b.c", "- M c.c"]
    repos = spark.createDataFrame([("r",), ("none",)], "repo string")
    heads = {r.repo: r.body for r in context_heads(repos, survivors, "a..b").collect()}
    assert heads["r"] == "## Change Context\n\nFiles changed: 4\nDiff range: a..b\n\n"
    assert heads["none"].startswith("## Change Context\n\nFiles changed: 0\n")
    assert export_changes(changes).filter("change_type = 'D'").count() == 0


def test_path_lists(spark):
    lists = spark.createDataFrame([("r", "b\r\na\n\n./c d\nb\nlast")], NAME_STATUS)
    assert sorted(r.path for r in parse_path_lists(lists).collect()) == ["./c d", "a", "b", "last"]
    nul = spark.createDataFrame([("r", "a\nb\0c\r\0\0d")], NAME_STATUS)
    assert sorted(r.path for r in parse_path_lists(nul, True).collect()) == ["a\nb", "c\r", "d"]


def test_selection(spark, make_files):
    files = make_files({"a.c": "1", "./b.c": "2", "ignored/keep.txt": "3", "/abs.c": "4"})
    chosen = spark.createDataFrame(
        [("r", p) for p in ("b.c", "./a.c", "a.c", "missing.c", "ignored/keep.txt", "/abs.c")] + [("s", "a.c")],
        "repo string, path string",
    )
    got = select_files(files, chosen).collect()
    assert sorted(r.path for r in got) == ["./b.c", "/abs.c", "a.c", "ignored/keep.txt"]


def test_worktree_and_subtree(spark):
    inventory = spark.createDataFrame(
        [("r", "a.log", True), ("r", "b.log", False), ("r", "c.c", False), ("r", "c.c", True)],
        "repo string, path string, tracked boolean",
    )
    assert sorted(r.path for r in worktree_paths(inventory, IgnoreRules()).collect()) == ["a.log", "c.c"]
    changes = spark.createDataFrame(
        [("r", "sub/n.c", "R", "sub/o.c"), ("r", "sub/m.c", "R", "top.c"), ("r", "x.c", "M", None)], CHANGES
    )
    got = in_subtree(changes, "sub/").orderBy("path").collect()
    assert [(r.path, r.previous_path) for r in got] == [("m.c", "top.c"), ("n.c", "o.c")]
    assert in_subtree(changes, "").filter(F.col("path") == "x.c").count() == 1
