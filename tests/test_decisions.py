from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quire.operators.decisions import decisions, entries, skip_counters, skip_summary
from quire.operators.findings import secret_findings
from quire.options import ExportOptions

SCAN = ExportOptions(max_file_bytes=1024)
KEY = "AKIA" + "A" * 16
TREE = {
    "main.c": "int main(void) { return 0; }\n",
    "ignored.log": "x",
    "large.txt": "x" * 2048,
    "large.log": "x" * 2048,
    "exact.txt": "x" * 1024,
    "binary.bin": b"\0\1\2binary",
    "empty.txt": "",
    "link.c": "",
    "socket": "",
    "locked.c": None,
    "credentials.txt": "plain",
    "leak.py": KEY,
    "node_modules/a/big.js": "x" * 2048,
    "node_modules/b.js": "x",
    "node_modules/link": "",
    "secret.pem/x.c": "fine",
    "shut": None,
}
KINDS = {
    "link.c": "symlink", "node_modules/link": "symlink", "socket": "other",
    "locked.c": "unreadable", "shut": "unreadable_dir",
}
REASONS = {
    "main.c": None, "ignored.log": "ignored", "large.txt": "too_large", "large.log": "too_large",
    "exact.txt": None, "binary.bin": "binary", "empty.txt": "empty", "link.c": "symlink",
    "socket": "not_regular", "locked.c": "unreadable", "credentials.txt": "sensitive_name",
    "leak.py": "sensitive_content", "node_modules/a/big.js": "ignored",
    "node_modules/b.js": "ignored", "node_modules/link": "ignored", "secret.pem/x.c": None,
    "shut": "unreadable_dir",
}


def test_every_reason(make_files):
    decided = decisions(make_files(TREE, kinds=KINDS), SCAN).collect()
    assert {r.path: r.skip_reason for r in decided} == REASONS
    assert {r.path: r.matched_rule for r in decided if r.matched_rule} == {"leak.py": "aws_akia"}
    assert {r.path for r in decided if r.pruned_directory == "node_modules"} == {
        p for p in TREE if p.startswith("node_modules")
    }


def test_counters_and_summary(make_files):
    decided = decisions(make_files(TREE, kinds=KINDS), SCAN)
    (row,) = skip_counters(decided).collect()
    assert row.asDict() == {
        "repo": "r", "binary_or_empty": 2, "too_large": 2, "ignored": 2, "symlink": 1,
        "sensitive": 2, "unreadable_dirs": 1,
    }
    summary = {r.reason: r.n_files for r in skip_summary(decided).collect()}
    assert sum(summary.values()) == len(TREE) and summary["accepted"] == 3


def test_given_paths_skip_ignore_rules(make_files):
    options = ExportOptions(mode="stdin", max_file_bytes=1024)
    reasons = {
        r.path: r.skip_reason for r in decisions(make_files(TREE, kinds=KINDS), options).collect()
    }
    assert reasons["ignored.log"] is None and reasons["node_modules/b.js"] is None
    assert reasons["node_modules/a/big.js"] == "too_large"


def test_allow_sensitive(make_files):
    options = ExportOptions(max_file_bytes=1024, allow_sensitive=True)
    rows = {r.path: r.skip_reason for r in decisions(make_files(TREE, kinds=KINDS), options).collect()}
    assert rows["credentials.txt"] is None and rows["leak.py"] is None


def test_stale_size_does_not_let_a_large_body_in(make_files):
    files = make_files({"a.c": "x" * 2000}).withColumn("size", F.lit(5).cast("bigint"))
    assert decisions(files, SCAN).head().skip_reason == "too_large"


def test_entries_describe_accepted_files(make_files):
    (row,) = entries(make_files({"./a b.py": "x\n```\ny"}), SCAN).collect()
    assert (row.path, row.lang, row.total_lines, row.fence_len, row.n_bytes, row.mode) == (
        "a b.py", "python", 3, 4, 7, "FULL"
    )


def test_findings_agree_with_decisions(make_files):
    files = make_files(TREE, kinds=KINDS)
    found = {r.path for r in secret_findings(files, SCAN).collect()}
    rejected = decisions(files, SCAN).filter("skip_reason = 'sensitive_content'").collect()
    assert found == {r.path for r in rejected} == {"leak.py"}


@pytest.mark.parametrize(
    "arguments",
    [
        {"mode": "nope"}, {"hunks": True}, {"mode": "staged", "hunks": True, "unpackable": True},
        {"mode": "stdin", "default_ignore": False}, {"mode": "staged", "ignore_lines": ("x",)},
        {"mode": "staged", "diff_range": "a..b"}, {"max_file_bytes": 0}, {"tree_depth": 0},
        {"hunk_context": -1},
    ],
)
def test_option_conflicts(arguments):
    with pytest.raises(ValueError):
        ExportOptions(**arguments)
