from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quire import ExportOptions
from quire.functions.ignore import IgnoreRules
from quire.operators.changes import changes_from_name_status
from quire.operators.decisions import decisions, skip_counters
from quire.operators.unpack import unpack
from quire.sinks import write_decisions
from quire.sinks.artifact import range_name
from quire.sources.files import read_guarded
from quire.sources import (
    read_archive,
    read_artifacts,
    read_binary_files,
    read_name_status,
    read_patches,
    read_path_list,
    scan_directories,
)


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "root"
    for path, content in {
        "main.c": b"int x;\n", "src/deep/a.py": b"print(1)\n", ".env": b"K=1\n", "empty.txt": b"",
        "src/big.txt": b"x" * 5000, "node_modules/x/y.js": b"1\n", "café b.md": "é\n".encode(),
        ".gitignore": b"*.tmp\n", "t.tmp": b"t\n",
    }.items():
        file = root / path
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(content)
    os.symlink("main.c", root / "link.c")
    os.symlink("src", root / "dirlink")
    os.mkfifo(root / "pipe")
    return root


def test_scan_reports_everything(spark, tree):
    rows = {r.path: r for r in scan_directories(spark, {"r": str(tree)}, max_file_bytes=1000).collect()}
    assert {p: r.kind for p, r in rows.items() if r.kind != "file"} == {
        "link.c": "symlink", "dirlink": "symlink", "pipe": "other"
    }
    assert bytes(rows["src/deep/a.py"].content) == b"print(1)\n" and rows["empty.txt"].size == 0
    assert rows["src/big.txt"].content is None and rows["src/big.txt"].size == 5000
    assert "node_modules/x/y.js" in rows and ".gitignore" in rows


def test_scan_with_rules_does_not_enter_skipped_directories(spark, tree):
    lines = (tree / ".gitignore").read_text()
    files = scan_directories(spark, {"r": str(tree)}, rules=IgnoreRules([lines]))
    kinds = {r.path: r.kind for r in files.select("path", "kind").collect()}
    assert kinds["node_modules"] == "pruned_dir" and "node_modules/x/y.js" not in kinds
    decided = decisions(files, ExportOptions(ignore_lines=(lines,), max_file_bytes=1000))
    counters = skip_counters(decided).head().asDict()
    assert counters == {"repo": "r", "binary_or_empty": 1, "too_large": 1, "ignored": 3, "symlink": 2,
                        "sensitive": 0, "unreadable_dirs": 0}


@pytest.mark.skipif(os.getuid() == 0, reason="root can read everything")
def test_unreadable_directory(spark, tree):
    os.chmod(tree / "src", 0)
    try:
        rows = scan_directories(spark, {"r": str(tree)}).collect()
    finally:
        os.chmod(tree / "src", 0o700)
    assert [r.path for r in rows if r.kind == "unreadable_dir"] == ["src"]


def test_files_that_change_while_they_are_read(tmp_path):
    file = tmp_path / "f"

    def read(during=None, limit=100, identity=None, body=b"x" * 50):
        file.write_bytes(body)
        return read_guarded(str(file), identity, limit, during)

    def replace():
        (tmp_path / "g").write_bytes(b"y" * 50)
        os.replace(tmp_path / "g", file)

    assert read() == ("file", 50, b"x" * 50) and read(limit=None) == ("file", 50, b"x" * 50)
    assert read(body=b"") == ("file", 0, b"") and read(limit=50)[2] is not None
    assert read(limit=49) == ("file", 50, None)
    assert read(lambda: file.open("ab").write(b"z")) == ("changed", 51, None)
    assert read(lambda: file.open("ab").write(b"z"), limit=None) == ("changed", 51, None)
    assert read(lambda: file.open("ab").write(b"z" * 51)) == ("file", 101, None)
    assert read(lambda: os.truncate(file, 10)) == ("changed", 10, None)
    assert read(replace)[0] == "changed"
    info = os.stat(file)
    assert read(identity=f"{info.st_dev}:{info.st_ino}")[0] == "file"
    assert read(identity="1:1")[0] == "changed"
    os.remove(file)
    os.mkfifo(file)
    assert read_guarded(str(file), None, 100)[0] == "changed"
    os.remove(file)
    os.symlink(tmp_path / "other", file)
    with pytest.raises(OSError):
        read_guarded(str(file), None, 100)


def test_changed_files_have_a_reason(make_files):
    files = make_files({"a.c": "x", "b.c": "x"}, kinds={"b.c": "changed"})
    decided = {r.path: r.skip_reason for r in decisions(files, ExportOptions()).collect()}
    assert decided == {"a.c": None, "b.c": "changed"}


def test_missing_root_is_reported(spark, tmp_path):
    rows = scan_directories(spark, {"r": str(tmp_path / "nope")}).collect()
    assert [(r.path, r.kind) for r in rows] == [("", "unreadable_dir")]


def test_binary_reader(spark, tree):
    rows = {r.path: r for r in read_binary_files(spark, str(tree), "r").collect()}
    assert {"main.c", "src/deep/a.py", "src/big.txt"} <= set(rows)
    assert bytes(rows["main.c"].content) == b"int x;\n" and rows["main.c"].kind == "file"
    assert ".env" not in rows and "empty.txt" not in rows
    rows = {r.path: r for r in read_binary_files(spark, f"file://{tree}", "r", max_file_bytes=1000).collect()}
    assert rows["src/big.txt"].content is None and rows["src/big.txt"].size == 5000
    assert bytes(rows["src/deep/a.py"].content) == b"print(1)\n"


def test_range_names_sort_like_numbers(spark):
    numbers = [0, 9, 99_999, 100_000, 100_001, 1_000_000, 2_147_483_647]
    rows = spark.createDataFrame([(n,) for n in numbers], "n int").select("n", range_name(F.col("n")).alias("name"))
    assert [r.n for r in rows.orderBy("name").collect()] == numbers


def test_archive_reads_only_what_is_used(spark, make_files, tmp_path):
    make_files({"a.c": "x", "b.c": "y"}).write.parquet(str(tmp_path / "archive"))
    files = read_archive(spark, str(tmp_path / "archive"))
    assert files.filter("size <= 10").count() == 2
    plan = files.filter("size > 5").select("path")._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan and "GreaterThan(size,5)" in plan


@pytest.mark.parametrize("null", [False, True])
def test_path_list_files(spark, tmp_path, null):
    end = "\0" if null else "\r\n"
    (tmp_path / "list.txt").write_bytes((end.join(["b b", "a", "", "b b", "open"])).encode())
    rows = read_path_list(spark, str(tmp_path / "list.txt"), "r", null).collect()
    assert sorted(r.path for r in rows) == ["a", "b b", "open"]


def test_change_list_and_patch_files(spark, tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "my repo.log").write_bytes(b"M\0a.c\0R100\0o\nld\0n\0")
    got = changes_from_name_status(read_name_status(spark, str(tmp_path / "logs"))).collect()
    assert sorted((r.repo, r.path, r.change_type) for r in got) == [
        ("my repo", "a.c", "M"), ("my repo", "n", "R")
    ]
    spark.createDataFrame([("r", "a", "p")], "repo string, path string, patch string").write.parquet(
        str(tmp_path / "patches")
    )
    assert read_patches(spark, str(tmp_path / "patches")).count() == 1


def test_artifact_files(spark, tmp_path):
    body = "# T\n\nLine numbers: on\n\n<!-- FILES BEGIN -->\n\n## a.c\n\n```c\n1 | x\n```\n\n\n"
    (tmp_path / "r1.md").write_text(body)
    rows = unpack(read_artifacts(spark, str(tmp_path / "r1.md"))).collect()
    assert [(r.repo, r.path, r.text) for r in rows] == [("r1", "a.c", "x\n")]


def test_reject_report(spark, make_files, tmp_path):
    files = make_files({"a.c": "x", "b.log": "x", "c.txt": ""})
    write_decisions(decisions(files, ExportOptions()), str(tmp_path / "rejects"))
    rows = spark.read.parquet(str(tmp_path / "rejects")).collect()
    assert sorted((r.path, r.skip_reason) for r in rows) == [("b.log", "ignored"), ("c.txt", "empty")]
