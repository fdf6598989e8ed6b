"""Shapes of physical plans that decide whether a job survives a large input."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from quire import ExportOptions
from quire.operators.decisions import decisions, entries
from quire.operators.delta import line_hunks, path_delta
from quire.operators.render import file_blocks
from quire.operators.tree import tree_nodes
from quire.sources import read_archive

OPTIONS = ExportOptions(ignore_lines=("!build/keep/*.txt",))


@pytest.fixture
def archive(spark, make_files, tmp_path):
    make_files({"a/b.c": "x\n", "c.py": "y"}).write.parquet(str(tmp_path / "archive"))
    return read_archive(spark, str(tmp_path / "archive"))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_decisions_and_blocks_do_not_shuffle(archive):
    for df in (
        decisions(archive, OPTIONS), entries(archive, OPTIONS),
        file_blocks(entries(archive, OPTIONS), OPTIONS),
    ):
        plan = plan_of(df)
        assert "Exchange" not in plan and "Python" not in plan and "Join" not in plan


def test_only_paths_are_shuffled_for_the_tree(archive):
    plan = plan_of(tree_nodes(entries(archive, OPTIONS)))
    assert plan.count("Exchange hashpartitioning") == 1
    exchange = plan[plan.index("Exchange hashpartitioning"):].splitlines()[0]
    assert "content" not in exchange
    assert "partial_" in plan


def test_path_only_work_does_not_read_bodies(archive):
    ignored = archive.select("path", OPTIONS.ignore_rules().ignored(F.col("path")).alias("x"))
    (schema,) = re.findall(r"ReadSchema: (\S+)", plan_of(ignored))
    assert schema == "struct<path:string>"


def test_digests_travel_instead_of_bodies(archive):
    plan = plan_of(path_delta(archive, archive))
    for line in plan.splitlines():
        if "Exchange" in line:
            assert "content" not in line
    assert plan.index("Exchange") < plan.index("sha2")


def test_changed_lines_do_not_shuffle(spark):
    pairs = spark.createDataFrame(
        [("r", "p", "a\n", "b\n")], "repo string, path string, base_text string, head_text string"
    )
    assert "Exchange" not in plan_of(line_hunks(pairs))
