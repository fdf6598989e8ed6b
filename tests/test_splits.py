"""Stored artifacts and change lists that are read in splits of a few bytes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quire import ExportOptions, export_files
from quire.operators.change_lists import read_change_lists
from quire.operators.changes import parse_name_status
from quire.operators.stored_artifacts import unpack_stored
from quire.operators.unpack import unpack
from quire.sources import read_artifacts, read_name_status, splits


@pytest.fixture(params=[(100, 1_000_000), (400, 0)])
def split_bytes(spark, request, monkeypatch):
    size, most = request.param
    monkeypatch.setattr(splits.with_states, "__defaults__", (most,))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield size
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def contents():
    rng = random.Random(3)
    tricky = ["```\nx\n```\n", "````py\n```\n````\n", "## not a heading\n\n```c\n", "<!-- FILES END -->\n<!-- FILES BEGIN -->\n",
              "Hunks: on (context: 3)\nLine numbers: on\n", "a\r\nb c\rd", "\n\n\n", "12 | x\n", "é" * 200, "`" * 40 + "\n" + "`" * 39]
    files = {}
    for repo in ("a b", "c+d%2F", "plain", "1"):
        for i in range(12):
            body = "".join(rng.choice(tricky) for _ in range(rng.randint(1, 5)))
            files[repo, f"d{i % 3}/f{i}.{rng.choice(('c', 'md', 'txt', 'py'))}"] = body
    files["plain", "big.txt"] = "".join(f"line {i} {'`' * (i % 7)}\n" for i in range(900))
    files["plain", "Change Context"] = files["1", "Project Tree"] = "x\n"
    files["1", "we&ird [x] `y`.md"] = "z"
    files["none", "empty.txt"] = ""
    return files


@pytest.mark.parametrize("numbers", [False, True])
def test_written_artifacts_come_back(spark, make_files, tmp_path, split_bytes, numbers):
    files = contents()
    export = export_files(make_files(files), ExportOptions(line_numbers=numbers, generated_at="T"))
    export.write(str(tmp_path / "out"), partitions=6)
    rows = unpack_stored(spark, str(tmp_path / "out")).collect()
    assert {r.status for r in rows} == {"ok"}
    found = {(r.repo, r.path): r.text for r in rows}
    assert len(found) == len(rows)
    assert found == {k: t if t.endswith("\n") else t + "\n" for k, t in files.items() if t}
    for repo in {k[0] for k in found}:
        order = [r.path for r in sorted((r for r in rows if r.repo == repo), key=lambda r: (r.part, r.ord))]
        assert order == sorted(order, key=str.encode)


GOOD = "# T\n\nLine numbers: on\n\n## Project Tree\n\n````text\n## x\n```\n````\n\n<!-- FILES BEGIN -->\n\n## a.c\n\n```c\n1 | x\n```\n\n\n"
ARTIFACTS = {
    "good": GOOD + "<!-- FILES END -->\n\n## later\n",
    "open_end": GOOD,
    "cut": GOOD + "## b.c\n\n```c\n1 | y\n",
    "no_fence": GOOD + "## b.c\n\ntext\n\n## c.c\n\n```\n1 | z\n```\n",
    "title_only": GOOD + "## b.c\n",
    "hunks": GOOD.replace("Line numbers: on", "Hunks: on (context: 3)"),
    "numbers": GOOD.replace("1 | x", "x"),
    "unsafe": GOOD.replace("a.c", "../a.c"),
    "nothing": "# T\n\n## Project Tree\n\n```text\n(no exported files)\n```\n",
    "bare": "# T\n\n## a.c\n\n```c\nx\n```\n",
}


def test_broken_artifacts_have_a_status(spark, tmp_path, split_bytes):
    for name, body in ARTIFACTS.items():
        (tmp_path / f"{name}.md").write_text(body)
    found = {(r.repo, r.path, r.safe_path, r.text, r.status) for r in unpack_stored(spark, str(tmp_path)).collect()}
    rows = unpack(read_artifacts(spark, str(tmp_path))).collect()
    assert found == {(r.repo, r.path, r.safe_path, r.text, r.status) for r in rows}
    assert {s for *_, s in found} == {"ok", "malformed", "hunk_export", "invalid_line_number", "unsafe_path"}


def test_ranges_are_refused_as_rows(spark, make_files, tmp_path):
    export_files(make_files({"a.c": "x"}), ExportOptions(generated_at="T")).write(str(tmp_path / "out"), partitions=2)
    with pytest.raises(ValueError, match="unpack_stored"):
        read_artifacts(spark, str(tmp_path / "out"))


def change_lists():
    rng = random.Random(6)
    lists = {"one": b"M\0a.c\0R100\0o\nld\0n\0", "padding": b"\0\0M\0x\0\0\0A\0A\0\0", "cut": b"M\0a\0R90\0old\0",
             "open": b"M\0a", "hollow": b"M\0\0A\0b\0", "status_only": b"A\0", "bytes": b"C75\0a\xff\0b\xc3\xa9\0T\0t\0D\0gone\0"}
    for k in range(6):
        records = []
        for i in range(rng.randint(40, 90)):
            status = rng.choice(("M", "A", "D", "R", "R087", "C", "T"))
            paths = [f"p/{k}/{i}/{'x' * rng.randint(0, 60)}" for _ in range(2 if status[0] in "RC" else 1)]
            records.append("\0".join((status, *paths)) + "\0" * rng.choice((1, 1, 1, 3)))
        lists[f"long {k}"] = "".join(records).encode()
    lists["long cut"] = lists["long 0"] + b"R\0x\0"
    return lists


def test_change_lists(spark, tmp_path, split_bytes):
    (tmp_path / "logs").mkdir()
    for name, body in change_lists().items():
        (tmp_path / "logs" / f"{name}.log").write_bytes(body)
    columns = ["repo", "path", "change_type", "previous_path", "parse_error"]
    found = read_change_lists(spark, str(tmp_path / "logs")).select(
        "repo", F.hex("path"), "change_type", F.hex("previous_path"), "parse_error").collect()
    whole = parse_name_status(read_name_status(spark, str(tmp_path / "logs"))).select(columns).select(
        "repo", F.hex("path"), "change_type", F.hex("previous_path"), "parse_error").collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, map(tuple, whole)))
    assert {r.repo for r in found if r.parse_error} == {"cut", "open", "hollow", "status_only", "long cut"}
