from __future__ import annotations

import glob
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from quire import ExportOptions, export_changes, export_files, export_snapshots, unpack_files
from quire.operators.metrics import TokenBudgetExceeded, artifact_metrics, within_budget
from quire.operators.unpack import unpack, with_flags
from quire.plans import export as plans_export
from quire.schemas import ARTIFACTS, CHANGES, HUNKS, SELECTED_PATHS

STAMP = "2026-03-16T12:34:56Z"


def text_of(export, repo="r"):
    """Artifact as one string; fine for small fixtures."""
    rows = export.blocks.filter(F.col("repo") == repo).orderBy("section", "order_key").collect()
    return "".join(r.body for r in rows)


PROJECT = {
    "src/main.c": "int main(void) { return 0; }\n",
    "Makefile": "all:\n\ttrue",
    "notes/fence.md": "```\ncode\n```\n",
    "weird & <name>.txt": "symbols\n",
    "node_modules/x.js": "no",
    "credentials.txt": "no",
}
EXPECTED = """# Codebase Export

Repository: r
Mode: recursive
Generated: 2026-03-16T12:34:56Z

Below are the source files found in the folders of this repository.

## Project Tree

```text
├── notes
│   └── fence.md
├── src
│   └── main.c
├── Makefile
└── weird & <name>.txt
```

<!-- FILES BEGIN -->

## Makefile

```makefile
all:
\ttrue
```


## notes/fence.md

````markdown
```
code
```
````


## src/main.c

```c
int main(void) { return 0; }
```


## weird &amp; &lt;name>.txt

```
symbols
```


<!-- FILES END -->

"""


def test_whole_artifact(make_files):
    export = export_files(make_files(PROJECT), ExportOptions(generated_at=STAMP))
    assert text_of(export) == EXPECTED
    (row,) = export.metrics.collect()
    size = len(EXPECTED.encode())
    assert row.asDict() == {
        "repo": "r", "files_exported": 4, "bytes_written": size, "estimated_tokens": 2 * size // 7,
        "verdict": "ok",
    }
    assert export.counters.head().ignored == 1


def test_empty_artifacts(spark, make_files):
    files = make_files({("none", "x.log"): "x", ("some", "a.c"): "x"})
    export = export_files(files, ExportOptions(generated_at=STAMP))
    text = text_of(export, "none")
    assert "```text\n(no exported files)\n```\n\n" in text and "FILES BEGIN" not in text
    selected = spark.createDataFrame([("some", "missing.c")], SELECTED_PATHS)
    options = ExportOptions(mode="stdin", generated_at=STAMP, show_tree=False)
    export = export_files(files, options, selected)
    assert "that a path list names." in text_of(export, "some")
    assert "## " not in text_of(export, "some")
    with pytest.raises(ValueError):
        export_files(files, options)
    with pytest.raises(ValueError):
        export_files(files, ExportOptions(mode="staged"))


def test_line_numbers(make_files):
    options = ExportOptions(generated_at=STAMP, line_numbers=True, show_tree=False)
    text = text_of(export_files(make_files({"a.c": "\n".join("abcdefghij")}), options))
    assert "\nLine numbers: on\n" in text
    assert "```c\n 1 | a\n" in text and "10 | j\n```" in text


POEM = [f"verse {i}" for i in range(1, 31)]
BEFORE = {
    "poem.txt": "\n".join(POEM) + "\n",
    "old/plan.md": "# Plan\n\nnothing yet\n",
    "list.csv": "k,v\na,1\nb,2\nc,3\nd,4\n",
    "pair.py": "first = 1\nsecond = 2\n",
    "still.txt": "the same\n",
}


def after():
    now = dict(BEFORE)
    now["poem.txt"] = "\n".join([*POEM[:4], "another verse", *POEM[5:24], "and one more", *POEM[25:]]) + "\n"
    now["new/plan.md"] = now.pop("old/plan.md")
    now["list.csv"] = BEFORE["list.csv"].replace("b,2\n", "")
    now["pair.py"] = "first = 1\nsecond = 3\n"
    now["start.sh"] = "echo start\n"
    now["id_rsa"] = "kept back\n"
    return now


def review(make_files, **arguments):
    options = ExportOptions(mode="staged", generated_at=STAMP, **arguments)
    return text_of(export_snapshots(make_files(BEFORE), make_files(after()), options))


def section(text, path):
    return text.split(f"## {path}\n", 1)[1].split("\n## ", 1)[0]


def test_bodies_are_judged_once_for_a_review(make_files, monkeypatch):
    judged = []
    judge = plans_export.entries
    monkeypatch.setattr(plans_export, "entries", lambda *given: judged.append(given) or judge(*given))
    assert "another verse" in review(make_files, hunks=True)
    assert len(judged) == 1


def test_review_of_whole_files(make_files):
    text = review(make_files, show_tree=False)
    context = text.split("## Change Context\n\n", 1)[1].split("\n<!--", 1)[0]
    assert context == (
        "Files changed: 5\n\n- M list.csv\n- R old/plan.md -> new/plan.md\n"
        "- M pair.py\n- M poem.txt\n- A start.sh\n"
    )
    assert "## new/plan.md" in text and "id_rsa" not in text and "still.txt" not in text


def test_review_of_changed_lines(make_files):
    text = review(make_files, hunks=True, hunk_context=0, line_numbers=True)
    assert "Line numbers: on\nHunks: on (context: 0)\n" in text
    body = section(text, "poem.txt")
    assert " 5 | another verse\n```\n\n\n... 19 unchanged lines omitted ...\n\n" in body
    assert "25 | and one more" in body
    assert body.startswith("\n... 4 unchanged lines omitted ...\n\n```")
    assert body.endswith("... 5 unchanged lines omitted ...\n")
    # A rename without changed lines stays listed, but shows no body and no tree row.
    assert "- R old/plan.md -> new/plan.md" in text and "## new/plan.md" not in text
    assert "─ start.sh" in text and "─ plan.md" not in text
    assert "1 | echo start" in section(text, "start.sh")


def test_context_lines(make_files):
    body = section(review(make_files, hunks=True, hunk_context=1, show_tree=False), "list.csv")
    assert "\na,1\nc,3\n" in body and "d,4" not in body and "b,2" not in body
    wide = section(review(make_files, hunks=True, hunk_context=9, show_tree=False), "pair.py")
    assert "first = 1\nsecond = 3\n```" in wide and "omitted" not in wide


def test_paths_in_two_forms_and_repeated(spark, make_files):
    rows = make_files({"./x.c": "1\n2\n", "y.c": "y\n", "./z.c": "other\n", "z.c": "z\n"})
    files = rows.unionByName(rows.filter("path = 'y.c'"))
    changes = spark.createDataFrame(
        [("r", "x.c", "M", None), ("r", "./y.c", "M", None), ("r", "./z.c", "A", None), ("r", "z.c", "A", None)],
        CHANGES)
    hunks = spark.createDataFrame([("r", "./x.c", 2, 1), ("r", "y.c", 1, 1)], HUNKS)
    for extra in ({}, {"hunks": True, "hunk_context": 0}):
        options = ExportOptions(mode="staged", generated_at=STAMP, **extra)
        export = export_changes(files, changes, options, hunks if extra else None)
        text = text_of(export)
        assert "Files changed: 3\n\n- M x.c\n- M y.c\n- A z.c\n\n" in text
        assert [text.count(f"## {p}\n") for p in ("x.c", "y.c", "z.c")] == [1, 1, 1]
        assert "```c\nz\n```" in text and "other" not in text and ("1\n2" in text) == (not extra)
    export = export_files(files, ExportOptions(generated_at=STAMP))
    parts = export.parts(40)
    assert export.metrics.head().bytes_written == sum(len(r.body) for r in parts.select(
        F.encode("body", "utf-8").alias("body")).collect())
    assert export.metrics.head().files_exported == 3
    before = make_files({"./x.c": "1\n", "y.c": "y\n"})
    text = text_of(export_snapshots(before, files, ExportOptions(mode="diff", generated_at=STAMP)))
    assert "Files changed: 2\n\n- M x.c\n- A z.c\n\n" in text and "## x.c" in text


def test_given_changes_and_hunks(spark, make_files):
    files = make_files({"a.c": "1\n2\n3\n4\n", "mode.sh": "x\n", "b.c": "b\n"})
    changes = spark.createDataFrame(
        [("r", "a.c", "M", None), ("r", "mode.sh", "M", None), ("r", "gone.c", "M", None),
         ("r", "b.c", "D", None)], CHANGES)
    hunks = spark.createDataFrame([("r", "a.c", 2, 1), ("r", "a.c", 2, 0), ("r", "gone.c", 1, 1)], HUNKS)
    options = ExportOptions(mode="diff", diff_range="HEAD~1..HEAD", generated_at=STAMP, hunks=True,
                            hunk_context=0)
    text = text_of(export_changes(files, changes, options, hunks))
    assert "Files changed: 2\nDiff range: HEAD~1..HEAD\n\n- M a.c\n- M mode.sh\n\n" in text
    assert "```c\n2\n```" in text and "└── a.c" in text and "## mode.sh" not in text
    with pytest.raises(ValueError):
        export_changes(files, changes, options)


def test_written_bytes_equal_counted_bytes(make_files, tmp_path):
    options = ExportOptions(generated_at=STAMP)
    many = {("big", f"d{i % 7}/f{i:03d}.txt"): f"text {i}\n" * (i % 9 + 1) for i in range(300)}
    files = make_files({**{("r", p): c for p, c in PROJECT.items()}, **many})
    export = export_files(files, options)
    for by_repo in (True, False):
        export.write(str(tmp_path / f"out{by_repo}"), by_repo=by_repo)
    sizes = {r.repo: r.bytes_written for r in export.metrics.collect()}
    for repo in ("r", "big"):
        pieces = sorted(glob.glob(str(tmp_path / f"outTrue/repo={repo}/range=*/part-*")))
        body = b"".join(open(p, "rb").read() for p in pieces)
        assert len(body) == sizes[repo]
        assert body.decode() == text_of(export, repo)
    pieces = sorted(glob.glob(str(tmp_path / "outFalse/range=*/part-*")))
    assert sum(os.path.getsize(p) for p in pieces) == sum(sizes.values())
    with pytest.raises(Exception, match="(?i)exists"):
        export.write(str(tmp_path / "outTrue"))


def test_budget(make_files, tmp_path):
    files = make_files({("small", "a.c"): "x", ("large", "a.c"): "x" * 9000})
    options = ExportOptions(generated_at=STAMP, max_tokens=1000, warn_tokens=60)
    export = export_files(files, options)
    assert {r.repo: r.verdict for r in export.metrics.collect()} == {"small": "warn", "large": "fail"}
    with pytest.raises(TokenBudgetExceeded):
        export.write(str(tmp_path / "strict"), strict=True)
    assert not (tmp_path / "strict").exists()
    export.write(str(tmp_path / "out"))
    assert sorted(os.path.basename(p) for p in glob.glob(str(tmp_path / "out/repo=*"))) == ["repo=small"]
    for hot in (0, 10**6):
        kept = within_budget(export.blocks, export.metrics, min_hot_rows=hot)
        assert {r.repo for r in kept.select("repo").distinct().collect()} == {"small"}
    tokens = export.metrics.filter("repo = 'small'").head().estimated_tokens
    exact = ExportOptions(generated_at=STAMP, max_tokens=tokens, warn_tokens=tokens)
    assert artifact_metrics(export.blocks, exact).filter("repo = 'small'").head().verdict == "ok"


@pytest.mark.parametrize("numbers", [False, True])
def test_sizes_are_those_of_the_printed_text(spark, make_files, numbers):
    rng = random.Random(7)
    lines = ["", "x", "é" * 9, "```", "`" * 12, "a\rb", " " * 30]
    texts = {f"d/we&ird <{i}>\t[x].{rng.choice(('py', 'md', 'zzz'))}": "\n".join(
        rng.choice(lines) for _ in range(rng.randint(1, 130))) + rng.choice(("", "\n")) + "z" for i in range(40)}
    base = {p: t.replace("x", "y").replace("\r", "") + rng.choice(("", "\nmore\n")) for p, t in texts.items()}
    scan = export_files(make_files(texts), ExportOptions(generated_at=STAMP, line_numbers=numbers))
    review = export_snapshots(make_files(base), make_files(texts), ExportOptions(
        mode="staged", hunks=True, hunk_context=1, generated_at=STAMP, line_numbers=numbers))
    for export in (scan, review):
        key = ["repo", "section", "order_key"]
        printed = {tuple(r[k] for k in key): len(r.body.encode()) for r in export.blocks.collect()}
        assert {tuple(r[k] for k in key): r.n_bytes for r in export.sizes.collect()} == printed
        plan = export.metrics._jdf.queryExecution().optimizedPlan().toString()
        assert "unchanged lines omitted" not in plan


def test_bodies_move_once(spark, make_files, tmp_path):
    files = make_files({f"d{i % 3}/f{i}.c": "line\n" * (i % 50) + "x" for i in range(60)})
    files.write.parquet(str(tmp_path / "files"))
    export = export_files(spark.read.parquet(str(tmp_path / "files")), ExportOptions(generated_at=STAMP))
    parts = export.parts(300)
    plan = parts._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"Exchange (?:hashpartitioning|rangepartitioning)\(([^\n]*)", plan)
    assert len([m for m in moved if "chunk" in m]) == 1
    sizes = [len(r.body.encode()) for r in parts.orderBy("part").collect()]
    assert sum(sizes) == export.metrics.head().bytes_written and len(sizes) > 20


def test_ranges_hold_equal_bytes(make_files, tmp_path):
    files = {("hot", f"long/{i:03d}.txt"): "word " * 400 for i in range(40)}
    files |= {("hot", f"many/very/deep/folder/of/short/files/{i:04d}.c"): "x" for i in range(600)}
    files |= {(f"small{i}", "a.c"): "x" for i in range(5)}
    export = export_files(make_files(files), ExportOptions(generated_at=STAMP))
    export.write(str(tmp_path / "out"), partitions=12)
    pieces = sorted(glob.glob(str(tmp_path / "out/repo=hot/range=*/part-*")))
    sizes = [os.path.getsize(p) for p in pieces]
    assert len(sizes) >= 10 and max(sizes) <= 2 * sorted(sizes)[len(sizes) // 2]
    assert b"".join(open(p, "rb").read() for p in pieces).decode() == text_of(export, "hot")


@pytest.mark.parametrize("part_bytes", [1, 200, 10**9])
@pytest.mark.parametrize("numbers", [False, True])
def test_unpack_gives_the_files_back(make_files, part_bytes, numbers):
    tricky = {
        **PROJECT,
        "a/heading.md": "## not a file\n\n```\nx\n```\n<!-- FILES END -->\n",
        "crlf.txt": "a\r\nb\r\n",
        "separator.txt": "a\u2028b\u0085c\x0bd" + "e" * 60,
        "ticks.md": "`````\n````\n",
        "Project Tree": "x\n", "Change Context": "y\n", "nl\nname.txt": "z\n",
        "<!-- FILES BEGIN -->": "<!-- FILES BEGIN -->\n",
        "number | 3.txt": "1 | looks numbered\n\n",
    }
    options = ExportOptions(generated_at=STAMP, line_numbers=numbers)
    parts = export_files(make_files(tricky), options).parts(part_bytes)
    assert (parts.count() == 1) == (part_bytes == 10**9)
    got = {r.path: r.text for r in unpack_files(parts).collect()}
    expected = {
        p: c if c.endswith("\n") else c + "\n"
        for p, c in tricky.items() if p not in ("node_modules/x.js", "credentials.txt")
    }
    assert got == expected


def whole(spark, body):
    return with_flags(spark.createDataFrame([("r", body)], "repo string, body string"))


def test_unpack_foreign_artifacts(spark):
    plain = (
        "# Codebase Export\n\nMode: staged\n\n## Change Context\n\nFiles changed: 1\n\n- M a.c\n\n"
        "## Project Tree\n\n```text\n└── a.c\n```\n\n## ../a.c\n\n```c\nx\n```\n\nsome words\n\n"
        "## /b.c\n```\ny\n```\n"
    )
    rows = unpack(whole(spark, plain)).orderBy("ord").collect()
    assert [(r.path, r.safe_path, r.text, r.status) for r in rows] == [
        ("../a.c", None, "x\n", "unsafe_path"), ("/b.c", "b.c", "y\n", "ok")
    ]


MARKER = "<!-- FILES BEGIN -->\n\n"


@pytest.mark.parametrize(
    "body, status",
    [
        ("# T\n\nHunks: on (context: 3)\n\n" + MARKER + "## a\n\n```\nx\n```\n", "hunk_export"),
        ("# T\n\n" + MARKER + "## a\n\nno fence\n", "malformed"),
        ("# T\n\n" + MARKER + "## a\n\n````\nx\n```\n", "malformed"),
        ("# T\n\n" + MARKER + "## a\n\n```\nx\n```\n## b\n", "malformed"),
        ("# T\n\nLine numbers: on\n\n" + MARKER + "## a\n\n```\nx\n```\n", "invalid_line_number"),
    ],
)
def test_unreadable_artifacts_are_reported(spark, body, status):
    (row,) = unpack(whole(spark, body)).collect()
    assert row.status == status
    assert unpack_files(whole(spark, body)).count() == 0


def test_nothing_behind_the_end_marker_is_read(spark):
    body = MARKER + "## a\n\n```\nx\n```\n\n<!-- FILES END -->\n\n## appendix\n\n```python\ncode\n```\n"
    rows = unpack(whole(spark, body)).collect()
    assert [(r.path, r.status) for r in rows] == [("a", "ok")]
    assert unpack(spark.createDataFrame([], ARTIFACTS)).count() == 0


def test_long_bodies_do_not_overflow_the_matcher(spark, make_files):
    big = {"long.txt": "line\n" * 18_000, "wide.txt": "`x" * 45_000, "empty_lines.txt": "\n" * 100_000}
    parts = export_files(make_files(big), ExportOptions(generated_at=STAMP)).parts()
    got = {r.path: len(r.text) for r in unpack_files(parts).collect()}
    assert got == {"long.txt": 90_000, "wide.txt": 90_001, "empty_lines.txt": 100_000}
