from __future__ import annotations

import random

import pytest

from quire.operators.tree import marked_nodes, tree_fences, tree_rows


def entries_of(spark, paths, repo="r"):
    return spark.createDataFrame([(repo, p) for p in paths], "repo string, path string")


def drawn(spark, paths, depth=None, hot=1_000_000):
    rows = tree_rows(entries_of(spark, paths), depth, hot).orderBy("order_key").collect()
    return [r.line for r in rows]


SAMPLE = ["x/2/3/four", "x/2/five", "six", "y/a````b", "x/seven"]


def test_sample_tree(spark):
    assert drawn(spark, SAMPLE) == [
        "├── x",
        "│   ├── 2",
        "│   │   ├── 3",
        "│   │   │   └── four",
        "│   │   └── five",
        "│   └── seven",
        "├── y",
        "│   └── a````b",
        "└── six",
    ]
    assert drawn(spark, SAMPLE, 1) == ["├── x", "├── y", "└── six"]
    fences = tree_fences(marked_nodes(entries_of(spark, SAMPLE))).collect()
    assert [r.fence_len for r in fences] == [5]


def test_absolute_and_repeated_paths(spark):
    assert drawn(spark, ["/tmp/x/alpha.c", "/tmp//x/alpha.c", "b"]) == [
        "├── /", "│   └── tmp", "│       └── x", "│           └── alpha.c", "└── b",
    ]


def test_name_that_is_file_and_directory(spark):
    assert drawn(spark, ["a", "a/b", "0"]) == ["├── a", "│   └── b", "└── 0"]


def test_control_characters_are_spelled_out(spark):
    assert drawn(spark, ["a\tb"]) == ["└── a\\tb"]


def reference_tree(paths):
    root: dict = {}
    for path in paths:
        node = root
        for part in path.split("/"):
            node = node.setdefault(part, {})

    def draw(node, prefix):
        children = sorted(node.items(), key=lambda kv: (not kv[1], kv[0].encode()))
        for i, (name, child) in enumerate(children):
            last = i + 1 == len(children)
            yield prefix + ("└── " if last else "├── ") + name
            yield from draw(child, prefix + ("    " if last else "│   "))

    return list(draw(root, ""))


@pytest.mark.parametrize("hot", [1, 5, 1_000_000])
def test_random_trees_with_and_without_hot_keys(spark, hot):
    rng = random.Random(hot)
    names = ["a", "b", "ab", "a b", "Z", "é", "a.c", "-"]
    paths = {"/".join(rng.choice(names) for _ in range(rng.randint(1, 5))) for _ in range(300)}
    assert drawn(spark, sorted(paths), hot=hot) == reference_tree(paths)


def test_repositories_do_not_mix(spark):
    both = entries_of(spark, ["a/x"], "r1").unionByName(entries_of(spark, ["a/x", "b"], "r2"))
    rows = tree_rows(both).orderBy("repo", "order_key").collect()
    assert [(r.repo, r.line) for r in rows] == [
        ("r1", "└── a"), ("r1", "    └── x"), ("r2", "├── a"), ("r2", "│   └── x"), ("r2", "└── b"),
    ]
