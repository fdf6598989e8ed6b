from __future__ import annotations

import difflib
import hashlib
import random

import pytest

from quire.functions import lines as line_ops
from quire.operators.delta import exact_renames, line_hunks, path_delta, snapshot_changes
from quire.operators.hunks import (
    file_ranges,
    hunks_from_patches,
    merge_ranges,
    omissions,
    parse_patches,
    render_ranges,
)
from quire.operators.renames import similar_renames
from quire.operators.scale import stored
from quire.schemas import HUNKS, PATCHES


def hunk_rows(spark, texts):
    pairs = spark.createDataFrame(
        [("r", str(i), a, b) for i, (a, b) in enumerate(texts)],
        "repo string, path string, base_text string, head_text string",
    )
    found = {str(i): [] for i in range(len(texts))}
    for row in line_hunks(pairs).collect():
        found[row.path].append((row.new_start, row.new_count))
    return [sorted(found[str(i)]) for i in range(len(texts))]


def diff_hunks(before, after):
    """New-side hunks of a zero-context diff."""
    out = []
    matcher = difflib.SequenceMatcher(None, before, after, autojunk=False)
    for tag, _, _, j1, j2 in matcher.get_opcodes():
        if tag != "equal":
            out.append((j1 + 1, j2 - j1) if j2 > j1 else (j1, 0))
    return out


def test_line_hunks_match_a_diff(spark):
    rng = random.Random(11)
    texts, expected = [], []
    for _ in range(400):
        before = [f"line {i}" for i in range(rng.randint(0, 12))]
        after = []
        for line in before:
            roll = rng.random()
            if roll < 0.15:
                continue
            after.append(f"new {rng.random()}" if roll < 0.3 else line)
            if roll > 0.9:
                after.append(f"more {rng.random()}")
        texts.append(("".join(x + "\n" for x in before), "".join(x + "\n" for x in after)))
        expected.append(diff_hunks(before, after))
    assert hunk_rows(spark, texts) == expected


def test_repeated_lines_count_by_occurrence(spark):
    assert hunk_rows(spark, [("x\nx\n", "x\nx\nx\n"), ("x\nx\nx\n", "x\n"), ("", "a\nb"), ("a\n", "")]) == [
        [(3, 1)], [(1, 0)], [(1, 2)], [(0, 0)]
    ]


PATCH = "--- a/f\r\n+++ b/f\r\n@@ -1,2 +3,4 @@ fn\r\n-x\r\n+@@ y\r\n@@ -7 +9 @@\r\n@@ -9,3 +12,0 @@\r\n"


def test_patches(spark):
    patches = spark.createDataFrame(
        [("r", "f", PATCH), ("r", "plain", "no hunks\n"), ("r", "bad", "@@ -1 +2 @@\n@@ nonsense @@\n"),
         ("r", "long", "@@ -1 +99999999999999999999 @@\n"), ("r", "tight", "@@-1+2,3@@\n")],
        PATCHES,
    )
    good = [tuple(r) for r in hunks_from_patches(patches).orderBy("path", "new_start").collect()]
    assert good == [("r", "f", 3, 4), ("r", "f", 9, 1), ("r", "f", 12, 0), ("r", "tight", 2, 3)]
    assert sorted(r.path for r in parse_patches(patches).filter("parse_error").collect()) == ["bad", "long"]


def naive_ranges(hunks, total, context):
    """Merged ranges, one hunk after the other."""
    spans = []
    for start, count in hunks:
        first = min(max(start, 1), total)
        last = min(max(start + count - 1, first), total) if count else first
        spans.append((max(first - context, 1), min(last + context, total)))
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    return [tuple(m) for m in merged]


def test_ranges_and_omissions(spark):
    rng = random.Random(5)
    files = {
        str(i): (rng.randint(1, 40), rng.randint(0, 4),
                 [(rng.randint(0, 50), rng.randint(0, 5)) for _ in range(rng.randint(1, 6))])
        for i in range(150)
    }
    for context in range(5):
        chosen = {p: (t, h) for p, (t, c, h) in files.items() if c == context}
        sizes = spark.createDataFrame([("r", p, t) for p, (t, _) in chosen.items()],
                                      "repo string, path string, total_lines bigint")
        hunks = spark.createDataFrame([("r", p, *x) for p, (_, h) in chosen.items() for x in h], HUNKS)
        ranges = {r.path: [tuple(x) for x in r.ranges] for r in file_ranges(hunks, sizes, context).collect()}
        assert ranges == {p: naive_ranges(h, t, context) for p, (t, h) in chosen.items()}
        gaps: dict = {}
        merged = merge_ranges(render_ranges(hunks, sizes, context))
        for row in omissions(merged).collect():
            gaps[row.path] = gaps.get(row.path, 0) + row.omitted_lines
        for path, (total, _) in chosen.items():
            assert sum(b - a + 1 for a, b in ranges[path]) + gaps.get(path, 0) == total


def test_snapshot_changes(make_files):
    base = make_files({"same": "1", "edit": "2", "gone": "3", "old1": "c", "old2": "c", "old3": "c", "e1": ""})
    head = make_files({"same": "1", "edit": "2x", "fresh": "4", "new1": "c", "new2": "c", "e2": ""})
    changes = {(r.change_type, r.path, r.previous_path) for r in snapshot_changes(base, head).collect()}
    assert changes == {
        ("M", "edit", None), ("A", "fresh", None), ("R", "new1", "old1"), ("R", "new2", "old2"),
        ("R", "e2", "e1"),
    }
    plain = {(r.change_type, r.path) for r in snapshot_changes(base, head, renames=False).collect()}
    assert plain == {("M", "edit"), ("A", "fresh"), ("A", "new1"), ("A", "new2"), ("A", "e2")}


@pytest.mark.parametrize("copies", [500])
def test_many_copies_pair_one_to_one(make_files, copies):
    base = make_files({f"old/{i:04d}": "licence" for i in range(copies)})
    head = make_files({f"new/{i:04d}": "licence" for i in range(copies - 100)})
    pairs = exact_renames(path_delta(base, head)).collect()
    assert {(r.path, r.previous_path) for r in pairs} == {
        (f"new/{i:04d}", f"old/{i:04d}") for i in range(copies - 100)
    }


def rebuilt(before, after, hunks):
    """Head lines outside the hunks must come from base in order, and every edit must show."""
    inside = {n for start, count in hunks for n in range(start, start + count)}
    rest = iter(before)
    return all(line in rest for n, line in enumerate(after, 1) if n not in inside)


def test_moved_and_repeated_lines_are_complete(spark):
    rng = random.Random(5)
    texts = [("a\nb\nc\n", "b\na\nc\n"), ("a\nb", "a\nb\n"), ("a\nb\n", "a\nb")]
    for _ in range(300):
        before = [rng.choice("abcdefgh") for _ in range(rng.randint(1, 12))]
        after = list(before)
        for _ in range(rng.randint(1, 4)):
            line = after.pop(rng.randrange(len(after))) if after else "x"
            after.insert(rng.randint(0, len(after)), line if rng.random() < 0.7 else "new")
        texts.append(("".join(x + "\n" for x in before), "".join(x + "\n" for x in after)))
    for (before, after), hunks in zip(texts, hunk_rows(spark, texts), strict=True):
        assert bool(hunks) == (before != after)
        assert rebuilt(before.splitlines(True), after.splitlines(True), hunks)


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


@pytest.mark.parametrize("bits", [1, 40, 1 << 27])
def test_kept_lines_are_as_many_as_possible(monkeypatch, bits):
    monkeypatch.setattr(line_ops, "TABLE_BITS", bits)
    rng = random.Random(bits)
    for _ in range(600):
        letters = "abcdefghijklmnop"[: rng.randint(1, 16)]
        before = [rng.choice(letters) for _ in range(rng.randint(0, 30))]
        after = before[:]
        for _ in range(rng.randint(0, 3)):
            i, j = sorted((rng.randint(0, len(after)), rng.randint(0, len(after))))
            block, after = after[i:j], after[:i] + after[j:]
            at = rng.randint(0, len(after))
            after[at:at] = block if rng.random() < 0.7 else [rng.choice("xyz")]
        kept = line_ops.kept_lines(before, after)
        assert all(before[i] == after[j] for i, j in kept)
        assert all(i < k and j < m for (i, j), (k, m) in zip(kept, kept[1:], strict=False))
        assert len(kept) == common_length(before, after)


def test_choice_does_not_depend_on_the_table(monkeypatch):
    rng = random.Random(8)
    texts = [([rng.randrange(9) for _ in range(40)], [rng.randrange(9) for _ in range(35)]) for _ in range(60)]
    whole = [line_ops.kept_lines(a, b) for a, b in texts]
    monkeypatch.setattr(line_ops, "TABLE_BITS", 3)
    monkeypatch.setattr(line_ops, "MASK_BYTES", 0)
    assert [line_ops.kept_lines(a, b) for a, b in texts] == whole


def test_changed_ranges_of_odd_texts():
    assert line_ops.changed_ranges(None, None) == line_ops.changed_ranges("", "") == []
    assert line_ops.changed_ranges(None, "a") == [(1, 1)]
    assert line_ops.changed_ranges("a\n", "a") == [(1, 1)]
    assert line_ops.changed_ranges("\n\n\n", "\n") == [(1, 0)]
    assert line_ops.changed_ranges("a\r\nb\n", "a\nb\n") == [(1, 1)]


def test_large_files_with_repeats():
    rng = random.Random(4)
    before = [str(rng.randrange(300)) for _ in range(6000)]
    after = before[3000:] + before[:3000]
    kept = line_ops.kept_lines(before, after)
    assert 3000 <= len(kept) == common_length(before, after)


def moved_files(rng):
    """Contents of deleted and added files in two repositories, many alike."""
    bases = [[f"l{rng.randrange(60)}" for _ in range(n)] for n in (1, 2, 6, 12, 25)]
    base, head = {}, {}
    for k in range(90):
        for side, files in (("old", base), ("new", head)):
            lines = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 2, 6))):
                lines[rng.randrange(len(lines))] = f"e{rng.randrange(12)}"
            if rng.random() < 0.2:
                rng.shuffle(lines)
            files[rng.choice("rs"), f"{side}/{k:03d}"] = "\n".join(lines) + rng.choice(("", "\n"))
    base["r", "old/empty"] = head["r", "new/none"] = ""
    base["r", "old/bin"] = head["r", "new/bin"] = b"\xff\nx\ny\n"
    head["r", "new/bin"] += b"z"
    return base, head


def greedy_pairs(base, head, exact, percent):
    def sets(files, taken):
        found = {}
        for key, text in files.items():
            if key not in taken and isinstance(text, str) and text:
                found[key] = set(text.removesuffix("\n").split("\n"))
        return found

    def digest(lines):
        return hashlib.md5("\n".join(sorted(lines)).encode()).hexdigest()

    olds = sets(base, {(r, p) for r, _, p in exact})
    news = sets(head, {(r, p) for r, p, _ in exact})
    pairs = []
    for (r, p), a in olds.items():
        for (s, q), b in news.items():
            if r == s and 100 * len(a & b) >= percent * len(a | b):
                tie = hashlib.md5((digest(a) + digest(b)).encode()).hexdigest()
                pairs.append((-len(a & b) / len(a | b), tie, p, q, r))
    used, result = set(), set()
    for score, _, p, q, r in sorted(pairs):
        if (0, r, p) not in used and (1, r, q) not in used:
            used |= {(0, r, p), (1, r, q)}
            result.add((r, q, p, -score))
    return result


@pytest.mark.parametrize("percent, hot_rows", [(50, None), (80, 2)])
def test_similar_renames(make_files, percent, hot_rows):
    base, head = moved_files(random.Random(percent))
    old, new = make_files(base), make_files(head)
    delta = stored(path_delta(old, new))
    exact = stored(exact_renames(delta))
    taken = {(r.repo, r.path, r.previous_path) for r in exact.collect()}
    found = similar_renames(old, new, delta, exact, percent, hot_rows).collect()
    assert {(r.repo, r.path, r.previous_path, r.score) for r in found} == greedy_pairs(base, head, taken, percent)
    assert len(found) > 20 and {r.change_type for r in found} == {"R"}


@pytest.mark.parametrize("local_edges", [250_000, 3])
def test_a_family_of_copies_takes_no_round_for_each(make_files, monkeypatch, local_edges):
    from quire.operators import renames

    # Every old file is closest to the new file with the fewest lines of its own, and the other way round.
    def family(folder, last):
        return {f"{folder}/{k}": "\n".join([*map(str, range(60)), *[f"{folder} {k} {i}" for i in range(k + 1)]]) + last for k in range(8)}

    base, head = family("old", ""), family("new", "\n")
    rounds = []
    take = renames._take_best
    monkeypatch.setattr(renames, "_take_best", lambda *given: rounds.append(1) or take(*given))
    monkeypatch.setattr(renames, "LOCAL_EDGES", local_edges)
    changes = {(r.path, r.previous_path) for r in snapshot_changes(make_files(base), make_files(head)).collect()}
    assert changes == {(f"new/{k}", f"old/{k}") for k in range(8)}
    assert len(rounds) == 0 if local_edges > 64 else len(rounds) > 1


def test_classes_of_many_alike_files(make_files, monkeypatch):
    from quire.operators import renames

    monkeypatch.setattr(renames, "PAIR_STEP", 7)
    base = {f"old/{i:03d}": "a\nb\nc" for i in range(60)} | {"old/x": "q\nr"}
    head = {f"new/{i:03d}": "a\nb\nd" for i in range(25)} | {f"new/s{i:03d}": "c\nb\na\n" for i in range(20)}
    changes = {(r.path, r.previous_path) for r in snapshot_changes(make_files(base), make_files(head)).collect()}
    assert changes == {(f"new/s{i:03d}", f"old/{i:03d}") for i in range(20)} | {
        (f"new/{i:03d}", f"old/{20 + i:03d}") for i in range(25)}


def test_edited_renames_are_records(make_files):
    base = make_files({"a/x.c": "1\n2\n3\n4\n", "gone": "z"})
    head = make_files({"b/x.c": "1\n2\n3\nnew\n", "fresh": "y"})
    both = {(r.change_type, r.path, r.previous_path) for r in snapshot_changes(base, head).collect()}
    assert both == {("R", "b/x.c", "a/x.c"), ("A", "fresh", None)}
    exact = {(r.change_type, r.path) for r in snapshot_changes(base, head, similar=False).collect()}
    assert exact == {("A", "b/x.c"), ("A", "fresh")}
