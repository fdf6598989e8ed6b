"""Unpacking written artifacts of any size: one summary per split, then all splits side by side."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import constants as C
from quire.operators.scale import stored
from quire.operators.unpack import STATUS_HUNKS, STATUS_MALFORMED, STATUS_OK, checked_files
from quire.sources.splits import (
    begin_states,
    file_stem,
    folder_value,
    read_splits,
    scan,
    split_files,
    with_states,
)

# Kinds of lines; all others are 0.
HEADING, FENCE, BEGIN, END, NUMBERS, HUNKS, SECTION, BLANK = range(1, 9)
# Where a line stands: preamble, sections in front of the files, a fence in them, between files, below a heading,
# in a body, behind the files.
PREAMBLE, SECTIONS, DRAWING, BETWEEN, TITLED, BODY, BEHIND = "PSDFHBE"
START = [PREAMBLE, 0, False, False, False, None]


def unpack_stored(
    spark: SparkSession, location: str, files_begin: str = C.FILES_BEGIN, files_end: str = C.FILES_END
) -> DataFrame:
    """Files of artifacts as they were written: ``(repo, part, ord, path, safe_path, text, status)``.

    ``location`` holds the folders ``repo=.../range=...`` of :func:`quire.sinks.artifact.write_artifacts`, or text files
    named ``<repo>.<ext>``, of any size: a file may span any number of splits, ranges and text files. An artifact that breaks
    off, has a heading without a fence, or holds changed lines gives one row with its status and no file, as
    :func:`quire.operators.unpack.unpack` does for artifacts in rows. ``part`` and ``ord`` are the split and the
    line in it where a file begins; they rise with the order of the files.

    Only files that span splits are shuffled; all others are read where they lie.
    """
    lines = read_splits(spark, location).withColumn("kind", line_kind(F.col("value"), files_begin, files_end))
    lines = lines.withColumn("value", F.col("value").cast("binary"))
    # A summary needs no text but that of the fences.
    events = lines.withColumn("value", F.when(F.col("kind") == FENCE, F.col("value")))
    files = split_files(spark, location).withColumn("folder", folder_value(F.col("file"), "range")).withColumn(
        "repo", F.when(F.col("file").contains("/range="), folder_value(F.col("file"), "repo")).otherwise(file_stem(F.col("file"))))
    summaries = scan(events, Summary, "file_key bigint, block bigint, summary string").join(files, "file_key")
    states = stored(begin_states(summaries, START, step, verdict))
    read = scan(
        with_states(lines, states.filter(F.col("status") == STATUS_OK)), Reader,
        "repo string, part bigint, ord bigint, split_no bigint, piece bigint, whole boolean, numbered boolean, heading binary, text binary")
    read = stored(read)
    whole = read.filter("whole").select("repo", "part", "ord", "numbered", "heading", "text")
    joined = F.array_sort(F.collect_list(F.struct("split_no", "piece", F.col("text").cast("string").alias("text"))))
    spanning = read.filter("NOT whole").groupBy("repo", "part", "ord").agg(
        F.bool_or("numbered").alias("numbered"), F.max("heading").alias("heading"),
        F.array_join(F.transform(joined, lambda p: p["text"]), "").cast("binary").alias("text"))
    found = checked_files(whole.unionByName(spanning).select(
        "repo", "part", "ord", F.col("numbered").alias("line_numbers"), F.col("heading").cast("string").alias("heading"),
        F.col("text").cast("string").alias("body"), F.lit(STATUS_OK).alias("status")))
    null = F.lit(None).cast("string")
    unread = states.filter(F.col("status") != STATUS_OK).filter("split_no = 0").select(
        "repo", F.lit(0).cast("bigint").alias("part"), F.lit(None).cast("bigint").alias("ord"), null.alias("path"),
        null.alias("safe_path"), null.alias("text"), "status")
    return found.unionByName(unread)


def line_kind(line: Column, files_begin: str, files_end: str) -> Column:
    return (
        F.when(line.isin(C.CONTEXT_HEADING, C.TREE_HEADING), SECTION)
        .when(F.startswith(line, F.lit("## ")), HEADING)
        .when(F.startswith(line, F.lit("```")), FENCE)
        .when(line == files_begin, BEGIN)
        .when(line == files_end, END)
        .when(line == C.LINE_NUMBERS_FLAG, NUMBERS)
        .when(F.startswith(line, F.lit(C.HUNKS_FLAG)), HUNKS)
        .when(line.rlike(r"\A[ \t\r\f]*\z"), BLANK)
        .otherwise(0)
        .cast("int"))


def ticks(line: bytes) -> int:
    return len(line) - len(line.lstrip(b"`"))


def advance(state: list, kind: int, fence: int, bare: bool, at: int) -> None:
    """Lead ``[place, fence, numbers, hunks, broken, opened]`` over one line, in place."""
    place = state[0]
    if place == BODY or place == DRAWING:
        if kind == FENCE and bare and fence == state[1]:
            state[0] = BETWEEN if place == BODY else SECTIONS
    elif place == TITLED:
        if kind == FENCE:
            state[0], state[1] = BODY, fence
        elif kind != BLANK:
            state[4] = True
            state[0] = BETWEEN
            advance(state, kind, fence, bare, at)
    elif place == BETWEEN:
        if kind in (HEADING, SECTION):
            state[0], state[5] = TITLED, at
        elif kind == END:
            state[0] = BEHIND
    elif place != BEHIND:
        if kind == BEGIN:
            state[0] = BETWEEN
        elif kind == HEADING:
            state[0], state[5] = TITLED, at
        elif kind == SECTION:
            state[0] = SECTIONS
        elif place == PREAMBLE:
            state[2], state[3] = state[2] or kind == NUMBERS, state[3] or kind == HUNKS
        elif kind == FENCE:
            state[0], state[1] = DRAWING, fence


class Summary:
    """End states of a split by its begin state; within a fence they depend on the fence's length alone."""

    def __init__(self, first: dict):
        self.key = (first["file_key"], first["block"])
        self.events: list[tuple[int, int, bool, int]] = []
        self.lines = 0
        self.plain = False

    def feed(self, columns: dict) -> list[tuple]:
        kinds, values = columns["kind"], columns["value"]
        # Of plain and blank lines in a row the first plain one tells as much as all of them.
        last = -1
        for i in np.flatnonzero((kinds > 0) & (kinds != BLANK)).tolist():
            self.passed(kinds[last + 1 : i])
            fence = ticks(values[i]) if kinds[i] == FENCE else 0
            self.events.append((int(kinds[i]), fence, fence > 0 and fence == len(values[i]), self.lines + i))
            self.plain, last = False, i
        self.passed(kinds[last + 1 :])
        self.lines += len(kinds)
        return []

    def passed(self, kinds: np.ndarray) -> None:
        if not self.plain and (kinds == 0).any():
            self.plain = True
            self.events.append((0, 0, False, -1))

    def run(self, place: str, first: int, known: dict[int, list]) -> list:
        state = [place, 0, False, False, False, None]
        for i in range(first, len(self.events)):
            if i in known and state[0] == BETWEEN:
                rest = known[i]
                return [*rest[:2], state[2] or rest[2], state[3] or rest[3], state[4] or rest[4],
                        state[5] if rest[5] is None else rest[5]]
            advance(state, *self.events[i])
        return state

    def end(self) -> list[tuple]:
        closed: dict[int, int] = {}
        for i, (kind, fence, bare, _) in enumerate(self.events):
            if kind == FENCE and bare:
                closed.setdefault(fence, i + 1)
        bodies: dict[int, list] = {}
        for i in sorted(closed.values(), reverse=True):
            bodies[i] = self.run(BETWEEN, i, bodies)
        ends = {place: self.run(place, 0, bodies) for place in (PREAMBLE, SECTIONS, BETWEEN, TITLED, BEHIND)}
        ends[BODY] = {fence: bodies[i] for fence, i in closed.items()}
        ends[DRAWING] = {fence: self.run(SECTIONS, i, bodies) for fence, i in closed.items()}
        return [(*self.key, json.dumps(ends))]


def step(state: list, summary: str, split_no: int) -> list:
    place, fence, numbers, hunks, broken, opened = state
    end = json.loads(summary)[place]
    if place in (BODY, DRAWING):
        end = end.get(str(fence))
        if end is None:
            return state
    return [end[0], end[1], numbers or end[2], hunks or end[3], broken or end[4],
            opened if end[5] is None else [split_no, end[5]]]


def verdict(state: list, splits) -> str:
    place, _, _, hunks, broken, _ = state
    if hunks:
        return STATUS_HUNKS
    return STATUS_MALFORMED if broken or place in (TITLED, BODY) else STATUS_OK


class Reader:
    """Bodies of a split whose begin state is known. A file that lies in it as a whole is one row."""

    def __init__(self, first: dict):
        self.repo, self.split_no = first["repo"], int(first["split_no"])
        self.state = json.loads(first["state"])
        self.id = tuple(self.state[5] or (0, 0))
        self.heading: bytes | None = None
        self.text: list[bytes] = []
        self.whole, self.pieces, self.lines = False, 0, 0

    def feed(self, columns: dict) -> list[tuple]:
        kinds, values, rows = columns["kind"], columns["value"], []
        start = 0
        for i in np.flatnonzero((kinds > 0) & (kinds != BLANK)).tolist():
            before = self.state[0]
            fence = ticks(values[i]) if kinds[i] == FENCE else 0
            advance(self.state, int(kinds[i]), fence, fence > 0 and fence == len(values[i]), self.lines + i)
            now = self.state[0]
            if now == TITLED and before != TITLED:
                self.id, self.heading, self.whole = (self.split_no, self.lines + i), values[i][3:], True
            elif now == BODY and before != BODY:
                start = i + 1
            elif before == BODY and now != BODY:
                self.keep(values[start:i])
                rows.append(self.row())
        if self.state[0] == BODY:
            self.keep(values[start:])
        self.lines += len(kinds)
        return rows

    def keep(self, lines: np.ndarray) -> None:
        if len(lines):
            self.text.append(b"\n".join(lines) + b"\n")

    def row(self) -> tuple:
        self.pieces += 1
        row = (self.repo, *self.id, self.split_no, self.pieces, self.whole, self.state[2], self.heading, b"".join(self.text))
        self.heading, self.text, self.whole = None, [], False
        return row

    def end(self) -> list[tuple]:
        if self.state[0] not in (TITLED, BODY):
            return []
        self.whole = False
        return [self.row()]
