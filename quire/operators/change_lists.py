"""NUL-separated change lists of any size: roles of fields from the states of splits."""

from __future__ import annotations

import base64
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.scale import stored
from quire.sources.splits import begin_states, file_stem, folder_value, read_splits, scan, split_files, with_states

# What the next field is: a status, the only path, the old path, the new path.
STATUS, ONLY, OLD, NEW = "SPON"
#: Place, status and old path of the record that is open, and whether the list was broken.
START = [STATUS, None, None, False]


def read_change_lists(spark: SparkSession, location: str) -> DataFrame:
    """Change lists, one per text file ``<repo>.<ext>`` or folder ``repo=...``, to typed rows with ``parse_error``.

    Gives the rows of :func:`quire.operators.changes.parse_name_status`, but a list may have any size: it is read in Spark's
    splits, and a record may lie in several of them. A list that ends inside a record, or has an empty path in one,
    yields one row with ``parse_error`` and no path. An empty file has no rows.
    """
    fields = read_splits(spark, location, "\0").withColumn("value", F.col("value").cast("binary"))
    name = F.when(F.col("file").contains("/repo="), folder_value(F.col("file"), "repo")).otherwise(file_stem(F.col("file")))
    files = split_files(spark, location).select(name.alias("repo"), F.lit("").alias("folder"), "file", "size", "file_key")
    summaries = scan(fields, Summary, "file_key bigint, block bigint, summary string").join(files, "file_key")
    states = stored(begin_states(summaries, START, step, verdict))
    records = scan(
        with_states(fields, states.filter("status = 'ok'")), Reader,
        "repo string, status string, old_path binary, new_path binary")
    letter = F.left("status", F.lit(1))
    renamed = letter == "R"
    found = records.filter(letter != "D").select(
        "repo", F.col("new_path").cast("string").alias("path"), F.when(letter.isin("A", "R"), letter).otherwise("M").alias("change_type"),
        F.when(renamed, F.col("old_path").cast("string")).alias("previous_path"), F.lit(False).alias("parse_error"))
    null = F.lit(None).cast("string")
    broken = states.filter("status <> 'ok' AND split_no = 0").select(
        "repo", null.alias("path"), null.alias("change_type"), null.alias("previous_path"), F.lit(True).alias("parse_error"))
    return found.unionByName(broken)


def shown(value: bytes | None) -> str | None:
    return None if value is None else base64.b64encode(value).decode()


def advance(state: list, field: bytes) -> tuple | None:
    """Lead the state over one field; a finished record is returned as (status, old path, new path)."""
    place = state[0]
    if place == STATUS:
        # Empty fields between records are padding.
        if field:
            state[:3] = [OLD if field[:1] in (b"R", b"C") else ONLY, field, None]
        return None
    state[3] = state[3] or not field
    if place == OLD:
        state[0], state[2] = NEW, field
        return None
    record = (state[1], state[2], field)
    state[:3] = [STATUS, None, None]
    return record


class Summary:
    """End states of a split for each role its first field may have, and its size."""

    def __init__(self, first: dict):
        self.key = (first["file_key"], first["block"])
        # Null stands for what the splits before have read.
        self.states = {place: [place, None, None, False] for place in (STATUS, ONLY, OLD, NEW)}
        self.size = 0

    def feed(self, columns: dict) -> list[tuple]:
        values = columns["value"].tolist()
        self.size += sum(map(len, values)) + len(values)
        states = list(self.states.values())
        for at, value in enumerate(values):
            for state in states:
                advance(state, value)
            # States that have become one go on as one.
            if len(states) > 1 and all(s == states[0] for s in states[1:]):
                for later in values[at + 1 :]:
                    advance(states[0], later)
                for state in states[1:]:
                    state[:] = states[0]
                break
        return []

    def end(self) -> list[tuple]:
        ends = {place: [s[0], shown(s[1]), shown(s[2]), s[3]] for place, s in self.states.items()}
        return [(*self.key, json.dumps([self.size, ends]))]


def step(state: list, summary: str, split_no: int) -> list:
    place, status, old, broken = state
    end = json.loads(summary)[1][place]
    # An open record may have begun in a split before; its fields are kept from there.
    open_record = end[0] != STATUS
    return [end[0], (end[1] or status) if open_record else None,
            (end[2] if end[2] is not None else old) if end[0] == NEW else None, broken or end[3]]


def verdict(state: list, splits) -> str:
    # Every field ends with NUL, the last one too: otherwise one byte is missing.
    sizes = splits.drop_duplicates("file_key")["size"].sum()
    complete = sum(json.loads(s)[0] for s in splits["summary"]) == sizes
    trailing = state[0] == STATUS and complete
    return "ok" if trailing and not state[3] else "broken"


class Reader:
    def __init__(self, first: dict):
        self.repo = first["repo"]
        place, status, old, broken = json.loads(first["state"])
        self.state = [place, *(None if v is None else base64.b64decode(v) for v in (status, old)), broken]

    def feed(self, columns: dict) -> list[tuple]:
        found = (advance(self.state, field) for field in columns["value"].tolist())
        return [(self.repo, r[0].decode("utf-8", "replace"), r[1], r[2]) for r in found if r]

    def end(self) -> list[tuple]:
        return []
